"""Language-model scores by a weighted backoff automaton.

The model is an n-gram model smoothed by a Dirichlet prior: an n-gram g w seen c times has
P(w | g) = (c + m P(w | shorter g)) / (c(g) + m), so unseen words take the failure arc of g
with weight m / (c(g) + m) to the shorter context. Single words have the base
probability (c + 0.5) / (N + 0.5 (V + 1)), which keeps one share for all unknown words.

Documents are dealt into buckets of about `BUCKET_CHARS` characters. A bucket counts its own
n-grams, and sends keys and counts, sorted and cut by shard, as blocks. A shard adds up the
counts of its keys over all buckets, and answers each block with the totals in the same
order. With the answers a bucket builds that part of the automaton that its documents can
reach (which is exact: no other n-gram occurs in them). All its texts walk at once, as arrays
over their tokens: the state before a token is the longest known context, to which the arc of the
token before leads; tokens without an arc follow failures, from the longest contexts
down. A key occurs once per bucket at most, so frequent
n-grams make no hot task; no task ever holds the whole model.

Keys are 64-bit hashes of n-grams. Defined results: null and empty texts have the end token only.
Each row is a text of its own, also rows with equal ids. Without training rows N and V
are 0, all tokens are unknown.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import tuned

ORDER = 2
#: Weight of the shorter context, by order from 2 on.
PRIOR = 40.0
BUCKET_CHARS = 6_000_000
SHARD_KEYS = 1_000_000
START, END = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
MIX = np.uint64(0xD6E8FEB86659FD93)


def joined(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Key of an n-gram from the keys of its context and its last word."""
    x = (context ^ (context >> np.uint64(29))) * MIX + word
    x ^= x >> np.uint64(32)
    return x * MIX


class Counted:
    """N-grams of a bucket: distinct keys by order, counts in training texts, and where each token's n-gram stands."""

    def __init__(self, column: pa.Array, train: np.ndarray, order: int):
        # empty texts and blanks at the ends leave empty words
        split = pc.ascii_split_whitespace(pc.ascii_lower(column.fill_null("")))
        flat = split.flatten()
        real = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
        row = np.repeat(np.arange(len(split)), pc.list_value_length(split).to_numpy(zero_copy_only=False))
        self.sizes = np.bincount(row[real], minlength=len(split)) + 1
        coded = flat.filter(pa.array(real)).dictionary_encode()
        n, ends = int(self.sizes.sum()), np.cumsum(self.sizes)
        self.begins = ends - self.sizes
        distinct = coded.dictionary.cast(pa.binary())
        spaced = pc.binary_join(pa.ListArray.from_arrays([0, len(distinct)], distinct), b" ")[0].as_py()
        hashes = [xxhash.xxh64_intdigest(x, 11) for x in spaced.split()]
        keys, at = np.unique(np.array([*hashes, END], dtype=np.uint64), return_inverse=True)
        code = np.full(n, len(hashes))
        inner = np.ones(n, dtype=bool)
        inner[ends - 1] = False
        code[inner] = coded.indices.to_numpy(zero_copy_only=False)
        at = at[code]
        place = np.arange(n) - np.repeat(self.begins, self.sizes)
        learned = np.repeat(train, self.sizes)
        self.keys, self.counts, self.at = [keys], [np.bincount(at[learned], minlength=len(keys))], [at]
        word = keys[at]
        key = word
        for k in range(1, order):
            # the first tokens of a text have the start as their context
            before = np.roll(key, 1)
            before[place == 0] = START
            context = before if k == 1 else np.where(place < k - 1, START, before)
            key = joined(context, word)
            use = place >= k - 1
            keys, at = np.unique(key[use], return_inverse=True)
            self.keys.append(keys)
            self.counts.append(np.bincount(at[learned[use]], minlength=len(keys)))
            where = np.full(n, -1)
            where[use] = at
            self.at.append(where)


def packed(counts: np.ndarray) -> bytes:
    """Counts as a byte each; those from 255 on follow as 64-bit numbers."""
    return np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[counts >= 255].astype("<i8").tobytes()


def unpacked(raw: bytes, n: int) -> np.ndarray:
    """`n` counts from their packed form."""
    counts = np.frombuffer(raw, dtype=np.uint8, count=n).astype(np.int64)
    counts[counts == 255] = np.frombuffer(raw, dtype="<i8", offset=n)
    return counts


def blocks(keys: np.ndarray, shards: int):
    """(shard, positions of its keys in order) for each shard that has keys."""
    shard = (keys % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    cuts = np.flatnonzero(np.r_[True, shard[order][1:] != shard[order][:-1]]) if len(keys) else []
    for i, j in zip(cuts, [*cuts[1:], len(keys)], strict=True):
        yield int(shard[order[i]]), order[i:j]


def bucketed(df: DataFrame, key: str, text: str, train, bucket_chars: int) -> tuple[DataFrame, int]:
    """(bucket, id, row, train, text), and the characters of all texts."""
    body = F.coalesce(F.col(text), F.lit(""))
    chars = df.agg(F.sum(F.length(body).cast("long") + 1)).first()[0] or 0
    n = max(1, -(-chars // bucket_chars))
    docs = df.select(F.col(key).alias("id"), train.alias("train"), body.alias("text"))
    return docs.withColumn("bucket", F.pmod(F.xxhash64("id", "text"), F.lit(n))), chars


def counted_blocks(docs: DataFrame, order: int, shards: int) -> DataFrame:
    """(k, shard, bucket, keys, counts): each bucket's own counts."""

    def run(table):
        c = Counted(table.column("text").combine_chunks(), table.column("train").to_numpy(), order)
        bucket, rows = table.column("bucket")[0].as_py(), []
        for k in range(order):
            for shard, at in blocks(c.keys[k], shards):
                rows.append((k, shard, bucket, c.keys[k][at].tobytes(), packed(c.counts[k][at])))
        return pa.table(dict(zip(("k", "shard", "bucket", "keys", "counts"), map(list, zip(*rows, strict=True)), strict=True)), schema=BLOCK)

    ordered = docs.select("bucket", "text", "train")
    return ordered.groupBy("bucket").applyInArrow(run, "k int, shard long, bucket long, keys binary, counts binary")


BLOCK = pa.schema([("k", pa.int32()), ("shard", pa.int64()), ("bucket", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
ANSWER = pa.schema(
    [("k", pa.int32()), ("shard", pa.int64()), ("bucket", pa.int64()), ("totals", pa.binary()), ("tokens", pa.int64()), ("kinds", pa.int64())]
)


def answered(sent: DataFrame) -> DataFrame:
    """(k, shard, bucket, totals, tokens, kinds): totals in the order of the keys sent; sums stand in rows without a bucket."""

    def run(table):
        keys = [np.frombuffer(x, dtype="<u8") for x in table.column("keys").to_pylist()]
        counts = [unpacked(x, len(k)) for x, k in zip(table.column("counts").to_pylist(), keys, strict=True)]
        _, at = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(at, weights=np.concatenate(counts)).astype(np.int64)
        cuts = np.cumsum([len(x) for x in keys])[:-1]
        k, shard = table.column("k")[0].as_py(), table.column("shard")[0].as_py()
        back = [packed(t) for t in np.split(total[at], cuts)]
        n = len(back)
        return pa.table(
            {
                "k": [k] * (n + 1), "shard": [shard] * (n + 1), "bucket": [*table.column("bucket").to_pylist(), None],
                "totals": [*back, None],
                "tokens": [None] * n + [int(total.sum())], "kinds": [None] * n + [int((total > 0).sum())],
            },
            schema=ANSWER,
        )

    return sent.groupBy("k", "shard").applyInArrow(run, "k int, shard long, bucket long, totals binary, tokens long, kinds long")


class Automaton:
    """States are contexts seen in training; arcs are n-grams; a state without an arc for a word fails to a shorter one."""

    def __init__(self, counted: Counted, totals: list[np.ndarray], tokens: int, kinds: int, prior: float):
        order = len(totals)
        self.counted, self.known = counted, [t > 0 for t in totals]
        base = (totals[0] + 0.5) / (tokens + 0.5 * (kinds + 1))
        # states: 0 without context, then known n-grams of each shorter order, and the start
        self.state_of, states = [], 1
        for known in self.known[:-1]:
            self.state_of.append(np.where(known, states + np.cumsum(known) - 1, 0))
            states += int(known.sum())
        self.start = states if order > 1 else 0
        seen, self.depth = np.zeros(states + 1), np.zeros(states + 1, dtype=np.int64)
        self.fail = np.zeros(states + 1, dtype=np.int64)
        for k, (known, state) in enumerate(zip(self.known, self.state_of, strict=False)):
            seen[state[known]] = totals[k][known]
            self.depth[state[known]] = k + 1
        if order > 1:
            seen[self.start] = totals[0][np.searchsorted(counted.keys[0], END)]
            self.depth[self.start] = 1
        starts = np.zeros(len(counted.at[0]), dtype=bool)
        starts[counted.begins] = True
        chance = [base]
        for k in range(1, order):
            n = len(counted.keys[k])
            context, short = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
            place = np.flatnonzero(counted.at[k] >= 0)
            g = counted.at[k][place]
            short[g] = counted.at[k - 1][place]
            first = starts[place] if k == 1 else np.zeros(len(place), dtype=bool)
            before = np.where(first, 0, counted.at[k - 1][np.maximum(place - 1, 0)])
            context[g] = np.where(first, self.start, self.state_of[k - 1][np.maximum(before, 0)])
            if k > 1:
                self.fail[context[g]] = self.state_of[k - 2][counted.at[k - 2][np.maximum(place - 1, 0)]]
            chance.append((totals[k] + prior * chance[k - 1][short]) / (seen[context] + prior))
        self.log = [np.log10(c) for c in chance]
        self.fail_log = np.log10(prior / (seen + prior))

    def states(self) -> np.ndarray:
        """The state before each token, the longest known context there; the start before the first token of a text."""
        at = self.counted.at
        if not self.state_of:
            return np.zeros(len(at[0]), dtype=np.int64)
        after = self.state_of[0][at[0]]
        for known, state, g in zip(self.known[1:], self.state_of[1:], at[1:], strict=False):
            here = np.flatnonzero(g >= 0)
            here = here[known[g[here]]]
            after[here] = state[g[here]]
        before = np.roll(after, 1)
        before[self.counted.begins] = self.start
        return before

    def walk(self) -> np.ndarray:
        """Log probability of each token: all texts follow their arcs at once, and failures from the longest contexts down."""
        state, total = self.states(), np.zeros(len(self.counted.at[0]))
        arc = np.full(len(total), True)
        for k in range(len(self.known) - 1, 0, -1):
            here = np.flatnonzero(arc & (self.depth[state] == k))
            g = self.counted.at[k][here]
            hit = self.known[k][g]
            total[here[hit]] += self.log[k][g[hit]]
            arc[here[hit]] = False
            lost = here[~hit]
            total[lost] += self.fail_log[state[lost]]
            state[lost] = self.fail[state[lost]]
        return total + np.where(arc, self.log[0][self.counted.at[0]], 0.0)


def scored(docs: DataFrame, answers: DataFrame, order: int, shards: int, tokens: int, kinds: int, prior: float) -> DataFrame:
    """(id, n_tokens, n_known, base_score, score) of every document of the buckets."""
    id_type = docs.schema["id"].dataType

    def run(mine, totals):
        c = Counted(mine.column("text").combine_chunks(), mine.column("train").to_numpy(), order)
        got = {(r["k"], r["shard"]): r["totals"] for r in totals.select(["k", "shard", "totals"]).to_pylist()}
        full = []
        for k in range(order):
            total = np.zeros(len(c.keys[k]), dtype=np.int64)
            for shard, at in blocks(c.keys[k], shards):
                total[at] = unpacked(got[k, shard], len(at))
            full.append(total)
        a = Automaton(c, full, tokens, kinds, prior)
        known = a.known[0][c.at[0]].astype(np.int64)
        return pa.table({
            "id": mine.column("id"), "n_tokens": pa.array(c.sizes, pa.int64()), "n_known": pa.array(np.add.reduceat(known, c.begins)),
            "base_score": pa.array(np.add.reduceat(a.log[0][c.at[0]], c.begins)), "score": pa.array(np.add.reduceat(a.walk(), c.begins)),
        })

    left = docs.select("bucket", "id", "train", "text").groupBy("bucket")
    right = answers.where("bucket IS NOT NULL").select("bucket", "k", "shard", "totals").groupBy("bucket")
    return left.cogroup(right).applyInArrow(run, f"id {id_type.simpleString()}, n_tokens long, n_known long, base_score double, score double")


def log_probabilities(df: DataFrame, train, key: str = "doc_id", text: str = "text", order: int = ORDER, prior: float = PRIOR, bucket_chars: int = BUCKET_CHARS, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """(id, train, n_tokens, n_known, train_tokens, base_score, score) of every row; `train` tells the rows to learn from."""
    tuned(df.sparkSession)
    docs, chars = bucketed(df, key, text, train, bucket_chars)
    shards = max(1, -(-chars // (6 * shard_keys)))
    answers = materialize(answered(counted_blocks(docs, order, shards)))
    sums = answers.where("bucket IS NULL AND k = 0").agg(F.sum("tokens"), F.sum("kinds")).first()
    tokens, kinds = (int(x or 0) for x in sums)
    return scored(docs, answers, order, shards, tokens, kinds, prior).withColumn("train_tokens", F.lit(tokens).cast("long"))
