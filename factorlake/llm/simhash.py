"""Near-duplicates by SimHash, linked over the anchors of a covering code.

A fingerprint is cut into blocks so that two fingerprints within `bits` differing
bits have a block in which they differ in one bit at most. The anchors of a block are
the words of a Hamming code, which covers every block within one bit: each
fingerprint is at home at its nearest anchor and visits all anchors within two bits
(covering radius plus the block's threshold). Two fingerprints that are close in
the block therefore meet at the home of either. Only distinct fingerprints take part, each
with the smallest id that has it, and per anchor the links found are reduced to a
forest before they leave the task, so a dense group costs rows, not pairs.
An anchor with more than `HOT_ROWS` rows is split by its homes, its visitors
go to every part.

Defined results: text without words has fingerprint zero, linked like any other.
Rows with a null id get a fingerprint, link with nothing and have no component. Rows with
equal ids share a component only where their fingerprints do; the id stands for all.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import drop_table, materialize, small
from . import buckets
from .common import fresh, list_array, ship, texts, tuned
from .components import components, forest, strongest_at

SEED = 42
#: Rows at one anchor beyond which it is split.
HOT_ROWS = 20_000
#: Rows that a task holds at a time, and comparisons that it makes at once.
HELD_ROWS, AT_ONCE = 50_000, 2_000_000


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """XXH64 of all shingles, repeats included; the whole sequence where there are fewer words."""
    line = b" ".join(words)
    size = min(size, len(words))
    if size == 0:
        return np.empty(0, dtype=">u8")
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    digest = xxhash.xxh64_digest
    return np.frombuffer(b"".join([digest(line[i:j], SEED) for i, j in zip(starts, ends[size - 1 :].tolist(), strict=False)]), dtype=">u8")


def word_hashes(words: list[bytes]) -> np.ndarray:
    """XXH64 of the distinct words."""
    digest = xxhash.xxh64_digest
    return np.frombuffer(b"".join([digest(w, SEED) for w in set(words)]), dtype=">u8")


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half the hashes."""
    if len(hashes) == 0:
        return 0
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 255):
        part = np.unpackbits(hashes[i : i + 255].view(np.uint8).reshape(-1, 8), axis=1)
        ones += part.sum(axis=0, dtype=np.uint8)
    return int(np.packbits(2 * ones > len(hashes)).view(">u8")[0])


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", size: int | None = 3) -> DataFrame:
    """(id, fp long) of every row; size None takes the set of words instead of shingles."""
    make = word_hashes if size is None else lambda words: shingle_hashes(words, size)

    def run(batches):
        for b in batches:
            found = [fingerprint(make(t.lower().split())) for t in texts(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(found, dtype=np.uint64).view(np.int64))], names=["id", "fp"])

    tuned(df.sparkSession)
    return df.select(F.col(key).cast("long"), text).mapInArrow(run, "id long, fp long")


def blocks_for(bits: int) -> int:
    """Blocks, a power of two, so that within `bits` differing bits some block has one at most."""
    blocks = 2
    while 2 * blocks <= bits:
        blocks *= 2
    return blocks


class Code:
    """The Hamming code on the first 2^r - 1 bits of a block; the block's last bit stands for itself."""

    def __init__(self, width: int):
        self.width, self.long = width, width - 1
        places = np.arange(1, width, dtype=np.uint64)
        self.checks = [np.bitwise_or.reduce(np.where(places >> np.uint64(j) & np.uint64(1), np.uint64(1) << (places - np.uint64(1)), np.uint64(0))) for j in range(width.bit_length() - 1)]
        one = lambda p: np.uint64(1) << np.uint64(p - 1)
        self.pairs = np.zeros((width, (width - 2) // 2), dtype=np.uint64)
        for s in range(1, width):
            self.pairs[s] = [one(p) | one(p ^ s) for p in range(1, width) if p < p ^ s]

    def syndrome(self, block: np.ndarray) -> np.ndarray:
        return sum((np.bitwise_count(block & c).astype(np.int64) & 1) << j for j, c in enumerate(self.checks))

    def home(self, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        s = self.syndrome(block)
        flip = np.where(s > 0, np.uint64(1) << np.maximum(s - 1, 0).astype(np.uint64), np.uint64(0))
        return block ^ flip, s

    def rows(self, block: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position, anchor, role): role 0 at home, 1 on a visit."""
        n = np.arange(len(block))
        home, s = self.home(block)
        odd = np.flatnonzero(s > 0)
        far = block[odd, None] ^ self.pairs[s[odd]]
        at = np.concatenate([n, n, np.repeat(odd, far.shape[1])])
        anchor = np.concatenate([home, home ^ (np.uint64(1) << np.uint64(self.long)), far.ravel()])
        return at, anchor, np.concatenate([np.zeros(len(n), dtype=np.int8), np.ones(len(anchor) - len(n), dtype=np.int8)])


def at_anchors(fps: DataFrame, bits: int) -> DataFrame:
    """(anchor, role, *columns of fps) for every anchor of every block."""
    blocks, kinds = blocks_for(bits), ", ".join(f"{c} long" for c in fps.columns)
    width = 64 // blocks

    def run(batches):
        code = Code(width)
        for b in batches:
            columns = {c: b.column(c).to_numpy() for c in b.schema.names}
            fp = columns["fp"].view(np.uint64)
            for i in range(blocks):
                at, anchor, role = code.rows((fp >> np.uint64(i * width)) & np.uint64((1 << width) - 1))
                anchor = (anchor | np.uint64(i << 32)).view(np.int64)
                yield pa.RecordBatch.from_pydict({"anchor": anchor, "role": role} | {c: x[at] for c, x in columns.items()})

    return fps.mapInArrow(run, f"anchor long, role tinyint, {kinds}")


def split_hot(rows: DataFrame, limit: int) -> DataFrame:
    """Adds `part`: 0 but for hot anchors, whose homes are dealt out and whose visitors go to every part."""
    hot = rows.groupBy("anchor").count().where(F.col("count") > limit)
    hot = materialize(hot.select(F.col("anchor").alias("hot"), F.ceil(F.col("count") / limit).cast("int").alias("parts")))
    n = hot.count()
    if n == 0:
        return rows.withColumn("part", F.lit(0))
    dealt = rows.join(small(hot, n), F.col("anchor") == F.col("hot"), "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.xxhash64(*[c for c in rows.columns if c not in ("anchor", "role")])
    dealt = dealt.withColumn("own", F.pmod(own, F.col("parts")).cast("int"))
    dealt = dealt.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    role = F.when(F.col("part") == F.col("own"), F.col("role")).otherwise(1).cast("tinyint")
    return dealt.withColumn("role", role).drop("hot", "parts", "own")


def compared(group: np.ndarray, role: np.ndarray, close):
    """Positions (rows, homes) of one group for which `close` holds, a bounded number of comparisons at a time.

    Rows are sorted by group and, in it, homes first.
    """
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[starts, len(group)])
    homes = np.add.reduceat((role == 0).astype(np.int64), starts)
    first, many = np.repeat(starts, sizes), np.repeat(homes, sizes)
    ends, i = np.cumsum(many), 0
    while i < len(group):
        done = ends[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(ends, done + AT_ONCE, side="right")))
        row = np.repeat(np.arange(i, j), many[i:j])
        home = np.arange(len(row)) - np.repeat(ends[i:j] - many[i:j] - done, many[i:j]) + np.repeat(first[i:j], many[i:j])
        hit = close(row, home) & (row != home)
        yield row[hit], home[hit]
        i = j


def near(group: np.ndarray, role: np.ndarray, fp: np.ndarray, bits: int):
    """Positions (rows, homes) within `bits`."""
    return compared(group, role, lambda x, y: np.bitwise_count(fp[x] ^ fp[y]) <= bits)


def met(rows: DataFrame, limit: int, pairs, found, schema: str) -> DataFrame:
    """What `found(columns, chunks of (rows, homes))` yields of the pairs that `pairs(columns, group)` finds at the anchors.

    Rows stream through a task in order of anchors, homes first: a block of them is held, and the homes of its last anchor.
    """
    names = [c.split()[0] for c in schema.split(", ")]
    rows = split_hot(rows, limit)
    rows = rows.repartition("anchor", "part").sortWithinPartitions("anchor", "part", "role")

    def blocks(batches):
        some, size = [], 0
        for b in batches:
            some.append(b)
            size += b.num_rows
            if size >= HELD_ROWS:
                yield pa.Table.from_batches(some)
                some, size = [], 0
        if size:
            yield pa.Table.from_batches(some)

    def run(batches):
        left = None  # homes of the last anchor so far
        for block in blocks(batches):
            now = {c: block.column(c).to_numpy() for c in block.schema.names}
            if left is not None and left["anchor"][0] == now["anchor"][0] and left["part"][0] == now["part"][0]:
                now = {c: np.concatenate([left[c], x]) for c, x in now.items()}
            anchor, part = now["anchor"], now["part"]
            group = np.cumsum(np.r_[0, (anchor[1:] != anchor[:-1]) | (part[1:] != part[:-1])])
            for out in found(now, pairs(now, group)):
                yield pa.RecordBatch.from_pydict(dict(zip(names, out, strict=True)))
            last = (group == group[-1]) & (now["role"] == 0)
            left = {c: v[last] for c, v in now.items()} if last.any() else None

    return rows.mapInArrow(run, schema)


def links(fps: DataFrame, bits: int, limit: int = HOT_ROWS) -> DataFrame:
    """(a, b) between the representatives of distinct fingerprints: all that lie within `bits` are connected by these."""

    def found(now, chunks):
        a = b = np.empty(0, dtype=np.int64)
        for x, y in chunks:
            a, b = forest(np.concatenate([a, now["rep"][x]]), np.concatenate([b, now["rep"][y]]))
        yield a, b

    def pairs(now, group):
        return near(group, now["role"], now["fp"].view(np.uint64), bits)

    return met(at_anchors(fps.select("fp", "rep"), bits), limit, pairs, found, "a long, b long")


def grouped(prints: DataFrame, bits: int, limit: int = HOT_ROWS) -> DataFrame:
    """(fp, component): the smallest id reachable over links within `bits`, for every fingerprint that some id has."""
    fps = materialize(prints.where("id IS NOT NULL").groupBy("fp").agg(F.min("id").alias("rep")))
    roots = components(links(fps, bits, limit))
    joined = fps.join(roots, F.col("rep") == F.col("node"), "left")
    return materialize(joined.select(F.col("fp").alias("of"), F.coalesce("root", "rep").alias("component")))


def near_groups(df: DataFrame, key: str = "doc_id", text: str = "text", size: int | None = 3, bits: int = 3) -> DataFrame:
    """(id, fp, component) of every row."""
    prints = materialize(fingerprints(df, key, text, size))
    groups = grouped(prints, bits)
    joined = prints.join(groups, F.col("fp") == F.col("of"), "left")
    return joined.select("id", "fp", F.when(F.col("id").isNotNull(), F.col("component")).alias("component"))


#: The near-duplicate stage: words in a shingle, and similarity from which texts are near-duplicates.
SHINGLE, SIMILARITY = 5, 0.8
#: One text in so many is looked at for common shingles, times one must occur in them, and bits of the
#: filter at least and at most (32 MB), as powers of two. These steer only the work.
LOOKED_AT, COMMON, LEAST_BITS, MOST_BITS = 4, 4, 12, 28
#: Parities by which pairs are ruled out, a multiple of 8.
PARITIES = 1024
#: Columns of a quarter as many parities, which go with every meeting.
SHORT = ("o0", "o1", "o2", "o3")
#: Rounds that test the strongest candidates only, before all that are left are tested.
FOREST_ROUNDS = 3
#: Candidates that a set takes in such a round.
NEAREST = 6


def least_shared(n, share: float):
    """Smallest whole number that is `share` of n at least; rounding errors lower it."""
    return np.ceil(share * n - 1e-9).astype(np.int64)


def distinct_shingles(text: bytes, size: int) -> np.ndarray:
    """Distinct 64-bit hashes of the shingles, in order."""
    return np.unique(shingle_hashes(text.lower().split(), size).astype(np.uint64)).view(np.int64)


def parities(found: np.ndarray) -> bytes:
    """A bit for each part of the hashes: whether an odd number of them is there."""
    return np.packbits(np.bincount((found & (PARITIES - 1)), minlength=PARITIES) & 1).tobytes()


def common_shingles(df: DataFrame, key: str, text: str, size: int) -> tuple[np.ndarray, int]:
    """Bits of the buckets whose shingles many texts have, and their number as a power of two.

    One text in `LOOKED_AT` is counted whatever the size of the table, so that a shingle of some 16 texts is common. Only
    where their shingles are more than the bits is it one in more.
    """
    chars = df.agg(F.sum(F.length(text).cast("long"))).first()[0] or 0
    shingles = chars // 6
    share = max(LOOKED_AT, -(-shingles >> MOST_BITS))
    bits = min(max(LEAST_BITS, int(shingles // share).bit_length()), MOST_BITS)
    sample = df.where(F.pmod(F.xxhash64(key), F.lit(share)) == 0)

    def run(batches):
        some, n = [], 0
        for b in batches:
            for t in texts(b.column(0)):
                some.append(distinct_shingles(t, size).view(np.uint64))
                n += len(some[-1])
                if n >= AT_ONCE:
                    yield from buckets.sent(some, bits, COMMON)
                    some, n = [], 0
        if n:
            yield from buckets.sent(some, bits, COMMON)

    return buckets.often(sample.select(text).mapInArrow(run, buckets.SCHEMA), bits, COMMON), bits


def prefixed(df: DataFrame, key: str, text: str, size: int, similarity: float) -> DataFrame:
    """(id, cls, n, sig, odd, *SHORT, keys): hash, size, fingerprint and parities of the set of shingles, and its first shingles in one order of all.

    Common shingles come last in the order. The keys are so many that a similar set, not larger, has one of them.
    """
    tuned(df.sparkSession)
    common = ship(df.sparkSession, common_shingles(df, key, text, size))

    def run(batches):
        flags, bits = common()
        for b in batches:
            cls, n, sig, odd, keys = [], [], [], [], [np.empty(0, np.int64)]
            for t in texts(b.column(1)):
                found = distinct_shingles(t, size)
                cls.append(xxhash.xxh3_64_intdigest(found.tobytes(), SEED))
                n.append(len(found))
                sig.append(fingerprint(found))
                odd.append(parities(found))
                late = buckets.has(flags, found.view(np.uint64), bits)
                found = np.concatenate([found[~late], found[late]])
                keys.append(found[: len(found) - least_shared(len(found), similarity) + 1])
            numbers = [pa.array(np.array(x, dtype=np.uint64).view(np.int64)) for x in (cls, sig)]
            lists = list_array(np.concatenate(keys), [len(k) for k in keys[1:]], pa.int64())
            short = np.bitwise_xor.reduce(np.frombuffer(b"".join(odd), dtype=np.int64).reshape(len(odd), -1, len(SHORT)), axis=1)
            few = [pa.array(np.ascontiguousarray(short[:, k])) for k in range(len(SHORT))]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), numbers[0], pa.array(n, pa.int64()), numbers[1], pa.array(odd, pa.binary()), *few, lists], names=["id", "cls", "n", "sig", "odd", *SHORT, "keys"]
            )

    short = ", ".join(f"{c} long" for c in SHORT)
    return df.select(F.col(key).cast("long"), text).mapInArrow(run, f"id long, cls long, n long, sig long, odd binary, {short}, keys array<long>")


def meetings(classes: DataFrame, similarity: float) -> DataFrame:
    """(anchor, role, cls, n, sig, place) of the keys that several sets have.

    Sets of which one may be similar to the other meet at a key that is at home with the smaller one:
    both share `2 s / (1 + s)` of its size at least, so its first keys without so many are enough.
    """

    def spread(batches):
        for b in batches:
            lists = b.column("keys")
            many = np.diff(lists.offsets.to_numpy())
            at = np.repeat(np.arange(len(many)), many)
            place = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
            columns = {c: b.column(c).to_numpy()[at] for c in ("cls", "n", "sig")}
            home = place <= columns["n"] - least_shared(columns["n"], 2 * similarity / (1 + similarity))
            yield pa.RecordBatch.from_pydict({"anchor": lists.flatten().to_numpy(), "role": (~home).astype(np.int8)} | columns | {"place": place})

    def several(batches):
        last, follows = None, False  # the row that ended the batch before, and if the one before it has its key
        for b in batches:
            now = pa.Table.from_batches([b] if last is None else [last, b]).combine_chunks()
            anchor = now.column("anchor").to_numpy()
            if len(anchor) == 0:
                continue
            same = np.r_[follows, anchor[1:] == anchor[:-1]]
            yield from now.slice(0, len(anchor) - 1).filter(pa.array(same[:-1] | same[1:])).to_batches()
            last, follows = now.slice(len(anchor) - 1).to_batches()[0], bool(same[-1])
        if follows:
            yield last

    schema = "anchor long, role tinyint, cls long, n long, sig long, place long"
    rows = classes.select("cls", "n", "sig", "keys").mapInArrow(spread, schema)
    rows = rows.repartition("anchor").sortWithinPartitions("anchor")
    return rows.mapInArrow(several, schema)


def candidates(rows: DataFrame, similarity: float, whole: bool, limit: int = HOT_ROWS) -> DataFrame:
    """(a, b) pairs of different components that may be similar by their sizes, places and short parities.

    All of them if whole. Else each task gives the strongest ones that connect its components, and of all those each
    set takes its `NEAREST` ones, so that a group costs as many pairs however many tasks hold its keys.
    """

    def pairs(now, group):
        n, place, comp = now["n"], now["place"], now["comp"]

        odd = [now[c].view(np.uint64) for c in SHORT if c in now]

        def close(x, y):
            most = np.minimum(place[x], place[y]) + np.minimum(n[x] - place[x], n[y] - place[y])
            least = least_shared(n[x] + n[y], similarity / (1 + similarity))
            hit = (comp[x] != comp[y]) & (n[x] >= n[y]) & (most >= least)
            at = np.flatnonzero(hit)
            x, y = x[at], y[at]
            differ = sum((np.bitwise_count(o[x] ^ o[y]).astype(np.int64) for o in odd), np.zeros(len(at), dtype=np.int64))
            hit[at] = differ <= n[x] + n[y] - 2 * least[at]
            return hit

        return compared(group, now["role"], close)

    def found(now, chunks):
        kept = tuple(np.empty(0, dtype=np.int64) for _ in "xy")
        for x, y in chunks:
            if whole:
                yield now["cls"][x], now["cls"][y]
                continue
            x, y = (np.concatenate(z) for z in zip(kept, (x, y), strict=True))
            d = np.bitwise_count(now["sig"][x].view(np.uint64) ^ now["sig"][y].view(np.uint64)).astype(np.int64)
            taken = strongest_at(now["comp"][x], now["comp"][y], d)
            kept = x[taken], y[taken]
        if not whole:
            sig = now["sig"].view(np.uint64)
            d = np.bitwise_count(sig[kept[0]] ^ sig[kept[1]]).astype(np.int64)
            yield now["cls"][kept[0]], now["cls"][kept[1]], d

    found = met(rows, limit, pairs, found, "a long, b long" if whole else "a long, b long, d long")
    if not whole:
        both = found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b"), "d")).distinct()
        near = Window.partitionBy("a").orderBy("d", "b")
        found = both.withColumn("no", F.row_number().over(near)).where(F.col("no") <= NEAREST)
    return found.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def shingle_sets(df: DataFrame, text: str, size: int) -> DataFrame:
    """(cls, shingles): distinct 64-bit hashes of the shingles, and their hash."""

    def run(batches):
        for b in batches:
            sets = [distinct_shingles(t, size) for t in texts(b.column(0))]
            cls = np.array([xxhash.xxh3_64_intdigest(x.tobytes(), SEED) for x in sets], dtype=np.uint64).view(np.int64)
            lists = list_array(np.concatenate([np.empty(0, np.int64), *sets]), [len(x) for x in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(cls), lists], names=["cls", "shingles"])

    return df.select(text).mapInArrow(run, "cls long, shingles array<long>")


def possible(pairs: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """The pairs without those whose parities differ in more places than the shingles of similar sets of their sizes do.

    Every place that differs has a shingle that only one of the two has, so no similar pair goes.
    """

    def run(batches):
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(f"odd_{c}").to_pylist()), dtype=np.uint64).reshape(-1, PARITIES // 64) for c in "ab")
            n = b.column("n_a").to_numpy() + b.column("n_b").to_numpy()
            differ = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
            yield b.select(["a", "b"]).filter(pa.array(differ <= n - 2 * least_shared(n, similarity / (1 + similarity))))

    one, two = (classes.select(F.col("cls").alias(f"cls_{x}"), F.col("n").alias(f"n_{x}"), F.col("odd").alias(f"odd_{x}")) for x in "ab")
    both = pairs.join(one, F.col("a") == F.col("cls_a")).join(two, F.col("b") == F.col("cls_b"))
    return both.select("a", "b", "n_a", "n_b", "odd_a", "odd_b").mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, classes: DataFrame, df: DataFrame, key: str, text: str, size: int, similarity: float) -> DataFrame:
    """(a, b, good): whether the similarity of a pair, taken exactly, is large enough."""
    ends = pairs.select(F.col("a").alias("end")).unionByName(pairs.select(F.col("b").alias("end"))).distinct()
    ends = materialize(classes.join(ends, F.col("cls") == F.col("end"), "left_semi").select("cls", "rep"))
    n = ends.count()
    of_ends = df.join(small(ends.select("rep").distinct(), n), F.col(key) == F.col("rep"), "left_semi")
    sets = materialize(shingle_sets(of_ends, text, size).dropDuplicates(["cls"]))
    one, two = (sets.select(F.col("cls").alias(f"cls_{x}"), F.col("shingles").alias(f"s_{x}")) for x in "ab")
    both = pairs.join(one, F.col("a") == F.col("cls_a")).join(two, F.col("b") == F.col("cls_b"))
    shared = F.size(F.array_intersect("s_a", "s_b"))
    both = materialize(both.select("a", "b", (shared >= similarity * (F.size("s_a") + F.size("s_b") - shared)).alias("good")))
    drop_table(sets)
    drop_table(ends)
    return both


def linked(rows: DataFrame, classes: DataFrame, df: DataFrame, key: str, text: str, size: int, similarity: float) -> DataFrame:
    """(node, root) of the classes that similar pairs connect.

    Rounds test the strongest candidates between components and merge what passed, so that a dense group costs few pairs;
    the last round tests all that are left between components.
    """
    roots = tested = None
    rounds, whole = 0, False
    while True:
        # keys whose texts are all in one component give no pair; rows are only read, never stored anew
        if roots is None:
            here = rows.withColumn("comp", F.col("cls"))
        else:
            here = rows.join(small(roots, roots.count()), F.col("cls") == F.col("node"), "left")
            here = here.withColumn("comp", F.coalesce("root", "cls")).drop("node", "root")
        pairs = candidates(here, similarity, whole)
        if tested is not None:
            done = tested.select(F.col("a").alias("done_a"), F.col("b").alias("done_b"))
            pairs = pairs.join(done, (F.col("a") == F.col("done_a")) & (F.col("b") == F.col("done_b")), "left_anti")
        pairs = materialize(possible(pairs, classes, similarity))
        passed = 0
        if not pairs.isEmpty():
            now = verified(pairs, classes, df, key, text, size, similarity)
            passed = now.where("good").count()
            tested = now if tested is None else tested.unionByName(now)
        if passed or roots is None:
            roots = components((pairs.withColumn("good", F.lit(False)) if tested is None else tested).where("good").select("a", "b"))
        if whole:
            return roots
        rounds += 1
        whole = not passed or rounds == FOREST_ROUNDS


def same_text_groups(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(id, component) of texts in groups of near-duplicates: connected by a Jaccard similarity of their shingle sets.

    Texts with equal sets are one class. Classes are candidates if they share one of their first shingles, which all
    that are similar enough do. Every candidate pair either has its similarity taken exactly or is already connected.
    """
    prints = materialize(prefixed(df.where(F.col(key).isNotNull()), key, text, size, similarity))
    firsts = [F.first(c).alias(c) for c in ("n", "sig", "keys")]
    classes = materialize(prints.groupBy("cls").agg(F.min("id").alias("rep"), *[F.first(c).alias(c) for c in ("n", "odd", *SHORT)]))
    short = classes.select(F.col("cls").alias("of"), *SHORT)
    met = meetings(prints.groupBy("cls").agg(*firsts), similarity)
    rows = materialize(met.join(short, F.col("cls") == F.col("of")).drop("of"))
    roots = linked(rows, classes, df, key, text, size, similarity)
    drop_table(rows)
    member = classes.join(roots, F.col("cls") == F.col("node"), "left").withColumn("root", F.coalesce("root", "cls"))
    member = materialize(member.select("cls", "root", "rep"))
    least = member.groupBy("root").agg(F.min("rep").alias("component"))
    known = materialize(member.join(least, "root").select(F.col("cls").alias("of"), "component"))
    return prints.join(known, F.col("cls") == F.col("of")).select("id", "component")


def first_of_groups(df: DataFrame, key: str = "doc_id", text: str = "text", size: int | None = 3, bits: int = 3) -> DataFrame:
    """The rows of which one text of each group that `near_groups` links by fingerprints stays, the one with the smallest id.

    Rows of one id are one document; rows with a null id stay.
    """
    groups, name = near_groups(df.select(key, text), key, text, size, bits), fresh(df, "gone")
    gone = groups.where("component < id").select(F.col("id").alias(name)).distinct()
    return df.join(materialize(gone), F.col(key) == F.col(name), "left_anti")


def deduplicated(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of which one text of each group of near-duplicates stays, the one with the smallest id.

    Rows of one id are one document; rows with a null id stay.
    """
    groups, name = same_text_groups(df.select(key, text), key, text), fresh(df, "gone")
    gone = groups.groupBy("id").agg(F.min("component").alias("c")).where("c < id").select(F.col("id").alias(name))
    return df.join(materialize(gone), F.col(key) == F.col(name), "left_anti")
