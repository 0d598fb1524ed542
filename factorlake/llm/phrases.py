"""Phrase collocations: only the longest windows are counted, ROLLUP gives all shorter phrases.

A text is cut into pieces, and every word of a piece leads one window of `LONGEST` words: the word
and the next ones as lead columns, padded with nulls at the end of the piece. Windows are the only
n-grams that are ever made. `ROLLUP (lang, w1, w2, w3, w4)` over their counts sums all windows with
an equal beginning, so its levels hold the counts of phrases of 4, 3, 2 and 1 words, and the words
of a language: a phrase occurs as often as windows begin with it.

A phrase counts only if it occurs `least` times, then so do all its parts. A first pass hashes the
beginnings of every window into buckets, of which one bit each is kept; a beginning in a
bucket below `least` is certainly rarer. A window is padded behind its longest beginning that may
occur often enough, which changes no count that reaches `least`, and makes windows alike, so that a task sends
few rows. The bits are broadcast; they number 2^`BITS` at most whatever the size. Where there are so many words that
all buckets are full, windows stay whole and the results are the same.

Defined results: a null text is empty, a null language `und`. Each row is a text of its own, also
rows with equal ids. Without words, or without a phrase that occurs often enough, the result is empty.
"""

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize, small
from . import buckets
from .common import texts, tuned

LONGEST = 4
LEAST = 30
TOP = 2000
#: Share in percent of a phrase's occurrences that a longer one must have to replace it.
INSIDE = 80
NO_LANG = "und"
#: Lower-cases A-Z and makes every end of a piece a line end.
FOLDED = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 9)
BREAK = re.compile(rb"[ \t\n]")
#: Tokens that a task counts at once, and bytes of a text that are cut into words at once.
TOKENS, SLICE = 1_000_000, 1 << 20
#: Bits of the filter at least and at most (64 MB), as powers of two.
LEAST_BITS, BITS = 16, 29
MIX, STEP = np.uint64(0xD6E8FEB86659FD93), np.uint64(0x9E3779B97F4A7C15)


class Words(dict):
    """Numbers of words in the order in which they came, and their hashes."""

    def __init__(self):
        super().__init__()
        self.hashes: list[int] = []

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        self.hashes.append(xxhash.xxh64_intdigest(word))
        return n


def slices(text: bytes):
    """Parts of a text that end behind a blank or line end."""
    at = 0
    while at < len(text):
        end = BREAK.search(text, min(at + SLICE, len(text)))
        end = end.end() if end else len(text)
        yield text[at:end]
        at = end


class Tokens:
    """Words of some texts one after another: number, whether it ends its piece, number of its language."""

    def __init__(self):
        self.words, self.langs = Words(), {}
        self.codes, self.ends, self.owners, self.size = [], [], [], 0

    def add(self, lang: str, text: bytes) -> None:
        before = self.size
        for part in slices(text.translate(FOLDED)):
            out: list[bytes] = []
            ends = []
            *closed, rest = part.split(b"\n")
            for piece in closed:
                out += piece.split()
                ends.append(len(out))
            out += rest.split()
            self.codes.append(np.fromiter(map(self.words.__getitem__, out), np.int32, len(out)))
            self.ends.append(np.array(ends, dtype=np.int64) + self.size)
            self.size += len(out)
        self.ends.append(np.array([self.size]))
        self.owners.append((self.langs.setdefault(lang, len(self.langs)), self.size - before))

    def closed(self):
        """(code, lang, [(key, whether it ends in the piece) of the next k words]): arrays over all tokens."""
        code = np.concatenate([*self.codes, np.zeros(0, dtype=np.int32)])
        last = np.zeros(self.size + 1, dtype=bool)
        # an end behind no token stands at 0, where nothing is marked
        last[np.concatenate(self.ends)] = True
        last = last[1:]
        lang = np.repeat(np.array([x for x, _ in self.owners], dtype=np.int32), [n for _, n in self.owners])
        of_lang = np.array([xxhash.xxh64_intdigest(x, 1) for x in self.langs], dtype=np.uint64)
        word = np.array(self.words.hashes, dtype=np.uint64)[code] ^ of_lang[lang] if self.size else np.zeros(0, dtype=np.uint64)
        key, inside, heads = mixed(word), np.ones(self.size, dtype=bool), []
        for k in range(LONGEST):
            if k:
                key = mixed(key + STEP + np.roll(word, -k))
                inside = inside & ~np.roll(last, 1 - k)
            heads.append((key, inside))
        return code, lang, heads


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * MIX
    return (x ^ (x >> np.uint64(29))) * MIX


def tokenised(batches):
    """Tokens objects of about a million tokens; a text is never cut between two."""
    now = Tokens()
    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), texts(b.column(1)), strict=True):
            now.add(lang, text)
            if now.size >= TOKENS:
                yield now
                del now
                now = Tokens()
    if now.size:
        yield now


def often_bits(docs: DataFrame, bits: int, least: int) -> np.ndarray:
    """One bit for each bucket: whether its beginnings of windows occur `least` times together."""

    def count(batches):
        for t in tokenised(batches):
            yield from buckets.sent([key[inside] for key, inside in t.closed()[2]], bits, least)

    return buckets.often(docs.mapInArrow(count, buckets.SCHEMA), bits, least)


def grouped(columns: list[np.ndarray], sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(position of one of them, number) of the rows that agree in all columns; sizes bound the columns' numbers."""
    key, bound = columns[0].astype(np.int64), sizes[0]
    for column, size in zip(columns[1:], sizes[1:], strict=True):
        if bound * size >= 1 << 62:
            known, key = np.unique(key, return_inverse=True)
            bound = len(known)
        key, bound = key * size + column, bound * size
    _, first, n = np.unique(key, return_index=True, return_counts=True)
    return first, n


def windows(docs: DataFrame, bits: int, often: np.ndarray) -> DataFrame:
    """(lang, w1 .. w4, c): the windows of a task's tokens, counted; certainly rare ends are padding."""
    names = [f"w{k + 1}" for k in range(LONGEST)]
    shipped = docs.sparkSession.sparkContext.broadcast(often.tobytes())

    def run(batches):
        flags = np.frombuffer(shipped.value, dtype=np.uint8)
        for t in tokenised(batches):
            code, lang, heads = t.closed()
            columns, often = [], None
            for k, (key, inside) in enumerate(heads):
                # the beginning without its first word occurs as often at least
                often = buckets.has(flags, key, bits) & inside & (True if often is None else often & np.roll(often, -1))
                columns.append(np.where(often, np.roll(code, -k), -1))
            del heads, key, inside
            first, n = grouped([lang, *(c + 1 for c in columns)], [len(t.langs), *[len(t.words) + 1] * LONGEST])
            langs, words = pa.array(list(t.langs)), pa.array(list(t.words), pa.binary()).cast(pa.string(), safe=False)
            for i in range(0, len(first), 50_000):
                at = first[i : i + 50_000]
                taken = [words.take(pa.array(np.maximum(c[at], 0), mask=c[at] < 0)) for c in columns]
                yield pa.RecordBatch.from_arrays([langs.take(pa.array(lang[at])), *taken, pa.array(n[i : i + 50_000])], names=["lang", *names, "c"])

    return docs.mapInArrow(run, f"lang string, {', '.join(f'{n} string' for n in names)}, c long")


def phrase_counts(df: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, most_bits: int = BITS) -> DataFrame:
    """(lang, size, words, f): phrases of 1 to 4 words that occur `least` times; size 0 has all words of a language."""
    tuned(df.sparkSession)
    docs = df.select(F.coalesce(F.col(lang).cast("string"), F.lit(NO_LANG)).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # some six bytes a word, and a bucket for every four to eight beginnings
    bytes_ = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    bits = min(max(LEAST_BITS, int(bytes_ // 12).bit_length()), most_bits)
    names = [f"w{k + 1}" for k in range(LONGEST)]
    counted = windows(docs, bits, often_bits(docs, bits, least)).groupBy("lang", *names).agg(F.sum("c").alias("c"))
    sums = counted.rollup("lang", *names).agg(F.sum("c").alias("f"), F.grouping_id().alias("level"))
    # the level of phrases of `size` words has rolled up the columns behind them
    size = F.lit(None).cast("int")
    for k in range(LONGEST, -1, -1):
        whole = F.col("level") == (1 << (LONGEST - k)) - 1
        size = F.when(whole & (F.col(f"w{k}").isNotNull() & (F.col("f") >= least) if k else F.col("lang").isNotNull()), k).otherwise(size)
    words = F.filter(F.array(*names), lambda w: w.isNotNull())
    return sums.select("lang", size.alias("size"), words.alias("words"), "f").where("size IS NOT NULL")


def collocations(df: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, top: int = TOP, inside: int = INSIDE, most_bits: int = BITS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first phrases."""
    found = phrase_counts(df, text, lang, least, most_bits).withColumn("phrase", F.array_join("words", " "))
    found = materialize(found)
    counts = found.where("size > 0").select(F.col("lang").alias("c_lang"), F.col("phrase").alias("c_phrase"), "f")
    cands = found.where("size > 1").select("lang", "size", "words", "phrase", F.col("f").alias("a"))

    def part(start, length):
        return F.array_join(F.slice("words", start, length), " ")

    cuts = cands.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "cut", part(1, F.col("cut")).alias("head"), part(F.col("cut") + 1, F.col("size") - F.col("cut")).alias("tail"))
    cuts = cuts.join(counts, (F.col("lang") == F.col("c_lang")) & (F.col("head") == F.col("c_phrase"))).withColumnRenamed("f", "l").drop("c_lang", "c_phrase")
    cuts = cuts.join(counts, (F.col("lang") == F.col("c_lang")) & (F.col("tail") == F.col("c_phrase"))).withColumnRenamed("f", "r").drop("c_lang", "c_phrase")
    score = F.expr("(CAST(a AS DECIMAL(20, 0)) * 2000000) DIV (CAST(l AS DECIMAL(20, 0)) + r)").cast("long")
    lowest = cuts.groupBy("lang", "phrase").agg(F.min("a").alias("a"), F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("low"))

    # contiguous parts of two words and more of longer candidates
    spans = F.filter(
        F.flatten(F.transform(F.sequence(F.lit(1), F.col("size") - 1), lambda i: F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda n: F.struct(i.alias("i"), n.alias("n"))))),
        lambda s: s["i"] + s["n"] <= F.col("size") + 1,
    )
    longer = cands.where("size > 2").withColumn("span", F.explode(spans))
    longer = longer.select(F.col("lang").alias("c_lang"), F.expr("array_join(slice(words, span.i, span.n), ' ')").alias("c_phrase"), F.col("a").alias("f"))
    longer = longer.groupBy("c_lang", "c_phrase").agg(F.max("f").alias("f"))
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    swallowed = longer.join(cands.select("lang", "phrase", "a"), (F.col("lang") == F.col("c_lang")) & (F.col("phrase") == F.col("c_phrase")))
    swallowed = swallowed.where(wide("f") * 100 >= wide("a") * inside).select("c_lang", "c_phrase")
    kept = lowest.join(swallowed, (F.col("lang") == F.col("c_lang")) & (F.col("phrase") == F.col("c_phrase")), "left_anti")
    kept = kept.select("lang", "phrase", "a", "low.l", "low.r", "low.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    first = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    words = found.where("size = 0").select(F.col("lang").alias("c_lang"), F.col("f").alias("n"))
    first = first.join(small(words, words.count()), F.col("lang") == F.col("c_lang"))
    return first.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
