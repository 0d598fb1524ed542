"""The automaton against the model's formula, with small buckets and shards."""

import math
import re
import sys
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from factorlake.llm import lm as M
from factorlake.llm.common import held

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [None]


def brute(rows, order, prior):
    """(id, held, n_tokens, n_known, N, base, score) by counting n-grams with their start marks."""
    train = [tokens(t) for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 5 != 1]
    grams = [Counter() for _ in range(order + 1)]
    for words in train:
        for j in range(len(words)):
            for k in range(1, order + 1):
                if j - k + 1 >= -1:
                    grams[k][(("<s>",) if j - k + 1 == -1 else ()) + tuple(words[max(0, j - k + 1) : j + 1])] += 1
    single = {w: c for w, c in grams[1].items() if w != ("<s>",)}
    n, v = sum(single.values()), len(single)
    seen = lambda g: len(train) if g == ("<s>",) else grams[len(g)][g]
    base = lambda w: (single.get((w,), 0) + 0.5) / (n + 0.5 * (v + 1))

    def chance(context, w):
        if not context:
            return base(w)
        return (grams[len(context) + 1][(*context, w)] + prior * chance(context[1:], w)) / (seen(context) + prior)

    out = []
    for i, t in rows:
        words = tokens(t)
        padded = ["<s>", *words]
        score = sum(math.log10(chance(tuple(padded[max(0, j + 2 - order) : j + 1]), w)) for j, w in enumerate(words))
        is_held = i is not None and zlib.crc32(str(i).encode()) % 5 == 1
        out.append((i, is_held, len(words), sum((w,) in single for w in words), n, sum(math.log10(base(w)) for w in words), score))
    return sorted(out, key=str)


def same(got, want):
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a[:5] == b[:5]
        assert a[5:] == pytest.approx(b[5:], rel=1e-9)


def run(df, **options):
    out = M.log_probabilities(df, ~held(1, 5), **options).withColumn("held", held(1, 5, "id"))
    return sorted(((r.id, r.held, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in out.collect()), key=str)


@pytest.mark.parametrize(("order", "bucket", "shard"), [(1, 10_000, 500), (2, 20_000, 300), (2, 6_000_000, 1_000_000), (3, 30_000, 700)])
def test_formula(spark, sf, order, bucket, shard):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(120).cache()
    want = brute([(r.doc_id, r.text) for r in docs.collect()], order, M.PRIOR)
    same(run(docs, order=order, bucket_chars=bucket, shard_keys=shard), want)


def test_packed_counts():
    counts = np.array([0, 1, 254, 255, 256, 1 << 40, 3])
    assert M.unpacked(M.packed(counts), len(counts)).tolist() == counts.tolist()
    assert len(M.packed(counts)) == 7 + 3 * 8


def test_odd_rows(spark, odd_docs, no_docs):
    same(run(odd_docs), brute([(r.doc_id, r.text) for r in odd_docs.collect()], 2, M.PRIOR))
    assert run(no_docs) == []
    none = spark.createDataFrame([(next(i for i in range(99) if zlib.crc32(str(i).encode()) % 5 == 1), "only held out")], "doc_id long, text string")
    (row,) = run(none)
    assert row[3:5] == (0, 0) and row[5] == pytest.approx(0.0)


@pytest.mark.parametrize("order", [1, 3, 4])
def test_odd_rows_of_other_orders(spark, odd_docs, order):
    same(run(odd_docs, order=order), brute([(r.doc_id, r.text) for r in odd_docs.collect()], order, M.PRIOR))


def scores(texts, order):
    """Score of each text by a model of all of them, without Spark."""
    counted = M.Counted(pa.array(texts), np.ones(len(texts), dtype=bool), order)
    single = counted.counts[0]
    automaton = M.Automaton(counted, counted.counts, int(single.sum()), int((single > 0).sum()), M.PRIOR)
    return np.add.reduceat(automaton.walk(), counted.begins).tolist()


@pytest.mark.parametrize("order", [1, 2, 3])
def test_python_steps_follow_the_words_not_the_tokens(order):
    """A bucket with more tokens of the same words takes no more lines of Python."""

    def lines(texts):
        count = 0

        def tracer(frame, event, arg):
            nonlocal count
            if frame.f_globals.get("__name__") != M.__name__:
                return None
            count += event == "line"
            return tracer

        old = sys.gettrace()
        sys.settrace(tracer)
        try:
            scores(texts, order)
        finally:
            sys.settrace(old)
        return count

    texts = ["a b c a b d ", " b  a\tC\n", "", "d " * 40]
    scores(texts, order)
    assert lines(texts * 50) == lines([t * 7 for t in texts] * 50) == lines(texts)


def test_texts_of_a_bucket_do_not_touch():
    """The state of a text is lost at its end: two texts score as they do in the other order."""
    one, two, three = scores(["a b a", "b a b b", ""], 3)
    assert scores(["", "b a b b", "a b a"], 3) == pytest.approx([three, two, one], rel=1e-12)
