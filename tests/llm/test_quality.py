"""Base numbers against plain Python, decoding against all label sequences, and accuracy on held-out labels."""

import itertools
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from factorlake.llm import quality as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words, seen, dup, inside = WORD.findall(text), set(), 0, set()
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    for i in range(len(words) - 2):
        if windows[tuple(words[i : i + 3])] > 1:
            inside |= {i, i + 1, i + 2}
    failed = len(words) < 50 or 100 * len(inside) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside), failed


def base(row):
    return row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words, row.base_failed


def test_base_numbers(spark, sf, odd_docs, no_docs, no_labels):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for df in (docs, odd_docs):
        got = Q.judged(df, no_labels).select("text", "verdict").collect()
        assert len(got) == df.count()
        assert all(base(r.verdict) == brute(r.text) for r in got)
        assert all(r.verdict.kept == (not r.verdict.base_failed) for r in got)  # nothing learned: all lines are content
    assert Q.judged(no_docs, no_labels).count() == 0
    assert Q.repeated_words([b"ab", b"c"] * 3 + [b"d"]) == 6


def test_viterbi_finds_the_best_labels():
    rng = np.random.default_rng(2)
    field = Q.Field()
    field.weights, field.chain = rng.normal(size=Q.N_WEIGHTS), rng.normal(size=(2, 2))
    n_lines = np.array([3, 1, 7, 2])
    bins = np.stack([rng.integers(0, w, n_lines.sum()) + o for w, o in zip(Q.WIDTHS, Q.OFFSETS, strict=True)], axis=1)
    got, emit, at = field.viterbi(bins, n_lines), field.emissions(bins), 0

    def score(labels, e):
        return sum(x * y for x, y in zip(labels, e, strict=True)) + sum(field.chain[a, b] for a, b in itertools.pairwise(labels))

    for n in n_lines:
        best = max(itertools.product((0, 1), repeat=int(n)), key=lambda labels: score(labels, emit[at : at + n]))  # noqa: B023
        assert got[at : at + n].tolist() == [bool(x) for x in best]
        at += n


def test_marginals_are_exact():
    rng = np.random.default_rng(5)
    field = Q.Field()
    field.chain = rng.normal(size=(2, 2))
    e = rng.normal(size=4)
    weight = {}
    for labels in itertools.product((0, 1), repeat=4):
        weight[labels] = np.exp(sum(x * y for x, y in zip(labels, e, strict=True)) + sum(field.chain[a, b] for a, b in itertools.pairwise(labels)))
    total = sum(weight.values())
    p, moves = field.marginals(e[:, None], np.array([1, 1, 1, 1]))
    assert np.allclose(p[:, 0], [sum(w for x, w in weight.items() if x[i]) / total for i in range(4)])
    want = np.zeros((2, 2))
    for labels, w in weight.items():
        for a, b in itertools.pairwise(labels):
            want[a, b] += w / total
    assert np.allclose(moves, want)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    field = Q.fit(docs, labels.where("doc_id % 2 = 0"))
    rest = docs.join(labels.where("doc_id % 2 = 1"), "doc_id")
    got = rest.withColumn("v", Q.verdict(F.col("text"), field)).where("NOT v.base_failed").select("quality", "v.kept").collect()
    assert np.mean([r.kept for r in got if r.quality == 1]) > 0.97
    assert np.mean([r.kept for r in got if r.quality == 0]) < 0.1
