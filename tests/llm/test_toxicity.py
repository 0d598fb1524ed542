"""Held-out ranking, language thresholds, pooling, and odd rows."""

import numpy as np

from factorlake.llm import toxicity as T
from factorlake.llm.common import held

SF = "/root/testdata/sf0.01"


def test_pooling():
    values, where = T.pooled(np.array([[1.0, -1], [5, -2], [3, -3], [4, -1]]))
    assert values.tolist() == [[5, 0], [3, 0]] and where.tolist() == [[1, -1], [2, -1]]
    values, where = T.pooled(np.array([[2.0]]))
    assert values.tolist() == [[2], [0]] and where.tolist() == [[0], [-1]]


def test_scorer_forgets_without_harm(monkeypatch):
    rows = [(i % 2, ("good words here " if i % 2 else "other things there ") * 3 + f"w{i}", "en") for i in range(60)]
    net = T.fit_rows(rows)
    texts = [f"good w{i} other x{i} things".encode() for i in range(50)]
    whole = [T.Scorer(net).score(t) for t in texts]
    monkeypatch.setattr(T, "REMEMBERED", 4)
    scorer = T.Scorer(net)
    assert np.allclose([scorer.score(t) for t in texts], whole)


def test_best_cut():
    x, y = np.array([5.0, 4, 3, 2, 1]), np.array([1, 1, 0, 0, 0])
    assert 3 < T.best_cut(x, y) < 4


def test_held_out(spark, odd_docs, no_docs, no_labels):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    net = T.fit(docs, labels, where=~held(1, 3))
    rest = T.scored(docs.join(labels.where(held(1, 3)), "doc_id"), net).select("toxic", "score").collect()
    order = np.argsort([-r.score for r in rest])
    hits = np.array([rest[i].toxic for i in order])
    precision = np.cumsum(hits) / np.arange(1, len(hits) + 1)
    assert precision[hits == 1].mean() > 0.75
    odd = T.scored(odd_docs, net, name="chance").collect()
    assert len(odd) == odd_docs.count() and all(0 <= r.chance <= 1 for r in odd)
    same = [r.chance for r in odd if not (r.text or "").split()]
    assert max(same) - min(same) < 1e-9
    assert T.scored(no_docs, net).count() == 0
    assert T.fit(docs, no_labels) is None
    assert {r.score for r in T.scored(odd_docs, None).collect()} == {0.0}


def test_fewer_labels_than_languages(spark):
    rows = [(i % 2, "bad word" if i % 2 else "good word", None) for i in range(10)]
    assert 0 <= T.Scorer(T.fit_rows(rows)).score(b"bad") <= 1
