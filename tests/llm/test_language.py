"""Hyperdimensional profiles: bundles against plain sums, held-out accuracy, odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from factorlake.llm import language as L
from factorlake.llm.common import held


def plain(text, size, gram=3):
    """Sum of bound n-gram vectors, one position after another."""
    letters = [ord(c) if c.isalpha() else 0 for c in text.lower()]
    code = [0]
    for c in [*letters, 0]:
        if c or code[-1]:
            code.append(c)
    total = np.zeros(size)
    for i in range(len(code) - gram + 1):
        v = np.ones(size)
        for k in range(gram):
            v = v * np.roll(L.letter_vector(code[i + gram - 1 - k], size), k)
        total += v
    return total


@pytest.mark.parametrize("text", ["a", "Ab c", " one, two  three!", "Ünïcode ß 世界 x", "1 2 a 3 4"])
def test_bundle_is_the_plain_sum(text):
    assert np.allclose(L.Profiles(64).bundle(text), plain(text, 64))


@pytest.mark.parametrize("part", [1, 2, 3, 5, 8])
def test_texts_in_parts(part, monkeypatch):
    text = "  one two,, three  4 five \n six.  "
    whole = L.Profiles(32).bundle(text)
    monkeypatch.setattr(L, "PART", part)
    assert np.allclose(L.Profiles(32).bundle(text), whole)


def test_few_remembered(monkeypatch):
    text = "the quick brown fox jumps over the lazy dog"
    whole = L.Profiles(32).bundle(text)
    monkeypatch.setattr(L, "REMEMBERED", 5)
    own = L.Profiles(32)
    assert np.allclose(own.bundle(text), whole) and np.allclose(own.bundle(text), whole) and len(own.rows) <= 5


def test_no_letter():
    own = L.Profiles(32)
    assert all(own.bundle(t) is None for t in (None, "", " ", "12 3\n", "!?", "\x00"))


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = L.fit(docs, where=~held(2, 4), most=60)
    assert model[0] == ["de", "en", "es", "fr"] and np.allclose((model[1] ** 2).sum(axis=1), 1)
    done = L.predicted(docs.where(held(2, 4)), model)
    rows = done.select("lang", F.col("language.lang").alias("got"), "language.score").collect()
    assert sum(r.lang == r.got for r in rows) >= 0.97 * len(rows) and all(0 <= r.score <= 1 for r in rows)


def test_fit_does_not_depend_on_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    a, b = L.fit(docs.repartition(1), size=128), L.fit(docs.repartition(7), size=128)
    assert a[0] == b[0] and np.array_equal(a[1], b[1])


def test_odd_rows(spark, odd_docs, no_docs):
    model = L.fit(odd_docs)
    assert model[0] == ["de", "en"]
    done = L.predicted(odd_docs, model, name="id2")
    assert done.columns == [*odd_docs.columns, "id2"]
    for r in done.select("text", "id2.*").collect():
        if r.text is None or not any(c.isalpha() for c in r.text):
            assert (r.lang, r.score) == (L.UNKNOWN, 0.0)
        else:
            assert r.lang in ("de", "en") and 0 <= r.score <= 1
    none = L.fit(no_docs)
    assert none[0] == [] and L.predicted(no_docs, model).count() == 0
    assert {tuple(r) for r in L.predicted(odd_docs, none).select("language.*").collect()} == {(L.UNKNOWN, 0.0)}
