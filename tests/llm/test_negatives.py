"""Shared lists against all products."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from factorlake.llm import negatives as N


def plain(rows, positives=5, negatives=5, low=80):
    """rows: (id, vector, label), one of each id."""
    ok = [(i, [int(np.floor(256 * x)) for x in v], y) for i, v, y in rows
          if i is not None and v is not None and y is not None and all(x is not None and np.isfinite(x) for x in v)]
    ok = [r for r in ok if sum(x * x for x in r[1]) < 1 << 60]
    out = []
    for a in ok:
        if a[0] % 10:
            continue
        scored = [(-sum(x * y for x, y in zip(a[1], b[1], strict=True)), b[0], b[2]) for b in ok if b[0] != a[0] and len(b[1]) == len(a[1])]
        scored.sort()
        for p, i, _ in [s for s in scored if s[2] == a[2]][:positives]:
            fits = [s for s in scored if s[2] != a[2] and low * -p <= 100 * -s[0] <= 100 * -p]
            out += [(a[0], i, r, s[1], -p, -s[0]) for r, s in enumerate(fits[:negatives], 1)]
    return sorted(out)


def mined(spark, rows, **how):
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], "vec_id long, embedding array<double>, label int, id int, cluster string")
    return sorted(tuple(r) for r in N.hard_negatives(df, F.col("id") % 10 == 0, **how).collect())


def clustered(n, size, labels, seed, scale=1.0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(9, size))
    out = []
    for i in range(n):
        v = centres[rng.integers(9)] * rng.uniform(0.2, 2) + rng.normal(size=size) * rng.choice([0.0, 0.05, 0.6])
        out.append((i, (v * scale).tolist(), int(min(rng.integers(labels), rng.integers(labels)))))
    return out


@pytest.mark.parametrize(("size", "labels", "centres", "part", "scale"), [(6, 4, 128, 1 << 21, 1.0), (8, 3, 5, 160, 1.0), (3, 90, 9, 60, 1.0), (4, 2, 4, 100, 1e4), (4, 2, 4, 100, 1e6)])
def test_equals_all_products(spark, size, labels, centres, part, scale):
    rows = clustered(300, size, labels, size + labels, scale)
    rows += [(1000 + i, rows[i][1], rows[i][2]) for i in range(40)] + [(2000 + i, [0.0] * size, i % 3) for i in range(12)]
    want = plain(rows)
    assert len(want) > 100
    assert mined(spark, rows, centres=centres, members=4, part=part) == want


def test_walk_ends_early_and_keeps_all(monkeypatch):
    """Short stretches: a member stops where what follows is certainly worse, and loses nothing."""
    monkeypatch.setattr(N, "STRETCH", 4)
    monkeypatch.setattr(N, "LONGEST", 8)
    rng = np.random.default_rng(3)
    q = np.concatenate([rng.integers(-20, 20, (50, 4)) + [500, 0, 0, 0], rng.integers(-20, 20, (400, 4)) + [0, 300, 0, 0]])
    part = N.Part((4, 0, 0, 0))
    import pyarrow as pa

    part.homes(pa.RecordBatch.from_arrays([pa.array(N.packed(q)), pa.array(np.arange(450)), pa.array([1] * 450)], names=["q", "id", "label"]))
    part.close(4)
    u = np.array([[256, 5, 0, 0], [256, -9, 3, 0]])
    part.sort_for(0, 0.05, np.array([1.0, 0, 0, 0]))
    got = N.walk(part, u, N.lengths(u), np.array([-1, -2]), np.array([0, 0]), True, np.array([0, 1]), np.full(2, N.HIGHEST), np.full(2, -N.HIGHEST), 5)
    want = [(s, int(i), int(score[i])) for s, score in enumerate(u @ q.T) for i in np.lexsort((np.arange(450), -score))[:5]]
    assert list(zip(*(x.tolist() for x in got), strict=True)) == want
    assert sum(len(x) for x in part.listed.values()) < 100


def test_packed_rows():
    q = np.array([[1, -127], [300, 0], [1 << 20, 1], [-(1 << 29), 5], [1 << 40, -1]])
    assert np.array_equal(N.unpacked(N.packed(q), 2), q) and [len(x) for x in N.packed(q)] == [2, 4, 8, 8, 16]
    assert N.unpacked(N.packed(q[:, :0]), 0).shape == (5, 0)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (1, [0.9, 0.1], 1), (2, [0.8, 0.0], 2), (3, None, 1), (4, [nan, 1.0], 2), (5, [inf, 1.0], 2), (6, [None, 1.0], 2), (7, [1.0, 0.0], None),
            (8, [0.85, 0.0, 0.0], 2), (9, [], 2), (10, [], 1), (20, [], 1), (None, [0.85, 0.0], 2), (11, [1e300, 0.0], 2), (12, [0.8, 0.0], 2), (30, [-1.0, 0.0], 2), (31, [-0.9, 0.0], 2), (32, [1.0, 0.5], 3)]
    want = plain(rows)
    assert want and mined(spark, rows) == want
    # of rows with one id the first by label and vector counts; equal rows are one
    assert mined(spark, [*rows, rows[1], rows[2], (12, [0.7, 0.0], 5), (2, [0.9, 0.0], 2)]) == want
    assert mined(spark, rows[:0]) == [] and mined(spark, rows[1:3]) == []
