"""The metric join against all pairs."""

import numpy as np
import pytest
from test_components import roots

from factorlake.llm import vectors as V


def brute(rows, cosine=0.93):
    ok = [r for r in rows if r[0] is not None and r[1] and r[2] is not None and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])]
    links, count = [], dict.fromkeys(range(len(rows)), 0)
    for i, a in enumerate(ok):
        for b in ok[:i]:
            if a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1], dtype=np.float64), np.array(b[1], dtype=np.float64)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine:
                    links.append((a[0], b[0]))
    n = {}
    for a, b in links:
        n[a], n[b] = n.get(a, 0) + 1, n.get(b, 0) + 1
    return n, roots(links)


def clustered(n, size, labels, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 12, size))
    rows = []
    for i in range(n):
        v = centres[rng.integers(len(centres))] + rng.normal(size=size) * rng.choice([0.02, 0.2, 0.35])
        rows.append((i, [float(np.float32(x)) for x in v * rng.uniform(0.1, 9)], int(rng.integers(labels))))
    return rows


@pytest.mark.parametrize(("pivots", "cell"), [(64, 4000), (7, 20), (40, 5)])
def test_equals_all_pairs(spark, pivots, cell):
    rows = clustered(420, 8, 3, pivots)
    rows += [(900 + i, rows[i][1], rows[i][2]) for i in range(30)]  # exact copies
    count, root = brute(rows)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = V.near_vectors(df, pivots=pivots, cell=cell).collect()
    assert len(got) == len(rows) and sum(count.values()) > 400
    assert {r.id: (r.n_links, r.component) for r in got} == {r[0]: (count.get(r[0], 0), root.get(r[0], r[0])) for r in rows}


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, None, 1), (4, [0.0, 0.0], 1), (5, [nan, 1.0], 1), (6, [inf, 1.0], 1), (7, [None, 1.0], 1),
            (8, [1.0, 0.0], None), (9, [1.0, 0.0, 0.0], 1), (10, [], 1), (None, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (11, [1.0, 0.0], 2), (12, [1e-30, 0.0], 1)]
    df = spark.createDataFrame([(*r, "x", 5) for r in rows], "vec_id long, embedding array<float>, label int, rep string, cell int")
    got = sorted(((r.id, r.n_links, r.component) for r in V.near_vectors(df).collect()), key=str)
    want = {1: (3, 1), 2: (3, 1), 12: (3, 1)}
    assert got == sorted([(r[0], *want.get(r[0], (0, r[0]))) for r in rows], key=str)
    assert V.near_vectors(df.limit(0)).count() == 0
