import random

import numpy as np

from factorlake.llm import components as C


def roots(links):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def test_random_and_long_graphs(spark):
    rng = random.Random(4)
    links = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(260)]
    links += [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5001 + i) for i in range(200)]
    want = {n: r for n, r in roots(links).items() if n != r}
    got = C.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.node: r.root for r in got} == want


def test_no_links(spark):
    assert C.components(spark.createDataFrame([(3, 3)], "a long, b long")).count() == 0


def test_forests_connect_the_same():
    rng = np.random.default_rng(1)
    a, b, d = rng.integers(0, 300, 900), rng.integers(0, 300, 900), rng.integers(0, 9, 900)
    want = roots(zip(a.tolist(), b.tolist(), strict=True))
    for x, y in (C.forest(a, b), C.strongest(a, b, d)[:2]):
        got = roots(zip(x.tolist(), y.tolist(), strict=True))
        assert len(x) < 300 and all(got[n] == r for n, r in want.items() if n in got)
    # the strong forest weighs as little as Kruskal's
    total, parent = 0, list(range(300))
    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for w, i, j in sorted(zip(d.tolist(), a.tolist(), b.tolist(), strict=True)):
        i, j = find(i), find(j)
        if i != j:
            parent[i] = j
            total += w
    assert C.strongest(a, b, d)[2].sum() == total
