"""Repeated lines against plain Python."""

import random
import re
import time
from collections import defaultdict

from factorlake.llm import linededup as L

BLANK = " \t\n\x0b\x0c\r"


def key_of(line):
    return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(BLANK))


def brute(rows, min_chars, min_docs):
    """rows: (id, text) -> (id, cleaned, n_lines, n_dropped)"""
    held = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key_of(line)) >= min_chars:
                held[key_of(line)].add(i)
    keeper = {k: max((x for x in ids if x is not None), default=None) for k, ids in held.items() if len(ids) >= min_docs}
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key_of(x) not in keeper or keeper[key_of(x)] == i]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    rng = random.Random(3)
    common = [f"A common line number {i} that many documents share, é" for i in range(12)]
    rows = []
    for i in range(90):
        lines = [rng.choice(common) if rng.random() < 0.4 else f"own line {i} {j} of some length, long enough to count" for j in range(rng.randint(1, 9))]
        lines = [(" \t" if rng.random() < 0.3 else "") + (x.upper() if rng.random() < 0.2 else x) for x in lines] + rng.choice([[], [""], ["short"]])
        rows.append((i, "\n".join(lines)))
    rows += [(90, None), (91, ""), rows[4], (None, common[0]), (rows[7][0], common[1])]
    df = spark.createDataFrame([(*r, "n", 1) for r in rows], "doc_id long, text string, h string, gone int")
    for batches, min_docs in ((4, 5), (1, 2), (9, 3)):
        done = L.drop_repeated(df, min_docs=min_docs, batches=batches)
        assert done.columns == [*df.columns, "n_lines", "n_dropped"]
        got = sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in done.collect()), key=str)
        assert got == brute(rows, 40, min_docs)


def test_odd_rows(odd_docs, no_docs):
    done = L.drop_repeated(odd_docs, min_chars=1, min_docs=2)
    assert done.columns == [*odd_docs.columns, "n_lines", "_n_dropped"]
    got = sorted(((r.doc_id, r.text, r.n_lines, r._n_dropped) for r in done.collect()), key=str)
    assert got == brute([(r.doc_id, r.text) for r in odd_docs.collect()], 1, 2)
    assert L.drop_repeated(no_docs).count() == 0


def test_runs_keep_levels(spark):
    lines = spark.createDataFrame([(i % 7, i) for i in range(70)], "h long, id long")
    runs = {r.h: (r.docs, r.keeper) for r in L.line_runs(lines, batches=5).collect()}
    assert runs == {h: (10, 63 + h) for h in range(7)}


def test_texts_of_many_lines(spark):
    """The time of a text goes with its lines: five texts of 100,000 lines that are all dropped but in one, and a very long line."""
    lines = [f"line number {i} of a text that is longer than forty characters" for i in range(100_000)]
    long_line = "x" * 2_000_000
    rows = [(i, "\n".join(lines)) for i in range(5)] + [(5, "\n".join([*lines[::2], "own line"])), (6, long_line), (7, f"{long_line}\nend")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    start = time.monotonic()
    got = {r.doc_id: r for r in L.drop_repeated(df).collect()}
    assert time.monotonic() - start < 120
    want = {i: (t, n, d) for i, t, n, d in brute(rows, 40, 5)}
    assert {i: (r.text, r.n_lines, r.n_dropped) for i, r in got.items()} == want
