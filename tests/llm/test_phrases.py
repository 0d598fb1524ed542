"""Phrases by ROLLUP over padded windows against a plain count of all n-grams."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from factorlake.llm import buckets
from factorlake.llm import phrases as P

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least, top):
    """Rows (lang, rank, phrase, a, l, r, n, score) from (text, lang)."""
    counts, words = {}, Counter()
    for text, lang in rows:
        mine = counts.setdefault(lang or "und", Counter())
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", (text or "").translate(FOLD)):
            ws = re.findall(r"[^ \t]+", piece)
            words[lang or "und"] += len(ws)
            for i in range(len(ws)):
                for k in range(1, 5):
                    if i + k <= len(ws):
                        mine[tuple(ws[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        often = {g: n for g, n in f.items() if n >= least}
        kept = []
        for g, a in often.items():
            if len(g) == 1:
                continue
            if any(len(h) > len(g) and any(h[i : i + len(g)] == g for i in range(len(h))) and 100 * b >= 80 * a for h, b in often.items()):
                continue
            score, k = min((2_000_000 * a // (f[g[:k]] + f[g[k:]]), k) for k in range(1, len(g)))
            kept.append((-score, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        for rank, (s, a, phrase, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, words[lang], -s))
    return sorted(out)


def mined(spark, rows, **how):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "text string, lang string, size int, words string")
    return sorted(tuple(r) for r in P.collocations(df, **how).collect())


def some_rows(seed, n=120):
    rng = random.Random(seed)
    vocabulary = ["to", "be", "or", "not", "Über", "the", "a", "世界", "x\x00y", "É", "end", "of"]
    rows = []
    for _ in range(n):
        text = ""
        for _ in range(rng.randrange(40)):
            text += rng.choice(["to be or not", "the end of a", rng.choice(vocabulary), rng.choice(vocabulary)]) + rng.choice([" ", "\t", "  ", ", ", ".\n", " \r\n", ";", "\x0b"])
        rows.append((text, rng.choice(["en", "de", None, "und"])))
    return rows


@pytest.mark.parametrize("bits", [P.BITS, 3])
def test_equals_plain_counts(spark, bits, monkeypatch):
    """Also where all buckets of the filter are full, so that no window is padded early."""
    monkeypatch.setattr(P, "LEAST_BITS", min(P.LEAST_BITS, bits))
    rows = some_rows(bits) * 2
    want = plain(rows, 9, 40)
    assert len(want) > 60 and {r[0] for r in want} == {"en", "de", "und"}
    assert mined(spark, rows, least=9, top=40, most_bits=bits) == want


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [(None, "en"), ("", "en"), (" \t", None), ("a b " * 50, "en"), ("x" * 5000 + " y", "en"), ("w " * 3000 + "\x1c", None), ("w", "fr")]
    assert mined(spark, rows, least=3) == plain(rows, 3, 2000)
    assert P.collocations(no_docs).count() == 0
    assert {r.lang for r in P.collocations(odd_docs.drop("rank"), least=2).collect()} >= {"en"}


def test_texts_in_parts(monkeypatch):
    """A text cut into parts gives the tokens of the whole one; the end of a piece at the end of a part too."""
    text = b"one two, three\nfour five.\n\n six seven;eight nine ten " * 40

    def tokens():
        t = P.Tokens()
        t.add("en", text)
        t.add("de", b"last")
        code, lang, heads = t.closed()
        return [x.tolist() for x in (code, lang, *heads[0], *heads[1], *heads[3])]

    whole = tokens()
    assert whole[5][:6] == [True, False, False, True, False, True] and whole[1][-1] == 1
    # pieces of 2, 1, 2, 2 and, over the seam, 5 words
    assert sum(whole[5]) == 1 + 40 + 40 + 39 * 4 + 2 and sum(whole[7]) == 39 * 2
    for size in (1, 7, 13, 100):
        monkeypatch.setattr(P, "SLICE", size)
        assert tokens() == whole


def test_planes():
    x = np.array([0, 1, 70000, 1 << 20], dtype="<u4")
    assert buckets.unplanes(buckets.planes(x), "<u4").tolist() == x.tolist()


def test_large_keys_are_grouped():
    """Columns whose numbers together pass 64 bits."""
    rng = np.random.default_rng(1)
    columns = [rng.integers(0, 3, 500) for _ in range(5)]
    first, n = P.grouped(columns, [1 << 20] * 5)
    want = Counter(zip(*(c.tolist() for c in columns), strict=True))
    assert {tuple(int(c[i]) for c in columns): k for i, k in zip(first, n.tolist(), strict=True)} == want
