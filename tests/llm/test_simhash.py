"""Fingerprints, links and components against brute force; the near-duplicate stage against exact similarities."""

import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F
from test_components import roots

from factorlake.llm import simhash as S

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text, size):
    words = WORD.findall(lower(text))
    return [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or ([" ".join(words)] if words else [])


def brute_print(text):
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles(text, 3)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute_components(prints, bits):
    """prints: {id: fingerprint}"""
    ids = sorted(prints)
    links = [(a, b) for a in ids for b in ids if b <= a and (prints[a] ^ prints[b]).bit_count() <= bits]
    return roots(links)


def near_prints(n, seed):
    """Dense clusters: many fingerprints within few bits of each other."""
    rng = random.Random(seed)
    out = {}
    for i in range(n):
        centre = random.Random(rng.randint(0, 5) if i % 3 else i).getrandbits(64)
        for _ in range(rng.randint(0, 5)):
            centre ^= 1 << rng.randint(0, 63)
        out[i] = centre
    return out


def test_every_pair_meets_at_an_anchor():
    rng = np.random.default_rng(2)
    for width in (16, 32):
        code = S.Code(width)
        x = rng.integers(0, 1 << width, 500, dtype=np.uint64)
        homes = dict(enumerate(code.home(x)[0].tolist()))
        assert all(int(x[i] ^ np.uint64(h)).bit_count() <= 1 for i, h in homes.items())
        for flip in [0, *[1 << b for b in range(width)]]:
            at, anchor, _ = code.rows(x ^ np.uint64(flip))
            visits = set(zip(at.tolist(), anchor.tolist(), strict=True))
            assert all((i, h) in visits for i, h in homes.items())


def test_links_equal_brute_force(spark):
    for bits, limit in ((3, 20_000), (3, 40), (7, 60)):
        prints = near_prints(400, bits + limit)
        df = spark.createDataFrame([(i, int(np.uint64(p).view(np.int64))) for i, p in prints.items()], "id long, fp long")
        got = {r.of: r.component for r in S.grouped(df, bits, limit).collect()}
        want = brute_components(prints, bits)
        assert all(got[int(np.uint64(p).view(np.int64))] == want[i] for i, p in prints.items())


def test_blocks_of_rows_change_nothing(monkeypatch):
    prints = near_prints(300, 9)
    fps = np.array(list(prints.values()), dtype=np.uint64)
    group, role = np.zeros(300, dtype=int), (np.arange(300) >= 200).astype(int)
    pairs = lambda: sorted((int(a), int(b)) for x, y in S.near(group, role, fps, 3) for a, b in zip(x, y, strict=True))
    whole = pairs()
    monkeypatch.setattr(S, "AT_ONCE", 1000)
    assert pairs() == whole
    assert whole == [(i, j) for i in range(300) for j in range(200) if i != j and int(fps[i] ^ fps[j]).bit_count() <= 3]


def test_odd_rows(odd_docs, no_docs):
    rows = S.near_groups(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    texts = {}
    for r in odd_docs.collect():
        texts.setdefault(r.doc_id, set()).add(brute_print(r.text))
    for r in rows:
        assert r.fp % (1 << 64) in texts[r.id]
        assert (r.component is None) == (r.id is None)
    zero = {r.component for r in rows if r.fp == 0}
    assert zero == {0}
    assert S.near_groups(no_docs).count() == 0
    assert S.deduplicated(no_docs).count() == 0
    kept = S.deduplicated(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert None in ids and ids.count(0) == 1 and not {1, 2, 3, 4} & set(ids)


def test_stage_equals_exact_similarity(spark):
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(900)]
    docs = []
    for i in range(120):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(60, 400))]
        docs.append(words)
        for _ in range(rng.randint(0, 3)):  # copies with a few words changed
            copy = list(words)
            for _ in range(rng.randint(0, max(1, len(words) // 90))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            docs.append(copy)
    rng.shuffle(docs)
    texts = {i: " ".join(w) for i, w in enumerate(docs)}
    sets = {i: set(shingles(t, 5)) for i, t in texts.items()}
    links = [(a, b) for a in texts for b in texts if b < a and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    gone = {n for n, r in roots(links).items() if n != r}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    kept = {r.doc_id for r in S.deduplicated(df).collect()}
    assert len(gone) > 60
    assert not set(texts) - gone - kept  # nothing else is lost
    assert len(gone & kept) <= 0.02 * len(gone)


def edited(rng, vocabulary, words, share, kind):
    """A copy that keeps about `share` of the similarity: with a passage appended, cut off, or cut out of the middle."""
    if kind == "appended":
        return words + [rng.choice(vocabulary) for _ in range(int(len(words) * (1 / share - 1)))]
    gone = len(words) - int(len(words) * share)
    if kind == "cut off":
        return words[: len(words) - gone]
    at = (len(words) - gone) // 2
    return words[:at] + words[at + gone :]


def test_stage_finds_all_similar_texts(spark):
    rng = random.Random(15)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8))) for _ in range(3000)]
    texts = {}
    for kind in ("appended", "cut off", "middle"):
        for share in (0.8, 0.81, 0.83, 0.85, 0.9, 0.95):
            for _ in range(12):
                words = [rng.choice(vocabulary) for _ in range(rng.choice((12, 60, 100, 200, 400)))]
                for w in (words, edited(rng, vocabulary, words, share, kind)):
                    texts[len(texts)] = " ".join(w)
    sets = {i: set(shingles(t, 5)) for i, t in texts.items()}
    similar = {i for i in texts if i % 2 and len(sets[i] & sets[i - 1]) >= 0.8 * len(sets[i] | sets[i - 1])}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    kept = {r.doc_id for r in S.deduplicated(df).collect()}
    assert len(similar) > 120
    assert kept == set(texts) - similar


def test_stage_tests_pairs_beside_a_path_that_fails(spark):
    """A and B are similar, C lies between them but is similar to neither."""
    rng = random.Random(21)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8))) for _ in range(3000)]
    alike = lambda a, b: len(a & b) / len(a | b)
    texts = {}
    while len(texts) < 180:
        a = [rng.choice(vocabulary) for _ in range(200)]
        edits = {rng.randrange(200): rng.choice(vocabulary) for _ in range(4)}
        own = {rng.randrange(200): rng.choice(vocabulary) for _ in range(rng.randint(1, 4))}
        half = dict(rng.sample(sorted(edits.items()), 2))
        b, c = ([e.get(i, w) for i, w in enumerate(a)] for e in (edits, half | own))
        trio = [" ".join(w) for w in (a, b, c)]
        x, y, z = (set(shingles(t, 5)) for t in trio)
        if alike(x, y) >= 0.8 and 0.76 < alike(x, z) < 0.8 and 0.76 < alike(y, z) < 0.8:
            texts |= {len(texts) + i: t for i, t in enumerate(trio)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id for r in S.deduplicated(df).collect()} == {i for i in texts if i % 3 != 1}


def test_stage_with_graded_copies(spark, monkeypatch):
    monkeypatch.setattr(S, "HELD_ROWS", 50)
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8))) for _ in range(900)]
    start, texts = [rng.choice(vocabulary) for _ in range(90)], []
    for _ in range(160):
        copy = list(start)
        for _ in range(rng.randint(0, 5)):
            copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
        texts.append(" ".join(copy))
    sets = [set(shingles(t, 5)) for t in texts]
    links = [(a, b) for a in range(160) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id for r in S.deduplicated(df).collect()}
    assert kept == set(range(160)) - {n for n, r in roots(links).items() if n != r}


def test_hot_anchors_of_one_fingerprint_are_split(spark):
    rows = spark.createDataFrame([(7, 0, 5, i) for i in range(1000)], "anchor long, role tinyint, fp long, rep long")
    homes = S.split_hot(rows, 100).where("role = 0").groupBy("part").count().collect()
    assert sum(r["count"] for r in homes) == 1000
    assert max(r["count"] for r in homes) < 200


def test_hot_keys_of_the_stage_change_nothing(spark):
    rng = random.Random(3)
    sets = [{rng.randrange(300) for _ in range(8)} for _ in range(200)]
    classes = spark.createDataFrame([(i, len(s), 0, sorted(s)) for i, s in enumerate(sets)], "cls long, n long, sig long, keys array<long>")
    rows = S.meetings(classes, 0.01).withColumn("comp", F.col("cls"))
    found = [{tuple(r) for r in S.candidates(rows, 0.01, True, limit).collect()} for limit in (20_000, 3)]
    assert found[0] == found[1] and len(found[0]) > 1000


def test_parities_rule_out_no_similar_pair(spark):
    rng = np.random.default_rng(6)
    sets, pairs = [], []
    for i in range(0, 600, 2):
        n, lost = int(rng.integers(1, 900)), rng.uniform(0, 0.3)
        a = rng.integers(-(2**62), 2**62, n)
        sets += [a, a[: max(1, int(n * (1 - lost)))]]
        pairs.append((i, i + 1))
    sets, pairs = [*sets, *sets[:2]], [*pairs, (2, 5)]
    classes = spark.createDataFrame([(i, len(x), S.parities(x)) for i, x in enumerate(sets)], "cls long, n long, odd binary")
    left = {tuple(r) for r in S.possible(spark.createDataFrame(pairs, "a long, b long"), classes, 0.8).collect()}
    similar = {(a, b) for a, b in pairs if len(sets[b]) >= 0.8 * len(sets[a]) and b == a + 1}
    assert similar <= left and len(left) < len(pairs)


def test_stage_with_clashing_columns(spark):
    words = " ".join(f"w{i}" for i in range(60))
    rows = [(5, words, 1, "a", 2, 3, 4, 0), (7, words + " more", 1, "b", 2, 3, 4, 0), (9, "other " * 20, 1, "c", 2, 3, 4, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, gone int, rep string, node int, root int, cls int, id int")
    out = S.deduplicated(df)
    assert out.columns == df.columns and sorted(r.doc_id for r in out.collect()) == [5, 9]


def test_common_shingles_come_last(spark):
    """A passage of many texts is common, whatever the size of the table."""
    passage = " ".join(f"p{i}" for i in range(30))
    texts = [(i, f"{passage} " + " ".join(f"x{i}y{j}" for j in range(40))) for i in range(200)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    flags, bits = S.common_shingles(df, "doc_id", "text", 5)
    shared, own = S.distinct_shingles(passage.encode(), 5), S.distinct_shingles(" ".join(f"x7y{j}" for j in range(40)).encode(), 5)
    late = lambda x: S.buckets.has(flags, x.view(np.uint64), bits)
    assert late(shared).all() and late(own).mean() < 0.5
    keys = S.prefixed(df, "doc_id", "text", 5, 0.8)
    assert keys.selectExpr("explode(keys) AS k").where(F.col("k").isin([int(x) for x in shared])).count() == 0


def test_short_parities_rule_out_no_similar_pair(spark):
    """Sets at one key: unlike ones of equal size give no pair, all similar ones do."""
    rng = np.random.default_rng(9)
    sets = []
    for _ in range(60):
        a = np.unique(rng.integers(-(2**62), 2**62, int(rng.integers(50, 350))))
        sets += [a, a[: max(1, int(len(a) * rng.uniform(0.8, 1)))]]
    fold = lambda x: np.bitwise_xor.reduce(np.frombuffer(S.parities(x), dtype=np.int64).reshape(-1, 4), axis=0).tolist()
    rows = spark.createDataFrame([(1, 0, i, len(x), 0, 0, i, *fold(x)) for i, x in enumerate(sets)], "anchor long, role tinyint, cls long, n long, sig long, place long, comp long, o0 long, o1 long, o2 long, o3 long")
    found = {tuple(r) for r in S.candidates(rows, 0.8, True).collect()}
    similar = {(i + 1, i) for i in range(0, len(sets), 2) if len(sets[i + 1]) >= 0.8 * len(sets[i])}
    without = S.candidates(rows.drop("o0", "o1", "o2", "o3"), 0.8, True).count()
    assert similar <= found and len(found) < 0.2 * without
