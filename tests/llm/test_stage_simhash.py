"""The near-duplicate stage goes by SimHash fingerprints, held against brute force."""

import random

import corpus_pipeline as P
import xxhash


def brute_print(text):
    words = (text or "").encode().lower().split()
    size = min(3, len(words))
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + size]), 42) for i in range(len(words) - size + 1)] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_stage_keeps_the_first_of_linked_fingerprints(spark):
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(900)]
    texts = [None, "", "!", "a b", "A  b"]
    for _ in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(60, 400))]
        texts.append(" ".join(words))
        for _ in range(rng.randint(0, 3)):
            copy = list(words)
            for _ in range(rng.randint(0, 6)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
    prints = [brute_print(t) for t in texts]
    root = list(range(len(texts)))
    for _ in texts:
        for i, p in enumerate(prints):
            root[i] = min(root[j] for j, q in enumerate(prints) if (p ^ q).bit_count() <= 3)
    near = sum(0 < (p ^ q).bit_count() <= 3 for i, p in enumerate(prints) for q in prints[:i])
    assert near > 10
    df = spark.createDataFrame([*enumerate(texts), (None, texts[5])], "doc_id long, text string")
    out = P.simhash_dedup(spark, df, "")
    assert out.columns == df.columns
    ids = [r.doc_id for r in out.collect()]
    assert None in ids and sorted(i for i in ids if i is not None) == [i for i, r in enumerate(root) if r == i]
    odd = spark.createDataFrame([(5, "x y z", 1, 2, 3, 4), (7, "X y  z", 1, 2, 3, 4)], "doc_id long, text string, gone int, fp int, component int, of int")
    assert [tuple(r) for r in P.simhash_dedup(spark, odd, "").collect()] == [(5, "x y z", 1, 2, 3, 4)]
