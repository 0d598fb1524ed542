"""Pieces against the library's ids; windows are full, sequences without gaps or padding."""

import random
import tracemalloc
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from factorlake.llm import packing

WORD = public_tokenizers.path("word_bpe_49k.json")


def check(rows, texts, window):
    """texts: list of (id, text); rows of one id are told apart by their ids' checksum only where ids are unique."""
    library = Tokenizer.from_file(WORD)
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for key, text in texts:
        ids = library.encode(text or "", add_special_tokens=False).ids + [packing.END_ID]
        at = 0
        for r in sorted(pieces[key], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], dtype="<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for some in sequences.values():
        some.sort(key=lambda r: r.offset)
        total = sum(r.length for r in some)
        assert [r.offset for r in some] == np.cumsum([0] + [r.length for r in some[:-1]]).tolist()
        assert total == window or (total < window and total & (total - 1) == 0)


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for window, shard in ((4096, 1_000_000), (64, 3_000)):
        rows = packing.pack(docs, WORD, window=window, shard_tokens=shard).collect()
        check(rows, [(r.doc_id, r.text) for r in docs.collect()], window)


def test_neighbours_share_terms():
    docs = [np.array(x, dtype="<u4").tobytes() for x in ([9, 5, 5, 6], [9, 7, 7], [9, 5, 6], [9, 8], [9, 5])]
    near = packing.Index(docs).neighbours(0, np.array([False, True, True, True, True]))
    assert near[0] == 2 and set(near[:2]) == {2, 4}


def test_odd_rows(odd_docs, no_docs):
    unique = odd_docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).cache()
    check(packing.pack(unique, WORD).collect(), [(r.doc_id, r.text) for r in unique.collect()], 4096)
    rows = packing.pack(odd_docs, WORD).collect()
    assert sum(r.start == 0 for r in rows) == odd_docs.count()
    assert packing.pack(no_docs, WORD).count() == 0


@pytest.mark.parametrize("step", [1, 70_001])
def test_index_numbers_terms_without_sorting_them(step, monkeypatch):
    rng = np.random.default_rng(4)
    docs = [(rng.integers(0, 300, rng.integers(1, 60)) * step).astype("<u4").tobytes() for _ in range(50)]
    sorts, unique = [], np.unique
    monkeypatch.setattr(np, "unique", lambda x, **kw: sorts.append(kw) or unique(x, **kw))
    index = packing.Index(docs)
    ids = [np.frombuffer(d, dtype="<u4") for d in docs]
    terms = unique(np.concatenate(ids))
    assert len(sorts) == 1 and len(index.df) == len(terms)
    for t, term in enumerate(terms):
        holders = [d for d, x in enumerate(ids) if term in x]
        assert index.df[t] == len(holders)
        assert index.posted[index.posted_first[t] : index.posted_first[t + 1]].tolist() == holders


def test_an_occurrence_of_a_word_is_no_object_of_its_own():
    words, rng = packing.WordIds(WORD), random.Random(5)
    kinds = [f"{a}{b}" for a in ("the", "Straße", "añadir,", "l'été", "x1'll") for b in ("", "s", "ung.", "!!")]
    batch = [" ".join(rng.choices(kinds, k=1000)).encode() for _ in range(200)]
    words.encode(batch[:1])
    tracemalloc.start()
    coded = words.encode(batch)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3 * sum(map(len, coded))


@pytest.mark.parametrize("at_once", [1, 300, 1 << 22])
def test_words_equal_library_however_texts_are_taken_together(at_once, monkeypatch):
    monkeypatch.setattr(packing, "AT_ONCE", at_once)
    library, words, rng = Tokenizer.from_file(WORD), packing.WordIds(WORD), random.Random(6)
    bits = ["'s", "'S", "''s", "'s's", "'ss", "5's", "'re", "'rE", "'r", "'ll've", "'", "!'d", "é'm", "ΟΔΟΣ", "Σ", "ʼs", "12", "²", "…", "<|endoftext|>", "\x01", *" \n\t\x0b\x1f\u00a0\u2003"]
    texts = ["", " ", "\n\n", "'", "x", *["".join(rng.choices(bits, k=rng.randint(1, 9))) for _ in range(500)]]
    coded = words.encode([t.encode() for t in texts])
    assert [np.frombuffer(c, dtype="<u4").tolist() for c in coded] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert words.encode([]) == []
