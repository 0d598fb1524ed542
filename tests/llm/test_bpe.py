"""Encoding and decoding against the library, on random odd strings and odd rows."""

import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from factorlake.llm import bpe, packing

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
BITS = (
    "a b the qj zx 's ' '' !'s 't 've 'll 1 23 é è à ß ñ 世界 😀 - !! ... <|endoftext|> <|startoftext|> <| |> K İ ﬁ ² ⅷ Σ of oF".split(" ")
    + [" ", "  ", "   ", "\n", "\n\n", "\t", " \n", " ", "　", " ", "\u0085", "́", "\x1c", "\x0b", "﻿", "\x01", "\x00"]
)


def random_texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(BITS) for _ in range(rng.randint(0, 12))) for _ in range(n)]


def test_byte_codec_equals_library():
    texts, library, codec = random_texts(6000, 1), Tokenizer.from_file(BYTE), bpe.Codec(BYTE)
    for text, coded in zip(texts, codec.encode([t.encode() for t in texts]), strict=True):
        ids = np.frombuffer(coded, dtype="<u4")
        want = library.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == want, repr(text)
        assert codec.decode(ids).decode() == library.decode(want, skip_special_tokens=False)


def test_word_ids_equal_library():
    texts, library, words = random_texts(6000, 2), Tokenizer.from_file(WORD), packing.WordIds(WORD)
    for text, coded in zip(texts, words.encode([t.encode() for t in texts]), strict=True):
        assert np.frombuffer(coded, dtype="<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 20)
    texts = [t.encode() for t in random_texts(400, 3)]
    together, codec = bpe.Codec(BYTE).encode(texts), bpe.Codec(BYTE)
    assert [x for i in range(0, 400, 7) for x in codec.encode(texts[i : i + 7])] == together


def test_cuts_never_stand_inside_a_token():
    codec = bpe.Codec(BYTE)
    for token in codec.bytes_of.values():
        if token not in codec.special:
            assert codec.fragments(token) == [token]


def test_odd_rows(odd_docs, no_docs):
    library = Tokenizer.from_file(BYTE)
    rows = bpe.encode(odd_docs, BYTE, decoded=True).collect()
    assert len(rows) == odd_docs.count()
    want = sorted((str(r.doc_id), library.encode(r.text or "", add_special_tokens=False).ids, r.text or "") for r in odd_docs.collect())
    assert sorted((str(r.doc_id), r.ids, r.decoded) for r in rows) == want
    again = bpe.decode(bpe.encode(odd_docs, BYTE), BYTE).collect()
    assert sorted((str(r.doc_id), r.decoded) for r in again) == [(a, c) for a, _, c in want]
    assert bpe.encode(no_docs, BYTE, decoded=True).count() == 0


def test_replacement_characters(spark):
    lone = spark.createDataFrame([([163],), (None,)], "ids array<int>")
    assert [r.decoded for r in bpe.decode(lone, BYTE).collect()] == [Tokenizer.from_file(BYTE).decode([163], skip_special_tokens=False), None]
