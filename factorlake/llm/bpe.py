"""Byte-pair encoding by forced boundaries, and decoding.

Two neighbouring bytes that stand side by side in no token of the vocabulary can
never be joined by a merge, so a cut between them is certain. Text is cut there,
each fragment is encoded on its own and the ids are put together again. The same
fragments come back all the time, so a worker keeps the ids of those it has seen.

A cut is used only where splitting into words before the merges cannot tell the
difference either:

* the byte before it is no white space, also not the last byte of a longer white
  space character, since a run of white space gives its last character away;
* an apostrophe after the cut follows a letter or digit, since `'s` and the like
  are read as one word only where no other sign stands before them;
* bytes of longer characters are never cut from each other.

Strings of special tokens are taken out first, as the library does. New fragments are encoded
by the ranks of the vocabulary's merges, which its ids follow.

Defined results: null and empty texts give no ids and an empty text; repeated
rows, null ids and further columns do not matter.
"""

import json
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

from .common import list_array, texts, worker_state

#: Distinct fragments that a worker remembers; beyond, it starts again (results stay the same).
REMEMBERED = 400_000

#: Last bytes of the white space characters outside ASCII. Fixed values of Unicode.
WIDE_SPACE_ENDS = [0x85, 0xA0, *range(0x80, 0x8B), 0xA8, 0xA9, 0xAF, 0x9F]

ASCII_SPACE = b" \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f"
#: A space after white space: there the run must stay whole.
SPACE_RUNS = [bytes([x]) + b" " for x in ASCII_SPACE] + [x + b" " for x in (b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80")]
WIDE_RUN = re.compile(rb"\xe2\x80[\x80-\x8a\xa8\xa9\xaf] ")
#: A fragment that may stand on a line of its own.
LINE = re.compile(r" ?\S+").fullmatch


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for.

    Printable bytes stand for themselves, the others follow from code point 256 on.
    """
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Codec:
    """Encoder and decoder of one byte-level vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        letters = byte_letters()
        vocab = {t: i for t, i in spec["model"]["vocab"].items() if i not in self.special.values()}
        self.bytes_of = {i: bytes(letters[c] for c in t) for t, i in vocab.items()}
        self.bytes_of |= {i: t for t, i in self.special.items()}
        merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
        if merged != sorted(merged):
            raise ValueError(f"the ids of {path} do not follow its merges")
        ranks = {self.bytes_of[i]: i for i in vocab.values()}
        self.ranked = tiktoken.Encoding("ranked", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.line_end = ranks[b"\n"]
        self.special_ids = {t: np.array([i], dtype="<u4").tobytes() for t, i in self.special.items()}
        self.cut = self.forced(vocab.values())
        alternatives = b"|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True))
        self.split_special = re.compile(b"(" + alternatives + b")").split if self.special else lambda text: [text]
        self.pieces = [self.bytes_of.get(i, b"") for i in range(max(self.bytes_of) + 1)]
        self.seen: dict[bytes, bytes] = {}
        self.after_space: dict[bytes, bytes] = {}

    def forced(self, ids) -> np.ndarray:
        """Table over (byte, next byte): True where a cut is certain and safe."""
        apart = np.ones((256, 256), dtype=bool)
        for i in ids:
            token = np.frombuffer(self.bytes_of[i], dtype=np.uint8)
            apart[token[:-1], token[1:]] = False
        alnum = [b for b in range(128) if chr(b).isalnum()]
        apart[list(ASCII_SPACE), :] = False
        apart[WIDE_SPACE_ENDS, :] = False
        apart[[b for b in range(256) if b not in alnum], ord("'")] = False
        apart[:, 0x80:] = False
        apart[0x80:, [b for b in range(128) if b not in b" \t\n\r"]] = False
        return apart.ravel()

    def fragments(self, text: bytes, spaces: bool = False) -> list[bytes]:
        """The text cut at all forced boundaries, and before every space where that is known to be safe."""
        raw = np.frombuffer(text, dtype=np.uint8)
        cut = self.cut[(raw[:-1].astype(np.uint16) << 8) | raw[1:]]
        if spaces:
            cut |= raw[1:] == 32
        at = (np.flatnonzero(cut) + 1).tolist()
        return [text[i:j] for i, j in zip([0, *at], [*at, len(text)], strict=True)]

    def learn(self, fragments: set[bytes]) -> None:
        """Encodes each new fragment on its own; those without white space stand on lines of their own in one call."""
        if len(self.seen) > REMEMBERED:
            self.seen.clear()
        new = [(f, f.decode()) for f in fragments.difference(self.seen)]
        lines = [(f, t) for f, t in new if LINE(t)]
        if lines:
            ids = np.array(self.ranked.encode_ordinary("\n".join([t for _, t in lines])), dtype="<u4")
            ends = np.append(np.flatnonzero(ids == self.line_end), len(ids)).tolist()
            flat = ids.tobytes()
            self.seen.update((f, flat[4 * i + 4 : 4 * j]) for (f, _), i, j in zip(lines, [-1, *ends], ends, strict=False))
        for f, t in new:
            if f not in self.seen:
                self.seen[f] = np.array(self.ranked.encode_ordinary(t), dtype="<u4").tobytes()

    def ids(self, text: bytes) -> bytes:
        """Ids of a text without special tokens, cut at the forced boundaries."""
        cut = self.fragments(text) if text else []
        self.learn(set(cut))
        return b"".join([self.seen[f] for f in cut])

    def learn_words(self, words: set[bytes]) -> None:
        """Ids of words that follow a space, cut further at the forced boundaries inside them."""
        known = self.after_space
        new = words.difference(known)
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            new = words
        if new:
            new = list(new)
            cut = self.fragments(b" " + b" ".join(new), spaces=True)
            self.learn(set(cut))
            starts = [i for i, f in enumerate(cut) if f[0] == 32]
            seen = self.seen
            for w, i, j in zip(new, starts, [*starts, len(cut)][1:], strict=True):
                known[w] = seen[cut[i]] if j == i + 1 else b"".join([seen[f] for f in cut[i:j]])

    def encode(self, batch: list[bytes]) -> list[bytes]:
        """Ids of some texts as little-endian unsigned 32-bit numbers.

        The cuts before spaces are taken first, as they are by far the most; a word is cut further when it is new.
        """
        split = [None if self.odd(t) else t.split(b" ") for t in batch]
        firsts = [ws.pop(0) if ws else b"" for ws in split]
        self.learn_words(set().union(*filter(None, split)))
        known = self.after_space
        out = []
        for text, first, words in zip(batch, firsts, split, strict=True):
            if words is not None:
                out.append(self.ids(first) + b"".join([known[w] for w in words]))
            else:
                parts = self.split_special(text)
                out.append(b"".join([self.special_ids[p] if p in self.special else self.ids(p) for p in parts]))
        return out

    def odd(self, text: bytes) -> bool:
        """Whether a space follows other white space, or a special token stands in the text."""
        return (
            any(x in text for x in self.special)
            or any(x in text for x in SPACE_RUNS)
            or (b"\xe2\x80" in text and WIDE_RUN.search(text) is not None)
        )

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of a text."""
        return b"".join(map(self.pieces.__getitem__, ids.tolist()))


def encode(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", decoded: bool = False) -> DataFrame:
    """(key, ids array<int>) of every row; with `decoded` also the text that the ids stand for."""

    def run(batches):
        codec = worker_state(f"bpe {path}", lambda: Codec(path))
        for b in batches:
            coded = codec.encode(texts(b.column(1)))
            flat = np.frombuffer(b"".join(coded), dtype="<u4").astype(np.int32)
            columns = [b.column(0), list_array(flat, [len(c) // 4 for c in coded], pa.int32())]
            if decoded:
                back = [codec.decode(np.frombuffer(c, dtype="<u4")) for c in coded]
                columns.append(text_array(back))
            yield pa.RecordBatch.from_arrays(columns, names=[key, "ids", "decoded"][: len(columns)])

    kind = df.select(key).schema[0].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>" + ", decoded string" * decoded)


def decode(df: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """All columns and the decoded text; null ids give null."""

    def run(batches):
        codec = worker_state(f"bpe {path}", lambda: Codec(path))
        for b in batches:
            back = [None if x is None else codec.decode(np.array(x, dtype=np.int64)) for x in b.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, text_array(back)], names=[*b.schema.names, "decoded"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{fields}, decoded string")


def text_array(back) -> pa.Array:
    """Strings from bytes; what is no UTF-8 gets replacement characters."""
    try:
        return pa.array(back, pa.binary()).cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([x if x is None else x.decode("utf-8", "replace") for x in back], pa.string())
