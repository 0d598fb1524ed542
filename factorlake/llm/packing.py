"""Lexical retrieval packing of documents into sequences of a fixed window.

Documents stream through their input partition in shards of about `SHARD_TOKENS` tokens. A
shard gets an inverted index over its token ids with BM25 weights. A seed document asks
the index, with its heaviest terms, for neighbours that are not used yet; they follow it
until the window is full. The document that the border cuts goes on in the next window and is
its seed, so windows are full; where no neighbour is left, the next unused document follows.
The open window is handed on from shard to shard; what is left of it at the end of a
partition is cut into sequences whose lengths are powers of two, so no padding is needed.

Tokens come from a vocabulary that drops white space, so the texts of a batch are cut at white space
and each distinct piece, then each distinct word in it, is encoded once; the ids are gathered from there.

Defined results: null and empty texts have the closing id only. Every row is a document of its own,
also rows of equal or null ids. Sequence numbers are unique; which documents share a
sequence depends on how the input is partitioned.
"""

import json
import unicodedata
import zlib
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from .bpe import byte_letters
from .common import texts, tuned, worker_state

WINDOW = 4096
SHARD_TOKENS = 1_000_000
END_ID = 2
#: Heaviest terms of a seed that are looked up.
QUERY_TERMS = 24
K1, B = 1.2, 0.75
#: Bytes of text whose pieces are held at a time; a longer text is taken alone.
AT_ONCE = 1 << 22
#: How the vocabulary cuts a text into words; what it does not find is dropped.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
ENDING = regex.compile("s|t|re|ve|m|ll|d").match
SPACE, LETTER, NUMBER, OTHER, UNSEEN = range(5)
KINDS = [(SPACE, regex.compile(r"\s").match), (LETTER, regex.compile(r"\p{L}").match), (NUMBER, regex.compile(r"\p{N}").match), (OTHER, bool)]
#: Stands for the end of a word inside the encoder; pieces that hold it are left to the library.
END_SIGN = "\x01"
PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def joined(strings: pa.StringArray, sign: str) -> str:
    return pc.binary_join(pa.ListArray.from_arrays([0, len(strings)], strings), sign)[0].as_py()


def lists(offsets: np.ndarray, ids) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.uint32()))


class WordIds:
    """Ids of texts under a vocabulary that never joins over white space.

    Words are encoded by the ranks of the merges. The end of a word is one more sign, `END_SIGN`, and
    joining it with the last letter comes before all merges of the vocabulary.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, suffix = spec["model"], spec["model"]["end_of_word_suffix"]
        letters = byte_letters()
        raw = lambda t: bytes(letters[c] for c in t.removesuffix(suffix)) + END_SIGN.encode() * t.endswith(suffix)
        merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        single = {letter: bytes([b]) for letter, b in letters.items()}
        ranks = {b: i for i, b in enumerate(sorted(single.values()))}
        ranks |= {b + END_SIGN.encode(): 256 + i for i, b in enumerate(sorted(single.values()))}
        ranks |= {raw(t): 512 + i for i, t in enumerate(merged)}
        self.id_of = np.zeros(512 + len(merged), dtype="<u4")
        for token, i in model["vocab"].items():
            if (r := ranks.get(raw(token))) is not None:
                self.id_of[r] = i
        self.ends = np.zeros(len(self.id_of), dtype=bool)
        self.ends[[r for t, r in ranks.items() if t.endswith(END_SIGN.encode())]] = True
        self.ranked = tiktoken.Encoding("words", pat_str=f"[^{END_SIGN}]*{END_SIGN}", mergeable_ranks=ranks, special_tokens={})
        self.odd = [t["content"] for t in spec["added_tokens"]] + [END_SIGN]
        if (pattern := spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]) != PATTERN:
            raise ValueError(f"{path} cuts words by {pattern}")
        self.tokenizer = Tokenizer.from_file(path)
        self.kinds = np.full(0x110000, UNSEEN, dtype=np.uint8)

    def split(self, text: str) -> tuple[pa.StringArray, np.ndarray]:
        """What `PATTERN` finds in a text, and how many words stand before each line break."""
        points = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
        kind = self.kinds[points]
        if len(new := np.unique(points[kind == UNSEEN])):
            self.kinds[new] = [next(k for k, is_kind in KINDS if is_kind(chr(c))) for c in new]
            kind = self.kinds[points]
        starts = np.ones(len(points), dtype=bool)
        starts[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
        # a word that begins with an apostrophe takes some endings along and stops behind them
        for at in np.flatnonzero(starts & (points == ord("'"))).tolist():
            if ending := ENDING(text, at + 1):
                starts[at + 1], starts[ending.end() : ending.end() + 1] = False, True
        shown = kind != SPACE
        starts &= shown
        width = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
        raw = np.frombuffer(text.encode(), dtype=np.uint8)[np.repeat(shown, width)]
        width *= shown
        first = np.append((np.cumsum(width) - width)[starts], len(raw)).astype(np.int32)
        words = pa.StringArray.from_buffers(len(first) - 1, pa.py_buffer(first), pa.py_buffer(raw))
        return words, np.cumsum(starts)[points == ord("\n")]

    def word_ids(self, words: pa.StringArray) -> pa.ListArray:
        """Ids of normalised words, each encoded on its own in one call."""
        ranks = np.array(self.ranked.encode_ordinary(joined(words, END_SIGN) + END_SIGN * (len(words) > 0)), dtype=np.int64)
        return lists(np.append(0, np.flatnonzero(self.ends[ranks]) + 1), self.id_of[ranks])

    def line_ids(self, text: str) -> pa.ListArray:
        """Ids of the lines of a text: normalised, cut into words, each distinct word encoded once."""
        # sign by sign, as the library does: only the capital sigma looks at what stands beside it
        words, before = self.split(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())
        coded = words.dictionary_encode()
        ids = self.word_ids(coded.dictionary).take(coded.indices)
        return lists(ids.offsets.to_numpy()[np.concatenate([[0], before, [len(words)]])], ids.values)

    def piece_ids(self, pieces: pa.StringArray) -> pa.ListArray:
        """Ids of pieces between white space."""
        text = joined(pieces, "\n")
        if not any(x in text for x in self.odd):
            return self.line_ids(text)
        # sign strings of the vocabulary inside a piece are the library's matter
        alone, odd = pieces.to_pylist(), np.array([any(x in p for x in self.odd) for p in pieces.to_pylist()])
        plain = self.line_ids("\n".join(["" if o else p for p, o in zip(alone, odd, strict=True)]))
        found = [self.tokenizer.encode(p, add_special_tokens=False).ids if o else [] for p, o in zip(alone, odd, strict=True)]
        both = pa.concat_arrays([plain, pa.array(found, plain.type)])
        return both.take(pa.array(np.arange(len(alone)) + len(alone) * odd))

    def encode_some(self, batch: list[bytes]) -> list[bytes]:
        """Ids of some texts; each distinct piece is encoded once."""
        split = pc.ascii_split_whitespace(pa.array(batch, pa.binary()).cast(pa.string()))
        coded = split.values.dictionary_encode()
        ids = self.piece_ids(coded.dictionary).take(coded.indices)
        flat, cuts = ids.values.to_numpy().tobytes(), (4 * ids.offsets.to_numpy().astype(np.int64)[split.offsets.to_numpy()]).tolist()
        return [flat[i:j] for i, j in zip(cuts, cuts[1:], strict=False)]

    def encode(self, batch: list[bytes]) -> list[bytes]:
        """Ids of some texts as little-endian unsigned 32-bit numbers; about `AT_ONCE` bytes of text are cut into pieces at a time."""
        part = (np.cumsum([len(t) for t in batch], dtype=np.int64) // AT_ONCE).tolist()
        parts = groupby(zip(part, batch, strict=True), key=itemgetter(0))
        return [ids for _, some in parts for ids in self.encode_some([t for _, t in some])]


class Index:
    """Inverted index of one shard with BM25 weights."""

    def __init__(self, docs: list[bytes]):
        sizes = np.array([len(d) // 4 for d in docs])
        ids = np.frombuffer(b"".join(docs), dtype="<u4").astype(np.int64)
        pairs, counts = np.unique(np.repeat(np.arange(len(docs)), sizes) << 32 | ids, return_counts=True)
        self.doc, term = pairs >> 32, pairs & 0xFFFFFFFF
        self.first = np.searchsorted(self.doc, np.arange(len(docs) + 1))
        # ids are small numbers, so the terms of the shard are numbered by a table, not by sorting
        df = np.bincount(term)
        known = df > 0
        self.term, df = (np.cumsum(known) - 1)[term], df[known]
        idf = np.log1p((len(docs) - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * sizes[self.doc] / sizes.mean())
        self.weight = idf[self.term] * counts * (K1 + 1) / (counts + norm)
        self.df = df
        # numbers of 16 bits are sorted by radix
        order = np.argsort(self.term.astype(np.uint16) if len(df) <= 1 << 16 else self.term, kind="stable")
        self.posted, self.posted_weight = self.doc[order], self.weight[order]
        self.posted_first = np.concatenate([[0], np.cumsum(df)])

    def neighbours(self, seed: int, unused: np.ndarray) -> np.ndarray:
        """Unused documents that share a looked-up term with the seed, best first."""
        mine = slice(self.first[seed], self.first[seed + 1])
        term, weight = self.term[mine], self.weight[mine]
        shared = self.df[term] > 1
        term, weight = term[shared], weight[shared]
        if len(term) > QUERY_TERMS:
            term = term[np.argpartition(-weight, QUERY_TERMS - 1)[:QUERY_TERMS]]
        if len(term) == 0:
            return term
        spans = [slice(self.posted_first[t], self.posted_first[t + 1]) for t in term]
        found = np.concatenate([self.posted[s] for s in spans])
        score = np.bincount(found, weights=np.concatenate([self.posted_weight[s] for s in spans]), minlength=len(unused))
        ids = np.flatnonzero((score > 0) & unused)
        return ids[np.argsort(-score[ids], kind="stable")]


class Packer:
    """Lays documents into windows; `pieces` are those of closed sequences."""

    def __init__(self, window: int, first_sequence: int):
        self.window, self.sequence = window, first_sequence
        self.filled, self.open, self.pieces = 0, [], []

    def place(self, row, ids: bytes) -> bool:
        """Appends a document; true if a border cuts it."""
        size, start, crossed = len(ids) // 4, 0, False
        while start < size:
            if self.filled == self.window:
                self.close()
            take = min(self.window - self.filled, size - start)
            self.open.append((row, ids, start, take))
            crossed |= start > 0
            self.filled += take
            start += take
        return crossed

    def close(self) -> None:
        offset = 0
        for row, ids, start, length in self.open:
            crc = zlib.crc32(memoryview(ids)[4 * start : 4 * (start + length)])
            self.pieces.append((row, start, length, crc, len(ids) // 4, self.sequence, offset))
            offset += length
        self.open, self.filled = [], 0
        self.sequence += 1

    def finish(self) -> None:
        """Cuts what is left into sequences whose lengths are powers of two."""
        left, total = self.open[::-1], self.filled
        if total == self.window:
            self.close()
            return
        for bit in range(total.bit_length() - 1, -1, -1):
            room = total & (1 << bit)
            if room == 0:
                continue
            self.open = []
            while room:
                row, ids, start, length = left.pop()
                take = min(room, length)
                self.open.append((row, ids, start, take))
                if take < length:
                    left.append((row, ids, start + take, length - take))
                room -= take
            self.close()


def lay(shard: list[tuple[object, bytes]], packer: Packer) -> None:
    """Places all documents of a shard, each window by the neighbours of its seed."""
    index, unused = Index([ids for _, ids in shard]), np.ones(len(shard), dtype=bool)
    for following in range(len(shard)):
        seed = following if unused[following] else None
        if seed is not None:
            unused[seed] = False
            packer.place(*shard[seed])
        while seed is not None and packer.filled < packer.window:
            near, seed = index.neighbours(seed, unused), None
            for i in near:
                unused[i] = False
                if packer.place(*shard[i]):
                    seed = i  # cut by the border: it goes on as the next seed
                if seed is not None or packer.filled == packer.window:
                    break


def pack(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", window: int = WINDOW, shard_tokens: int = SHARD_TOKENS, end_id: int = END_ID) -> DataFrame:
    """One row per piece: (key, start, length, ids_crc32, doc_tokens, sequence_id, offset)."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches):
        words = worker_state(f"words {path}", lambda: WordIds(path))
        packer = Packer(window, TaskContext.get().partitionId() << 33)
        shard, size, kind = [], 0, None

        def handed():
            columns = list(zip(*packer.pieces, strict=True))
            packer.pieces = []
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in columns[0]], kind), *[pa.array(c, pa.int64()) for c in columns[1:]]],
                names=[key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

        for b in batches:
            kind = b.schema.field(0).type
            for i, ids in zip(b.column(0).to_pylist(), words.encode(texts(b.column(1))), strict=True):
                ids += end
                shard.append(((i,), ids))
                size += len(ids) // 4
                if size >= shard_tokens:
                    lay(shard, packer)
                    shard, size = [], 0
                    if packer.pieces:
                        yield handed()
        if shard:
            lay(shard, packer)
        packer.finish()
        if packer.pieces:
            yield handed()

    kind = df.select(key).schema[0].dataType.simpleString()
    tuned(df.sparkSession)
    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, {PIECES}")
