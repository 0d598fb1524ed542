"""Which hashed keys occur often: counts in buckets, of which one bit each is kept.

A key in a bucket without its bit is certainly rare. Tasks send sorted bucket numbers with saturated counts
as blocks, one for each shard of the buckets; a shard adds up its blocks one after another. The bits, a
fixed number, come to the driver, which may broadcast them.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SCHEMA = "shard int, buckets binary, counts binary"
#: Buckets that a task adds up at once, as a power of two.
SHARD = 18


def planes(x: np.ndarray) -> bytes:
    """Little-endian numbers, byte by byte: sorted numbers compress well so."""
    return x.view(np.uint8).reshape(len(x), -1).T.tobytes()


def unplanes(raw: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8).reshape(size, -1).T).view(kind).ravel()


def bucket_of(keys: np.ndarray, bits: int) -> np.ndarray:
    """Bucket of 64-bit hashes: their first bits."""
    return keys >> np.uint64(64 - bits)


def sent(keys: list[np.ndarray], bits: int, least: int):
    """Record batches of `SCHEMA` for some keys, repeats included; counts end at `least`."""
    width = min(bits, SHARD)
    bucket, n = np.unique(np.concatenate([bucket_of(k, bits).astype(np.uint32) for k in keys]), return_counts=True)
    if len(bucket) == 0:
        return
    n = np.minimum(n, min(least, 255)).astype(np.uint8)
    shard = bucket >> np.uint32(width)
    cuts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1], True])
    inner = (bucket & np.uint32((1 << width) - 1)).astype("<u4")
    for k in range(0, len(cuts) - 1, 200):
        spans = list(zip(cuts[k:], cuts[k + 1 : k + 201], strict=False))
        yield pa.RecordBatch.from_arrays(
            [pa.array(shard[[i for i, _ in spans]].astype(np.int32)), pa.array([planes(inner[i:j]) for i, j in spans]), pa.array([n[i:j].tobytes() for i, j in spans])],
            names=["shard", "buckets", "counts"],
        )


def often(blocks: DataFrame, bits: int, least: int) -> np.ndarray:
    """2^bits bits, eight a byte: whether the keys of a bucket occur `least` times together."""
    width = min(bits, SHARD)

    def add(batches):
        now, total = None, None
        for b in batches:
            for shard, buckets, counts in zip(*(b.column(c).to_pylist() for c in ("shard", "buckets", "counts")), strict=True):
                if shard != now:
                    if now is not None:
                        yield flags(now, total)
                    now, total = shard, np.zeros(1 << width, dtype=np.int64)
                total[unplanes(buckets, "<u4")] += np.frombuffer(counts, dtype=np.uint8)
        if now is not None:
            yield flags(now, total)

    def flags(shard, total):
        return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([np.packbits(total >= min(least, 255)).tobytes()])], names=["shard", "bits"])

    out = np.zeros(1 << (bits - 3), dtype=np.uint8)
    part = 1 << (width - 3)
    blocks = blocks.repartition("shard").sortWithinPartitions("shard")
    for row in blocks.mapInArrow(add, "shard int, bits binary").collect():
        out[row["shard"] * part : (row["shard"] + 1) * part] = np.frombuffer(row["bits"], dtype=np.uint8)
    return out


def has(flags: np.ndarray, keys: np.ndarray, bits: int) -> np.ndarray:
    """Whether the bucket of each key has its bit."""
    at = bucket_of(keys, bits).astype(np.int64)
    return (flags[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0
