"""Helpers shared by the operators: batches, words, state of a Python worker, tables."""

import pickle
import sys
import types

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows per Arrow batch: texts may be long, so a batch stays small.
BATCH_ROWS = 1000


def tuned(spark: SparkSession) -> SparkSession:
    """Small Arrow batches, so that a worker holds few texts at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return tuned(spark).read.parquet(f"{sf}/{name}.parquet")


def worker_state(name: str, make):
    """An object that lives as long as the Python worker; functions themselves arrive anew with every task."""
    holder = sys.modules.setdefault("factorlake_worker_state", types.ModuleType("factorlake_worker_state"))
    if name not in holder.__dict__:
        holder.__dict__[name] = make()
    return holder.__dict__[name]


def ship(spark: SparkSession, model):
    """Broadcasts a model of fixed size, its class included; the function returned loads it in a worker."""
    blob = spark.sparkContext.broadcast(cloudpickle.dumps(model))
    return lambda: pickle.loads(blob.value)


def texts(column) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column; null counts as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def words(text: bytes) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+`, lower-cased in A-Z only, as bytes.lower and bytes.split do."""
    return text.lower().split()


def list_array(flat, lengths, kind) -> pa.Array:
    """List column from the flat values and the length of each row."""
    offsets = np.zeros(len(lengths) + 1, dtype=np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, type=kind))


def held(remainder: int, modulus: int, key: str = "doc_id"):
    """Whether crc32 of the id as text has this remainder; a null id counts as not held."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def fold(text):
    """A-Z lower-cased, other letters untouched."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the table does not use yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
