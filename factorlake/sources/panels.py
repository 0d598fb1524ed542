"""Dense panels and factor values as bucketed, sorted tables.

A table is bucketed by (code, seg) and sorted by t, one file per bucket. Windows over a series and joins of two such
tables by cell then read it as it lies: without exchange and, inside `as_stored`, without sort, as often as it is used. A segment bounds
what one code can put into a bucket.
"""

import uuid
from collections.abc import Sequence
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..functions.ts import SERIES
from ..operators.panel import Factor, factors_on, require
from ..session import WRITTEN, shared_dir

CELL = [*SERIES, "t"]
#: A scan reports the order inside a bucket that is one file; a join by cell takes tables that lie by series as they are.
AS_STORED = {
    "spark.sql.legacy.bucketedTableScan.outputOrdering": "true",
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
}


@contextmanager
def as_stored(spark: SparkSession):
    """What is planned and run inside uses order and place of stored tables in full; the session's settings come back afterwards.

    Outside, the results are the same, but windows sort their buckets and joins by cell exchange them.
    """
    before = {k: spark.conf.get(k) for k in AS_STORED}
    try:
        for k, v in AS_STORED.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@dataclass(frozen=True)
class Stored:
    """A stored table of cells; `lookback` is the number of leading rows that its segments carry."""

    name: str
    path: str
    buckets: int
    lookback: int
    schema: str


def store(cells: DataFrame, lookback: int = 0, buckets: int | None = None, placed: Stored | None = None, path: str | None = None) -> Stored:
    """Writes a frame with code, seg and t, by default into the shared folder, where `drop_tables` ends it.

    With `placed`, the stored table that the frame was computed from by windows over a series, every task
    holds one bucket already and nothing is moved. Null codes make a series of their own.
    """
    require(cells, CELL)
    spark = cells.sparkSession
    buckets = placed.buckets if placed else buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"cells_{uuid.uuid4().hex}"
    if path is None:
        path = f"{shared_dir(spark)}/{name}"
        WRITTEN.append(path)
    schema = ", ".join(f"`{n}` {t}" for n, t in cells.dtypes)
    if not placed:
        cells = cells.repartition(buckets, *SERIES)
    writer = cells.write.format("parquet").option("path", path).bucketBy(buckets, *SERIES).sortBy(*CELL)
    writer.saveAsTable(name)
    return Stored(name, path, buckets, lookback, schema)


def read(spark: SparkSession, table: Stored) -> DataFrame:
    """The cells; a session that does not know the table yet, or no longer, enters it into its catalog."""
    if not spark.catalog.tableExists(table.name):
        by, order = (", ".join(c) for c in (SERIES, CELL))
        spark.sql(
            f"CREATE TABLE {table.name} ({table.schema}) USING parquet CLUSTERED BY ({by}) SORTED BY ({order}) "
            f"INTO {table.buckets} BUCKETS LOCATION '{table.path}'"
        )
    return spark.table(table.name)


def compute(spark: SparkSession, panel: Stored, factors: Sequence[Factor], shift: int = 0) -> DataFrame:
    """Cells of a stored dense panel with a column per factor. Factors that rank a date's names shuffle for that."""
    need = max((f.lookback for f in factors), default=0) + shift
    if need > panel.lookback:
        raise ValueError(f"the panel carries {panel.lookback} leading rows, the factors need {need}")
    return factors_on(read(spark, panel), factors, shift)


def attach(panel: DataFrame, values: DataFrame, names: Sequence[str]) -> DataFrame:
    """Left join of columns of one stored table onto another by cell."""
    return panel.join(values.select(*CELL, *names), CELL, "left")
