"""The bar lake: Parquet under venue / symbol / interval / date, append-only, latest copy wins."""

import time
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.panel import keep_last, require
from ..session import materialize

# Interval names in milliseconds.
INTERVAL_MS = {
    "1m": 60_000,
    "3m": 180_000,
    "5m": 300_000,
    "15m": 900_000,
    "30m": 1_800_000,
    "1h": 3_600_000,
    "2h": 7_200_000,
    "4h": 14_400_000,
    "6h": 21_600_000,
    "8h": 28_800_000,
    "12h": 43_200_000,
    "1d": 86_400_000,
}
# Targets a bar can be built for.
RESAMPLE_TARGETS = ("5m", "15m", "1h", "4h", "1d")
# Columns of a stored bar.
DOUBLES = ["open", "high", "low", "close", "volume", "quote_volume", "taker_buy_base_vol", "taker_buy_quote_vol"]
LONGS = ["open_time", "close_time", "num_trades"]
REQUIRED = [*LONGS, *DOUBLES]
SERIES = ["venue", "symbol", "interval"]
KEYS = [*SERIES, "open_time"]
COLUMNS = [
    *SERIES, "open_time", "open", "high", "low", "close", "volume", "close_time", "quote_volume",
    "num_trades", "taker_buy_base_vol", "taker_buy_quote_vol", "date",
]
PARTITIONS = [*SERIES, "date"]
DAY_MS = 86_400_000


def ms_date(ms) -> Column:
    """UTC day of epoch milliseconds as text, independent of the session time zone."""
    ms = F.col(ms) if isinstance(ms, str) else ms
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(ms / DAY_MS).cast("int")).cast("string")


def ms_time(ms) -> Column:
    """UTC wall-clock time of epoch milliseconds, without a zone."""
    ms = F.col(ms) if isinstance(ms, str) else ms
    secs = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (ms / 1000).cast("decimal(18,6)"))
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + secs


def time_ms(ts) -> Column:
    """Epoch milliseconds of a zone-less UTC time."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    gap = ts.cast("timestamp_ntz") - F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.floor(gap.cast("interval second").cast("decimal(20,6)") * 1000).cast("bigint")


def floor_minute(ms) -> Column:
    ms = F.col(ms) if isinstance(ms, str) else ms
    return ms - F.pmod(ms, F.lit(60_000))


def normalize(raw: DataFrame, **keys: str) -> DataFrame:
    """Raw bar rows (any castable types) to the typed lake row; other columns are dropped.

    `keys` stamps venue, symbol or interval where given; the rest must be columns.
    """
    require(raw, REQUIRED)
    df = raw.withColumns({k: F.lit(v) for k, v in keys.items()}) if keys else raw
    typed = df.select(
        *[F.col(c) for c in SERIES],
        *[F.col(c).cast("bigint").alias(c) for c in LONGS],
        *[F.col(c).cast("double").alias(c) for c in DOUBLES],
        *([F.col("ingest").cast("bigint")] if "ingest" in df.columns else []),
    )
    extra = ["ingest"] if "ingest" in df.columns else []
    return typed.withColumn("date", ms_date("open_time")).select(*COLUMNS, *extra)


def write(df: DataFrame, path: str, ingest: int, rows_per_file: int = 2_000_000) -> None:
    """Append one delivery under the version `ingest`.  Copies inside it keep the last by their own `ingest` column.

    Range partitioning by the full key splits a hot symbol or day over tasks and
    leaves every file sorted by time.
    """
    df = keep_last(require(df, ["ingest"]), KEYS, ["ingest"]).drop("ingest")
    order = [*PARTITIONS, "open_time"]
    (
        df.withColumn("ingest", F.lit(ingest).cast("bigint"))
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .write.mode("append")
        .option("maxRecordsPerFile", rows_per_file)
        .partitionBy(*PARTITIONS)
        .parquet(path)
    )


def now_version() -> int:
    """A version by the clock, so that deliveries of several writers are ordered by when they came."""
    return time.time_ns() // 1000


def scan(spark: SparkSession, path: str) -> DataFrame:
    types = {**dict.fromkeys(LONGS, "bigint"), **dict.fromkeys(DOUBLES, "double"), "ingest": "bigint"}
    schema = ", ".join(f"`{c}` {types.get(c, 'string')}" for c in [*COLUMNS, "ingest"])
    return spark.read.schema(schema).parquet(path)


def newest(df: DataFrame) -> DataFrame:
    """Latest copy per key; a key has one copy of each version.

    All buffers are numbers, so this is a hash aggregate; the date follows from the time.
    """
    rest = [c for c in df.columns if c not in (*KEYS, "ingest", "date")]
    one = df.groupBy(*KEYS).agg(*[F.max_by(c, "ingest").alias(c) for c in rest], F.max("ingest").alias("ingest"))
    return one.withColumn("date", ms_date("open_time")).select(*df.columns)


def query(
    lake: DataFrame,
    venue: str | None = None,
    symbols: Sequence[str] | None = None,
    interval: str | None = None,
    start_ms: int | None = None,
    end_ms: int | None = None,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Inclusive range on open time, latest copy per key, chosen columns.

    The day bounds derived from the range prune partitions; the range itself is
    pushed to Parquet.
    """
    df = lake
    if venue is not None:
        df = df.where(F.col("venue") == venue)
    if symbols is not None:
        df = df.where(F.col("symbol").isin(list(symbols)))
    if interval is not None:
        df = df.where(F.col("interval") == interval)
    if start_ms is not None:
        df = df.where((F.col("date") >= ms_date(F.lit(start_ms))) & (F.col("open_time") >= start_ms))
    if end_ms is not None:
        df = df.where((F.col("date") <= ms_date(F.lit(end_ms))) & (F.col("open_time") <= end_ms))
    need = list(columns or COLUMNS)
    return newest(df.select(*dict.fromkeys([*KEYS, *need, "ingest"]))).select(*need)


def partition_files(lake: DataFrame) -> DataFrame:
    """Files and bytes per lake partition, read from file metadata."""
    files = lake.select(
        *PARTITIONS, F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes")
    )
    return files.groupBy(*PARTITIONS, "file").agg(F.max("bytes").alias("bytes"), F.count("*").alias("rows"))


def compact(
    spark: SparkSession,
    path: str,
    asked: DataFrame | None = None,
    rows_per_file: int = 2_000_000,
    force: bool = False,
) -> DataFrame:
    """Rewrite partitions: latest copy per key, sorted, few files.  Returns a status per partition.

    `asked` (venue, symbol, interval, date) limits the work; partitions that have one copy of each
    key and as few files as their rows need are skipped unless forced.  A partition is written by one task, or by
    one per `rows_per_file` rows of it, each with a stretch of the day, so a second run finds nothing
    to do.  Only the chosen partitions are replaced, by a dynamic overwrite from a checkpointed copy.
    """
    lake = scan(spark, path)
    files = partition_files(lake).groupBy(*PARTITIONS).agg(
        F.count("*").alias("input_files"), F.ceil(F.sum("rows") / rows_per_file).alias("_needed")
    )
    # stretches of unequal size make up to twice as many files
    enough = F.when(F.col("_needed") > 1, 2 * F.col("_needed")).otherwise(1)
    few = files.where((F.col("input_files") > 1) & (F.col("input_files") <= enough)).select(*PARTITIONS)
    copies = lake.join(few, PARTITIONS, "left_semi").groupBy(*PARTITIONS, "open_time").count().where("count > 1")
    files = files.join(copies.select(*PARTITIONS, F.lit(True).alias("_copies")).distinct(), PARTITIONS, "left")
    asked = files.select(*PARTITIONS) if asked is None else asked.select(*PARTITIONS).distinct()
    state = (
        F.when(F.col("input_files").isNull(), "missing_partition")
        .when((F.col("input_files") <= enough) & F.col("_copies").isNull() & F.lit(not force), "skip_small")
        .otherwise("compacted")
    )
    status = materialize(asked.join(files, PARTITIONS, "left").withColumn("status", state))
    todo = status.where("status = 'compacted'").select(*PARTITIONS)
    kept = materialize(newest(lake.join(todo, PARTITIONS, "left_semi")))
    rows = materialize(kept.groupBy(*PARTITIONS).agg(F.count("*").alias("rows")))
    order = [*PARTITIONS, "open_time"]
    parts = F.ceil(F.col("rows") / rows_per_file)
    stretch = F.floor(F.pmod("open_time", F.lit(DAY_MS)) * parts / DAY_MS).cast("int")
    (
        kept.join(rows, PARTITIONS)
        .withColumn("_stretch", stretch)
        .repartition(*PARTITIONS, "_stretch")
        .sortWithinPartitions(*order)
        .select(*kept.columns)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("maxRecordsPerFile", rows_per_file)
        .partitionBy(*PARTITIONS)
        .parquet(path)
    )
    written = partition_files(scan(spark, path)).join(todo, PARTITIONS, "left_semi")
    written = written.groupBy(*PARTITIONS).agg(F.count("*").alias("written_files"))
    done = status.drop("_needed", "_copies").join(rows, PARTITIONS, "left").join(materialize(written), PARTITIONS, "left")
    return done.fillna(0, ["rows", "input_files", "written_files"])


def watermark(lake: DataFrame) -> DataFrame:
    """Last open time per series."""
    return lake.groupBy(*SERIES).agg(F.max("open_time").alias("last_open_time"))


def watermark_upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """Insert or update: the row with the later `updated_at` wins per series."""
    return keep_last(old.unionByName(new), SERIES, ["updated_at", "last_open_time"])


def watermark_advance(old: DataFrame, new: DataFrame) -> DataFrame:
    """Update that only moves forward."""
    both = old.select(*SERIES, "last_open_time").unionByName(new.select(*SERIES, "last_open_time"))
    return both.groupBy(*SERIES).agg(F.max("last_open_time").alias("last_open_time"))


def new_rows(batch: DataFrame, mark: DataFrame) -> DataFrame:
    """Rows of a delivery past the stored mark of their series."""
    seen = mark.select(*SERIES, F.col("last_open_time").alias("_mark"))
    return (
        batch.join(seen, SERIES, "left")
        .where(F.col("_mark").isNull() | (F.col("open_time") > F.col("_mark")))
        .drop("_mark")
    )


def fill_rows(delivery: DataFrame, stored: DataFrame, start_ms: int, end_ms: int) -> DataFrame:
    """Rows of a delivery that fall into gaps of the stored bars inside a window (both ends included).

    A gap is a missing time between two stored ones; a series without any bar in the
    window misses all of it. A time lies in a gap if it is not stored and stands between the
    first and the last stored one, so no gap list is joined by range.
    """
    window = F.col("open_time").between(start_ms, end_ms)
    have = stored.where(window).select(*SERIES, "open_time").distinct()
    ends = have.groupBy(*SERIES).agg(F.min("open_time").alias("_first"), F.max("open_time").alias("_last"))
    late = delivery.where(window).join(have, KEYS, "left_anti").join(ends, SERIES, "left")
    inside = F.col("_first").isNull() | F.col("open_time").between(F.col("_first"), F.col("_last"))
    return late.where(inside).drop("_first", "_last")


def resample(bars: DataFrame, target: str, source: str = "1m") -> DataFrame:
    """Bars of the source interval to 5m, 15m, 1h, 4h or 1d: first open, max high, min low, last close, sums.

    Bars of other intervals in the table are not read.

    Bins are left-closed and left-labelled in UTC; empty bins are not made.  All
    aggregate buffers are longs and doubles, so the aggregation stays a hash
    aggregate with map-side combining.
    """
    if target not in RESAMPLE_TARGETS:
        raise ValueError(f"target interval must be one of {RESAMPLE_TARGETS}")
    step, t = INTERVAL_MS[target], F.col("open_time")
    if step % INTERVAL_MS[source] or step == INTERVAL_MS[source]:
        raise ValueError(f"{target} bars cannot be built from {source} bars")
    bars = bars.where(F.col("interval") == source)
    sums = ["volume", "quote_volume", "taker_buy_base_vol", "taker_buy_quote_vol"]
    out = bars.groupBy("venue", "symbol", (t - F.pmod(t, F.lit(step))).alias("bin")).agg(
        F.min_by("open", "open_time").alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", "open_time").alias("close"),
        *[F.sum(c).alias(c) for c in sums],
        F.sum("num_trades").alias("num_trades"),
    )
    return (
        out.dropna()
        .withColumnsRenamed({"bin": "open_time"})
        .withColumns(
            {
                "interval": F.lit(target),
                "close_time": F.col("open_time") + (step - 1),
                "date": ms_date("open_time"),
            }
        )
        .select(*COLUMNS)
    )


def resample_chain(bars: DataFrame, targets: Sequence[str]) -> dict[str, DataFrame]:
    """Several targets from one pass over the fine bars: each coarser bar is built from the next finer one."""
    made: dict[str, DataFrame] = {}
    source, interval = bars, "1m"
    for target in sorted(targets, key=INTERVAL_MS.__getitem__):
        made[target] = resample(source, target, interval)
        if source is bars:
            made[target] = materialize(made[target])
        source, interval = made[target], target
    return made
