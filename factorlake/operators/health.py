"""Checks of stored bars: gaps, duplicates, completeness, files, watermarks."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scan import neighbour
from ..sources.lake import DAY_MS, INTERVAL_MS, SERIES, ms_date, partition_files

SMALL_FILE = 1_000_000


def _step() -> Column:
    pairs = [F.lit(x) for kv in INTERVAL_MS.items() for x in kv]
    return F.create_map(*pairs)[F.col("interval")]


def gap_ranges(
    bars: DataFrame, start_ms: int | None = None, end_ms: int | None = None, edges: bool = False
) -> DataFrame:
    """Missing stretches per series as first and last missing open time.

    Interior gaps by default; `edges` adds the head and the tail of the window.
    """
    times = bars.select(*SERIES, "open_time")
    if start_ms is not None:
        times = times.where(F.col("open_time") >= start_ms)
    if end_ms is not None:
        times = times.where(F.col("open_time") <= end_ms)
    times = times.distinct()
    day = F.floor(F.col("open_time") / DAY_MS)
    pairs = neighbour(times, SERIES, "open_time", day, ["open_time"]).withColumn("step", _step())
    gaps = pairs.where(F.col("open_time") - F.col("open_time_prev") > F.col("step")).select(
        *SERIES,
        (F.col("open_time_prev") + F.col("step")).alias("gap_start"),
        (F.col("open_time") - F.col("step")).alias("gap_end"),
    )
    if not edges:
        return gaps
    ends = times.groupBy(*SERIES).agg(F.min("open_time").alias("a"), F.max("open_time").alias("b"))
    ends = ends.withColumn("step", _step())
    head = ends.where(F.col("a") > start_ms).select(
        *SERIES, F.lit(start_ms).cast("bigint").alias("gap_start"), (F.col("a") - F.col("step")).alias("gap_end")
    )
    tail = ends.where(F.col("b") < end_ms).select(
        *SERIES, (F.col("b") + F.col("step")).alias("gap_start"), F.lit(end_ms).cast("bigint").alias("gap_end")
    )
    return gaps.unionByName(head).unionByName(tail)


def missing_windows(asked: DataFrame, bars: DataFrame, start_ms: int, end_ms: int) -> DataFrame:
    """Series with no bar at all: the whole window is the gap."""
    have = bars.where(F.col("open_time").between(start_ms, end_ms)).select(*SERIES).distinct()
    return asked.join(have, SERIES, "left_anti").select(
        *SERIES, F.lit(start_ms).cast("bigint").alias("gap_start"), F.lit(end_ms).cast("bigint").alias("gap_end")
    )


def health_stats(bars: DataFrame) -> DataFrame:
    """Rows, unique times, duplicates and what a gapless series would hold, per series.

    Copies are counted per (series, time) first, so a hot series is spread by time.
    """
    per = bars.groupBy(*SERIES, "open_time").agg(F.count("*").alias("copies"))
    agg = per.groupBy(*SERIES).agg(
        F.sum("copies").alias("rows"),
        F.count("*").alias("unique_times"),
        F.min("open_time").alias("min_open_time"),
        F.max("open_time").alias("max_open_time"),
    )
    span = F.col("max_open_time") - F.col("min_open_time")
    return (
        agg.withColumn("duplicates", F.col("rows") - F.col("unique_times"))
        .withColumn("duplicate_ratio", F.col("duplicates") / F.col("rows"))
        .withColumn("expected_if_continuous", (F.floor(span / _step()) + 1).cast("bigint"))
        .withColumn("missing_bars", F.col("expected_if_continuous") - F.col("unique_times"))
    )


def daily_completeness(bars: DataFrame, share: float = 0.98) -> DataFrame:
    """Rows per UTC day against a full day; days under int(expected * share) are bad."""
    per = bars.groupBy(*SERIES, ms_date("open_time").alias("day")).agg(F.count("*").alias("rows"))
    step = _step()
    full = F.when(F.lit(DAY_MS) % step == 0, F.floor(F.lit(DAY_MS) / step)).cast("bigint")
    return per.withColumn("expected", full).withColumn(
        "bad", F.col("rows") < F.floor(F.col("expected") * F.lit(share))
    )


def storage_stats(lake: DataFrame, small: int = SMALL_FILE) -> DataFrame:
    """Files, bytes, small files, most parts on one date and the five dates with most parts, per series."""
    files = partition_files(lake)
    dates = files.groupBy(*SERIES, "date").agg(
        F.count("*").alias("parts"),
        F.sum("bytes").alias("bytes"),
        F.sum((F.col("bytes") < small).cast("bigint")).alias("small_files"),
    )
    first = Window.partitionBy(*SERIES).orderBy(F.desc("parts"), "date")
    top = F.when(F.col("place") <= 5, F.struct("place", "date", "parts"))
    return dates.withColumn("place", F.row_number().over(first)).groupBy(*SERIES).agg(
        F.transform(F.sort_array(F.collect_list(top)), lambda t: F.struct(t["date"].alias("date"), t["parts"].alias("parts"))).alias("parts_per_date_top"),
        F.sum("parts").alias("files"),
        F.sum("bytes").alias("total_bytes"),
        F.sum("small_files").alias("small_files"),
        F.max("parts").alias("max_parts_per_date"),
    )


def watermark_check(local: DataFrame, mark: DataFrame) -> DataFrame:
    """missing_watermark / mismatch / ok per series; `local` and `mark` have last_open_time."""
    both = local.withColumnRenamed("last_open_time", "local_max").join(
        mark.select(*SERIES, F.col("last_open_time").alias("watermark")), SERIES, "left"
    )
    status = (
        F.when(F.col("watermark").isNull(), "missing_watermark")
        .when(F.abs(F.col("local_max") - F.col("watermark")) > _step(), "mismatch")
        .otherwise("ok")
    )
    return both.withColumn("status", status)


def recommend(report: DataFrame, small_files: int = 50, parts_per_date: int = 30) -> DataFrame:
    """List of advice from status, small_files, max_parts_per_date and gaps."""
    advice = F.array_compact(
        F.array(
            F.when(F.col("status") == "missing_watermark", F.lit("rebuild the watermark, then sync")),
            F.when(F.col("status") == "mismatch", F.lit("watermark differs from the stored bars: rebuild it")),
            F.when(F.col("small_files") >= small_files, F.lit("many small files: compact recent dates")),
            F.when(F.col("max_parts_per_date") >= parts_per_date, F.lit("many files on one date: compact it")),
            F.when(F.col("gaps") > 0, F.lit("gaps found: fill them")),
        )
    )
    return report.withColumn("advice", advice)
