"""Structured Streaming over ticks and bars.

Sinks write into the shared folder and are safe to repeat: a micro-batch is
stored under its number, or into the lake where the latest copy of a key wins.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import lake as L


def read_files(spark: SparkSession, path: str, schema: str, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def drain(query) -> None:
    """Wait until a query with an availableNow trigger has taken everything."""
    query.awaitTermination()


def bars_from_ticks(ticks: DataFrame, step: str, delay: str = "1 hour") -> DataFrame:
    """Ticks (symbol, ts, seq, price, size) to bars per tumbling window.

    The state is one row per open window and symbol; copies are combined before
    the shuffle, so a hot symbol does not gather in one task.
    """
    at = F.struct("ts", "seq")
    return (
        ticks.withWatermark("ts", delay)
        .groupBy("symbol", F.window("ts", step).alias("w"))
        .agg(
            F.min_by("price", at).alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", at).alias("close"),
            F.sum("size").alias("volume"),
            F.count("*").alias("num_trades"),
        )
        .select("symbol", F.col("w.start").alias("bar_time"), "open", "high", "low", "close", "volume", "num_trades")
    )


def versioned_sink(stream: DataFrame, path: str, checkpoint: str, mode: str = "update"):
    """Each micro-batch's rows under its number; a repeated batch replaces itself."""

    def put(df: DataFrame, epoch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(put)
        .start()
    )


def latest_version(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a versioned sink, the highest epoch of each key."""
    rest = [c for c in df.columns if c not in (*keys, "epoch")]
    one = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), "epoch").alias("r"))
    return one.select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def dedup_stream(bars: DataFrame, keys: list[str], time: str = "ts", delay: str = "1 day") -> DataFrame:
    """Re-delivered keys dropped; the first arrival stays, keys are forgotten after the delay."""
    return bars.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def lake_sink(bars: DataFrame, path: str, marks: str, checkpoint: str):
    """Append each micro-batch to the lake and record the mark it reached.

    The mark of a series is the highest ever recorded, so it only moves forward.
    """

    def put(df: DataFrame, epoch: int) -> None:
        df = df.persist()
        try:
            L.write(df, path, L.now_version())
            L.watermark(df).write.mode("overwrite").parquet(f"{marks}/epoch={epoch}")
        finally:
            df.unpersist()

    return (
        bars.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start()
    )


def read_marks(spark: SparkSession, marks: str) -> DataFrame:
    return spark.read.parquet(marks).groupBy(*L.SERIES).agg(F.max("last_open_time").alias("last_open_time"))
