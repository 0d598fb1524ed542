"""Streaming queries, run to the end with an availableNow trigger."""

import uuid

from pyspark.sql import functions as F

from ..functions.ranks import ordered_blocks
from ..session import materialize, shared_dir
from ..sources import lake as L
from ..streaming import bars as B
from ..streaming import gaps as G
from . import barlake as K
from . import views as V
from .evaluation import rounded
from .registry import query

DELIVERIES = 3


def _dir(spark, kind):
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def _deliver(spark, df, order, start):
    """Deliveries in time order: after each, the query is started again from its checkpoint and run dry."""
    path = _dir(spark, "arrivals")
    blocks = max(DELIVERIES, int(spark.conf.get("spark.sql.shuffle.partitions")))
    per = -(-blocks // DELIVERIES)
    cut = ordered_blocks(df, [order], blocks)
    schema = ", ".join(f"`{n}` {t}" for n, t in df.dtypes)
    for first in range(0, blocks, per):
        cut.where(F.col("blk").between(first, first + per - 1)).drop("blk").write.mode("append").parquet(path)
        B.drain(start(B.read_files(spark, path, schema)))


def _ticks(spark, sf):
    return V.table(spark, sf, "events").select(
        F.col("event_type").alias("symbol"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("seq"),
        F.col("value").alias("price"),
        F.lit(1.0).alias("size"),
    )


@query("stream_bars", """SELECT event_type AS symbol, time_bucket(INTERVAL 4 HOUR, ts) AS bar_time, arg_min(value, (ts, event_id)) AS open, max(value) AS high,
    min(value) AS low, arg_max(value, (ts, event_id)) AS close, count(*)::DOUBLE AS volume, count(*) AS num_trades FROM events GROUP BY 1, 2""")
def stream_bars(spark, sf):
    """Four-hour bars in update mode; the latest version of each bar equals the batch result."""
    path, check = _dir(spark, "bars"), _dir(spark, "checkpoint")
    bars = lambda ticks: B.bars_from_ticks(ticks, "4 hours")
    _deliver(spark, _ticks(spark, sf), "ts", lambda s: B.versioned_sink(bars(s), path, check))
    done = B.latest_version(spark.read.parquet(path), ["symbol", "bar_time"])
    return done.withColumn("bar_time", F.col("bar_time").cast("timestamp_ntz"))


@query("stream_bars_append", """WITH b AS (SELECT event_type AS symbol, time_bucket(INTERVAL 4 HOUR, ts) AS bar_time, arg_max(value, (ts, event_id)) AS close FROM events GROUP BY 1, 2)
    SELECT symbol, count(*) AS bars, round(max(close), 6) + 0.0 AS top FROM b
    WHERE bar_time + INTERVAL 4 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY 1""")
def stream_bars_append(spark, sf):
    """Append mode: only bars the watermark has closed."""
    path, check = _dir(spark, "bars"), _dir(spark, "checkpoint")
    bars = lambda ticks: B.bars_from_ticks(ticks, "4 hours")
    _deliver(spark, _ticks(spark, sf), "ts", lambda s: B.versioned_sink(bars(s), path, check, mode="append"))
    return rounded(spark.read.parquet(path).groupBy("symbol").agg(F.count("*").alias("bars"), F.max("close").alias("top")))


def _klines(spark, sf):
    bars = K.klines(spark, sf)
    return bars.withColumn("ts", L.ms_time("open_time").cast("timestamp"))


@query("stream_dedup", f"WITH raw AS ({K.RAW_SQL}) SELECT DISTINCT symbol, open_time, date FROM raw")
def stream_dedup(spark, sf):
    path, check = _dir(spark, "unique"), _dir(spark, "checkpoint")
    unique = lambda s: B.dedup_stream(s, ["symbol", "open_time"])
    _deliver(spark, _klines(spark, sf), "open_time", lambda s: B.versioned_sink(unique(s), path, check, mode="append"))
    return spark.read.parquet(path).select("symbol", "open_time", "date")


@query("stream_lake_sink", f"""{K.WITH} SELECT symbol, open_time, close, (SELECT max(m.open_time) FROM bars m WHERE m.symbol = bars.symbol) AS last_open_time FROM bars""")
def stream_lake_sink(spark, sf):
    """Bars arriving in several batches: the lake and its marks afterwards."""
    path, marks, check = _dir(spark, "lake"), _dir(spark, "marks"), _dir(spark, "checkpoint")
    _deliver(spark, _klines(spark, sf).drop("ts"), "ingest", lambda s: B.lake_sink(s, path, marks, check))
    stored = L.query(L.scan(spark, path), columns=[*L.SERIES, "open_time", "close"])
    return stored.join(B.read_marks(spark, marks), L.SERIES).select("symbol", "open_time", "close", "last_open_time")


@query("stream_gap_alert", f"""{K.WITH}, step AS (SELECT symbol, open_time, lag(open_time) OVER (PARTITION BY symbol ORDER BY open_time) AS prev FROM bars)
    SELECT symbol, prev + 60000 AS gap_start, open_time - 60000 AS gap_end FROM step WHERE open_time - prev > 60000""")
def stream_gap_alert(spark, sf):
    """Every seventh bar comes a week late and closes the gap it had left; every fifth one comes again."""
    path, check = _dir(spark, "alerts"), _dir(spark, "checkpoint")
    late = F.when(F.col("ingest") % 7 == 3, 7 * L.DAY_MS).otherwise(0)
    bars = _klines(spark, sf).drop("ts").withColumn("arrival", F.col("open_time") + late)
    again = bars.where("ingest % 5 = 0").withColumn("arrival", F.col("open_time") + 9 * L.DAY_MS)
    _deliver(spark, bars.unionByName(again), "arrival", lambda s: G.gap_alerts(s, path, check))
    return G.open_gaps(spark.read.parquet(path)).select("symbol", "gap_start", "gap_end")


@query("stream_resample", f"{K.WITH} {K.resampled_sql(3_600_000, '1h')}")
def stream_resample(spark, sf):
    """Coarser bars from the lake a stream has filled."""
    path, marks, check = _dir(spark, "lake"), _dir(spark, "marks"), _dir(spark, "checkpoint")
    _deliver(spark, _klines(spark, sf).drop("ts"), "ingest", lambda s: B.lake_sink(s, path, marks, check))
    return K.round_sums(L.resample(materialize(L.query(L.scan(spark, path))), "1h"))
