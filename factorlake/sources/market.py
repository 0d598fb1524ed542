"""Panels from stored bars or a market feed, adjust factors, universes, incremental merges."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import nz
from ..functions.scan import asof_backward
from ..operators.panel import KEYS, MARKET, keep_first, require
from .lake import ms_time


def panel_from_klines(bars: DataFrame) -> DataFrame:
    """Lake rows as a panel: code, UTC trade time, amount."""
    return bars.select(
        F.col("symbol").alias("code"),
        ms_time("open_time").alias("trade_time"),
        "open",
        "high",
        "low",
        "close",
        "volume",
        F.col("quote_volume").alias("amount"),
    )


def panel_from_market(feed: DataFrame) -> DataFrame:
    """Market fields as a panel; vwap falls back to close when absent or all missing; amount = close * volume."""
    require(feed, [*KEYS, "open", "high", "low", "close", "volume"])
    cols = ["open", "high", "low", "close", "volume"]
    df = feed.select(
        *KEYS,
        *[nz(c).alias(c) for c in cols],
        (nz("vwap") if "vwap" in feed.columns else F.lit(None).cast("double")).alias("vwap"),
    )
    have = "vwap" in feed.columns and bool(df.where("vwap IS NOT NULL").limit(1).count())
    if not have:
        df = df.withColumn("vwap", F.col("close"))
    return df.withColumn("amount", F.col("close") * F.col("volume"))


def _value_column(df: DataFrame) -> str | None:
    if "score" in df.columns:
        return "score"
    numeric = ("int", "bigint", "double", "float", "smallint", "tinyint")
    found = [n for n, t in df.dtypes if n not in MARKET and (t in numeric or t.startswith("decimal"))]
    return found[-1] if found else None


def factor_scores(df: DataFrame, value: str | None = None) -> DataFrame:
    """(trade_time, code, value): `score` if present, else the last numeric non-market column."""
    require(df, KEYS)
    value = value or _value_column(df)
    if value is None:
        raise ValueError("no factor column")
    return df.select(
        F.col("trade_time").cast("timestamp_ntz").alias("trade_time"),
        F.col("code").cast("string").alias("code"),
        nz(F.col(value).cast("string").try_cast("double")).alias("value"),
    )


def closes(df: DataFrame) -> DataFrame:
    """(trade_time, code, close) where the close is a number."""
    require(df, [*KEYS, "close"])
    return df.select(
        F.col("trade_time").cast("timestamp_ntz").alias("trade_time"),
        F.col("code").cast("string").alias("code"),
        nz(F.col("close").cast("string").try_cast("double")).alias("close"),
    ).dropna(subset=["close"])


def adjusted_bars(bars: DataFrame, dividends: DataFrame, compat: bool = False) -> DataFrame:
    """Bars (code, date, ...) with the adjust factor in force, 1 before the first.

    `dividends` has (code, date, factor), unique per code and date.  With
    `compat`, dates that carry only a factor become rows whose other columns
    are the last known ones.
    """
    if not compat:
        out = asof_backward(bars, dividends, ["code"], "date", ["factor"])
        return out.withColumn("factor", F.coalesce("factor", F.lit(1.0)))
    rest = [c for c in bars.columns if c not in ("code", "date")]
    days = bars.select("code", "date").unionByName(dividends.select("code", "date")).distinct()
    known = bars.join(dividends, ["code", "date"], "full")
    out = asof_backward(days, known, ["code"], "date", [*rest, "factor"])
    return out.fillna(1.0)


def universe_union(listing: DataFrame, sample_dates: Sequence) -> DataFrame:
    """Every code seen on any of the sample dates; `listing` has (code, date)."""
    return listing.where(F.col("date").isin(list(sample_dates))).select("code").distinct()


def yearly_dates(start: str, end: str) -> Column:
    """Array of sample dates one year apart, both ends inclusive."""
    return F.sequence(F.to_date(F.lit(start)), F.to_date(F.lit(end)), F.expr("interval 1 year"))


def merge_increment(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Append rows after the last stored date of each code; the stored copy of a (date, code) stays."""
    last = stored.groupBy("code").agg(F.max("date").alias("_last"))
    late = (
        fresh.join(last, "code", "left")
        .where(F.col("_last").isNull() | (F.col("date") > F.col("_last")))
        .drop("_last")
    )
    both = stored.withColumn("_src", F.lit(0)).unionByName(late.withColumn("_src", F.lit(1)))
    return keep_first(both, ["date", "code"], ["_src"]).drop("_src")


