"""Factor-research views over the driver tables, in Spark and in SQL side by side."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import panel as P


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def trunc(unit: str, col: str):
    return F.date_trunc(unit, col).cast("timestamp_ntz")


def period(unit: str, col: str):
    """First day of the period as a date: a cheaper group key than a timestamp."""
    day = F.to_date(col)
    return day if unit == "day" else F.trunc(day, unit)


def bars(spark: SparkSession, sf: str, unit: str = "month") -> DataFrame:
    """Bars per supplier and period from line items; ties in time by the full line key."""
    price = F.col("l_extendedprice") / F.col("l_quantity")
    seq = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey")
    grouped = (
        table(spark, sf, "lineitem")
        .groupBy(period(unit, "l_shipdate").alias("day"), "l_suppkey")
        .agg(
            F.min_by(price, seq).alias("open"),
            F.max(price).alias("high"),
            F.min(price).alias("low"),
            F.max_by(price, seq).alias("close"),
            F.sum("l_quantity").alias("volume"),
            F.sum("l_extendedprice").alias("amount"),
        )
    )
    return grouped.select(
        F.col("day").cast("timestamp_ntz").alias("trade_time"), F.col("l_suppkey").cast("string").alias("code"), *P.FIELDS
    )


def bars_sql(unit: str = "month") -> str:
    seq = "(l_shipdate, l_orderkey, l_linenumber, l_partkey)"
    return f"""SELECT date_trunc('{unit}', l_shipdate) AS trade_time, CAST(l_suppkey AS VARCHAR) AS code,
      arg_min(l_extendedprice / l_quantity, {seq}) AS open,
      max(l_extendedprice / l_quantity) AS high,
      min(l_extendedprice / l_quantity) AS low,
      arg_max(l_extendedprice / l_quantity, {seq}) AS close,
      sum(l_quantity) AS volume, sum(l_extendedprice) AS amount
    FROM lineitem GROUP BY 1, 2"""


def calendar(spark: SparkSession, sf: str, unit: str = "month") -> DataFrame:
    days = table(spark, sf, "lineitem").select(period(unit, "l_shipdate").alias("day")).distinct()
    return days.select(F.col("day").cast("timestamp_ntz").alias("trade_time"))


def codes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select("l_suppkey").distinct().select(F.col("l_suppkey").cast("string").alias("code"))


def dense(spark, sf, lookback: int = 0, unit: str = "month", fields=P.FIELDS) -> DataFrame:
    return P.densify(
        bars(spark, sf, unit), calendar(spark, sf, unit), codes(spark, sf), fields, lookback=lookback
    )


def factor_frame(spark, sf, factors, shift: int = 0, unit: str = "month", **kw) -> DataFrame:
    return P.compute_factors(
        bars(spark, sf, unit),
        factors,
        shift=shift,
        times=calendar(spark, sf, unit),
        codes=codes(spark, sf),
        **kw,
    )


def dense_sql(unit: str = "month") -> str:
    """CTEs bars, cal, codes and dense (window `w` is spelled out by the caller)."""
    return f"""WITH RECURSIVE bars AS ({bars_sql(unit)}),
    cal AS (SELECT trade_time, row_number() OVER (ORDER BY trade_time) - 1 AS t
            FROM (SELECT DISTINCT trade_time FROM bars)),
    codes AS (SELECT DISTINCT code FROM bars),
    dense AS (SELECT cal.trade_time, cal.t, codes.code, open, high, low, close, volume, amount,
                bars.code IS NOT NULL AS observed
              FROM cal CROSS JOIN codes
              LEFT JOIN bars ON bars.trade_time = cal.trade_time AND bars.code = codes.code)"""


def trades(spark, sf) -> DataFrame:
    """Closed trades from orders."""
    total, key = F.col("o_totalprice"), F.col("o_orderkey")
    barlen = (key % 30).cast("int")
    return table(spark, sf, "orders").select(
        key.alias("ref"),
        F.col("o_custkey").alias("code"),
        F.col("o_orderdate").alias("dt_open"),
        (F.col("o_orderdate") + F.make_dt_interval(barlen)).alias("dt_close"),
        barlen.alias("barlen"),
        (total - 250000).alias("pnl"),
        (0.001 * total).alias("commission"),
        (total - 250000 - 0.001 * total).alias("pnlcomm"),
        (F.col("o_orderstatus") == "F").cast("int").alias("is_liq"),
    )


TRADES_SQL = """SELECT o_orderkey AS ref, o_custkey AS code, o_orderdate AS dt_open,
      o_orderdate + to_days(CAST(o_orderkey % 30 AS INTEGER)) AS dt_close,
      CAST(o_orderkey % 30 AS INTEGER) AS barlen,
      o_totalprice - 250000 AS pnl, 0.001 * o_totalprice AS commission,
      o_totalprice - 250000 - 0.001 * o_totalprice AS pnlcomm,
      CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS is_liq
    FROM orders"""


def fills(spark, sf) -> DataFrame:
    """Order fills from line items."""
    price = F.col("l_extendedprice") / F.col("l_quantity")
    return table(spark, sf, "lineitem").select(
        F.col("l_shipdate").alias("dt"),
        F.col("l_orderkey").alias("ref"),
        F.when(F.col("l_returnflag") == "R", "SELL").otherwise("BUY").alias("side"),
        F.col("l_quantity").alias("size"),
        price.alias("price"),
        F.col("l_extendedprice").alias("value"),
        (F.col("l_extendedprice") * F.col("l_tax")).alias("commission"),
        F.concat_ws("-", "l_linestatus", F.col("l_linenumber").cast("string")).alias("reason"),
        (F.col("l_returnflag") == "A").cast("int").alias("is_liq"),
    )


FILLS_SQL = """SELECT l_shipdate AS dt, l_orderkey AS ref,
      CASE WHEN l_returnflag = 'R' THEN 'SELL' ELSE 'BUY' END AS side,
      l_quantity AS size, l_extendedprice / l_quantity AS price, l_extendedprice AS value,
      l_extendedprice * l_tax AS commission,
      l_linestatus || '-' || CAST(l_linenumber AS VARCHAR) AS reason,
      CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END AS is_liq
    FROM lineitem"""


def ledger(spark, sf) -> DataFrame:
    """Candidate ledger from events: one candidate per event, one round per day."""
    k = F.get_json_object("props", "$.k").cast("int")
    mutant = F.col("user_id") % 2 == 1
    broken = k % 10 == 0
    ic = F.when(~broken, (F.col("value") - 50) / 1000)
    ok = F.coalesce(ic > 0.01, F.lit(False))
    return table(spark, sf, "events").select(
        F.col("event_id").alias("candidate_index"),
        (F.datediff(F.to_date("ts"), F.lit("2024-01-01")) + 1).alias("round"),
        F.concat(F.lit("Cand"), F.col("event_id")).alias("module"),
        F.col("event_type").alias("branch"),
        F.when(mutant, "mutation").otherwise("novelty").alias("mode"),
        F.when(mutant, F.concat(F.lit("axis"), F.col("user_id") % 5)).alias("axis"),
        F.when(mutant, F.concat(F.lit("parent"), F.col("user_id") % 20)).alias("parent"),
        k.alias("k"),
        ic.alias("ic"),
        F.when(broken, F.when(k % 20 == 0, "NameError").otherwise("KeyError")).alias("error_type"),
        F.when(broken, F.concat(F.lit("item "), k, F.lit(" is missing"))).alias("error"),
        ok.alias("ok"),
        F.when(ok & (k % 7 == 0), "duplicate").when(ok, "average").otherwise("failed").alias("label"),
        (ok & (k % 7 != 0) & F.coalesce(ic > 0.03, F.lit(False))).alias("accepted"),
    )


LEDGER_SQL = """SELECT *, CASE WHEN ok AND k % 7 = 0 THEN 'duplicate' WHEN ok THEN 'average' ELSE 'failed' END AS label,
      ok AND k % 7 <> 0 AND coalesce(ic > 0.03, false) AS accepted
    FROM (SELECT *, coalesce(ic > 0.01, false) AS ok FROM (
      SELECT event_id AS candidate_index, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) + 1 AS INTEGER) AS round,
        'Cand' || event_id AS module, event_type AS branch,
        CASE WHEN user_id % 2 = 1 THEN 'mutation' ELSE 'novelty' END AS mode,
        CASE WHEN user_id % 2 = 1 THEN 'axis' || (user_id % 5) END AS axis,
        CASE WHEN user_id % 2 = 1 THEN 'parent' || (user_id % 20) END AS parent, k,
        CASE WHEN k % 10 <> 0 THEN (value - 50) / 1000 END AS ic,
        CASE WHEN k % 20 = 0 THEN 'NameError' WHEN k % 10 = 0 THEN 'KeyError' END AS error_type,
        CASE WHEN k % 10 = 0 THEN 'item ' || k || ' is missing' END AS error
      FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)))"""


def metric_docs(spark, sf) -> DataFrame:
    """Metric records as JSON texts, one shape per event."""
    v = F.col("value").cast("string")
    shapes = [
        F.concat(F.lit('{"daily_rank_ic_mean": '), v, F.lit(', "rank_ic": 0.5}')),
        F.concat(F.lit('{"daily_rank_ic_mean": "nan", "rank_ic_distribution": {"mean": '), v, F.lit("}}")),
        F.concat(F.lit('{"rank_ic": '), v, F.lit(', "daily_ic_mean": 1.0}')),
        F.concat(F.lit('{"ic_distribution": {"mean": '), v, F.lit("}}")),
        F.lit('{"rank_ic": null}'),
    ]
    pick = F.get(F.array(*shapes), (F.col("event_id") % 5).cast("int"))
    return table(spark, sf, "events").select("event_id", pick.alias("doc"))


METRIC_DOCS_SQL = """SELECT event_id, CASE event_id % 5
      WHEN 0 THEN '{"daily_rank_ic_mean": ' || value || ', "rank_ic": 0.5}'
      WHEN 1 THEN '{"daily_rank_ic_mean": "nan", "rank_ic_distribution": {"mean": ' || value || '}}'
      WHEN 2 THEN '{"rank_ic": ' || value || ', "daily_ic_mean": 1.0}'
      WHEN 3 THEN '{"ic_distribution": {"mean": ' || value || '}}'
      ELSE '{"rank_ic": null}' END AS doc FROM events"""
