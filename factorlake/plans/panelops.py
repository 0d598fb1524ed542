"""Panel, projection, filter, join, set and user-function queries."""

import uuid

import pandas as pd
from pyspark.sql import functions as F

from ..functions import ts
from ..functions.numeric import nz, rnd
from ..operators import panel as P
from ..operators import slots as S
from ..operators import trades as T
from ..operators import uplift as U
from ..operators import ic
from ..operators import library_factors as lib
from ..session import materialize, shared_dir
from ..sources import market as M
from ..sources import panels as B
from . import cands as C
from . import views as V
from .evaluation import rounded
from .registry import out, query
from .series import _framed, _ret

BW = f"WITH bars AS ({V.bars_sql()})"


@query("panel_dedup_mean", f"""SELECT date_trunc('month', l_shipdate) AS trade_time, CAST(l_suppkey AS VARCHAR) AS code,
    {out("avg(l_quantity)", "volume", 7)}, {out("avg(l_extendedprice)", "amount", 7)} FROM lineitem GROUP BY 1, 2""")
def panel_dedup_mean(spark, sf):
    rows = V.table(spark, sf, "lineitem").select(
        V.trunc("month", "l_shipdate").alias("trade_time"),
        F.col("l_suppkey").cast("string").alias("code"),
        F.col("l_quantity").alias("volume"),
        F.col("l_extendedprice").alias("amount"),
    )
    return rounded(P.dedup_mean(rows, ["volume", "amount"]), digits=7)


@query("panel_densify", f"{V.dense_sql('week')} SELECT code, trade_time, t, open, high, low, close, volume, observed FROM dense")
def panel_densify(spark, sf):
    df = V.dense(spark, sf, unit="week")
    return df.select("code", "trade_time", F.col("t").cast("bigint").alias("t"), *P.FIELDS[:5], "observed")


@query("panel_segments", f"""{V.dense_sql("week")} SELECT code, trade_time, {out("sum(volume) OVER w", "volume_8")} FROM dense
    WINDOW w AS (PARTITION BY code ORDER BY trade_time ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)""")
def panel_segments(spark, sf):
    """The same rolling sum with the calendar cut into short segments."""
    df = P.densify(V.bars(spark, sf, "week"), V.calendar(spark, sf, "week"), V.codes(spark, sf), lookback=7, segment=50)
    df = df.withColumn("volume_8", ts.ts_sum("volume", 8, 1))
    return df.where(~F.col("halo")).select("code", "trade_time", rnd("volume_8").alias("volume_8"))


@query("panel_stored", f"""{V.dense_sql("week")} SELECT code, trade_time, close, {out("sum(volume) OVER w", "volume_8")} FROM dense
    WINDOW w AS (PARTITION BY code ORDER BY trade_time ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)""")
def panel_stored(spark, sf):
    """A rolling sum computed on a stored panel, stored beside it and joined to it by cell."""
    df = P.densify(V.bars(spark, sf, "week"), V.calendar(spark, sf, "week"), V.codes(spark, sf), lookback=7, segment=50)
    panel = B.store(df, 7)
    with B.as_stored(spark):
        sums = B.read(spark, panel).select(*B.CELL, ts.ts_sum("volume", 8, 1).alias("volume_8"))
        both = B.attach(B.read(spark, panel), B.read(spark, B.store(sums, placed=panel)), ["volume_8"])
        return materialize(both.where(~F.col("halo")).select("code", "trade_time", "close", rnd("volume_8").alias("volume_8")))


@query("attach_factor", f"""{BW} SELECT b.code, b.trade_time, b.close, f.value AS weight FROM bars b
    LEFT JOIN (SELECT code, trade_time, high - low AS value FROM bars WHERE volume > 150) f USING (code, trade_time)""")
def attach_factor(spark, sf):
    bars = V.bars(spark, sf)
    factor = bars.where("volume > 150").select(*P.KEYS, (F.col("high") - F.col("low")).alias("value"))
    return P.attach_factor(bars.select(*P.KEYS, "close"), factor, "weight")


@query("date_range_filter", "SELECT o_orderkey, o_orderdate, o_totalprice FROM orders WHERE o_orderdate BETWEEN '1996-03-01' AND '1997-06-30'")
def date_range_filter(spark, sf):
    bounds = [F.lit(d).cast("timestamp_ntz") for d in ("1996-03-01", "1997-06-30")]
    return V.table(spark, sf, "orders").where(F.col("o_orderdate").between(*bounds)).select("o_orderkey", "o_orderdate", "o_totalprice")


@query("universe_filter", f"""{BW} SELECT code, trade_time, close FROM bars WHERE CAST(code AS BIGINT) IN
    (SELECT s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA')
    AND close IS NOT NULL AND volume IS NOT NULL""")
def universe_filter(spark, sf):
    """A named universe: the suppliers of one region, as a semi join on codes."""
    t = lambda n: V.table(spark, sf, n)
    asia = (
        t("supplier")
        .join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(t("region").where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.col("s_suppkey").cast("string").alias("code"))
    )
    bars = V.bars(spark, sf).join(asia, "code", "left_semi")
    return bars.dropna(subset=["close", "volume"]).select("code", "trade_time", "close")


ODD = "CASE WHEN event_id % 7 = 0 THEN 'nan'::DOUBLE WHEN event_id % 7 = 1 THEN 'inf'::DOUBLE WHEN event_id % 7 = 2 THEN '-inf'::DOUBLE ELSE value END"


@query("finite_or_null", f"SELECT event_id, CASE WHEN isfinite(x) THEN x END AS x FROM (SELECT event_id, {ODD} AS x FROM events)")
def finite_or_null(spark, sf):
    rest = F.col("event_id") % 7
    odd = F.when(rest == 0, float("nan")).when(rest == 1, float("inf")).when(rest == 2, float("-inf")).otherwise(F.col("value"))
    return V.table(spark, sf, "events").select("event_id", nz(odd).alias("x"))


@query("where_mask", """SELECT event_id, CASE WHEN user_id > 50 THEN value END AS kept,
    CASE WHEN abs(value - 6.55) >= 1e-9 THEN value - 6.55 END AS masked FROM events""")
def where_mask(spark, sf):
    off = F.col("value") - 6.55
    return V.table(spark, sf, "events").select(
        "event_id", F.when(F.col("user_id") > 50, F.col("value")).alias("kept"), F.when(F.abs(off) >= 1e-9, off).alias("masked")
    )


@query("slot_fill", f"""{C.frame_sql()} SELECT code, trade_time, {out("coalesce(mom_12, -1)", "signal_1")}, {out("coalesce(vol_6, -1)", "signal_2")},
    -1.0::DOUBLE AS signal_3 FROM frame""")
def slot_fill(spark, sf):
    df = C.frame(spark, sf).select(*P.KEYS, F.col("mom_12").alias("signal_1"), F.col("vol_6").alias("signal_2"))
    return rounded(S.fill_slots(df, ["signal_1", "signal_2", "signal_3"]))


@query("slot_run", f"""{V.dense_sql()}, s AS (SELECT *, {_ret("close", 3)} AS m,
    {_framed("sum", "close * volume", 6, 1)} / nullif({_framed("sum", "volume", 6, 1)}, 0) AS vw FROM dense WINDOW w AS (PARTITION BY code ORDER BY trade_time))
    SELECT code, trade_time, close, {out("coalesce(m, -1)", "signal_1")}, -1.0::DOUBLE AS signal_2, {out("coalesce(m, -1)", "signal_3")}, {out("vw", "vwap")}
    FROM s WHERE observed""")
def slot_run(spark, sf):
    """A registry with one factor in two of three slots, and a rolling vwap."""
    reg = S.SlotRegistry(3)
    reg.assign(1, lib.momentum(3))
    reg.assign("signal_2", lib.volatility(6))
    reg.remove(2)
    reg.assign(3, lib.momentum(3))
    got = reg.run(V.bars(spark, sf), vwap=6, times=V.calendar(spark, sf), codes=V.codes(spark, sf))
    return rounded(got.select(*P.KEYS, "close", "signal_1", "signal_2", "signal_3", "vwap"), "close")


@query("column_order", f"{BW} SELECT code, trade_time, open, high, low, close, volume, amount, 1 AS signal_1, 2 AS signal_2, 'x' AS note, close AS vwap FROM bars")
def column_order(spark, sf):
    df = V.bars(spark, sf).select(
        F.col("close").alias("vwap"), F.lit("x").alias("note"), F.lit(2).alias("signal_2"), F.lit(1).alias("signal_1"), "*"
    )
    return S.order_columns(df, S.slot_names(df.columns)).withColumn("amount", F.col("amount"))


@query("score_row_mean", f"""{C.frame_sql()} SELECT code, trade_time, {out("list_avg(list_filter([mom_1, mom_12, vol_6], lambda x: x IS NOT NULL))", "score")} FROM frame""")
def score_row_mean(spark, sf):
    df = C.frame(spark, sf)
    return df.select(*P.KEYS, rnd(P.row_mean(["mom_1", "mom_12", "vol_6"])).alias("score"))


@query("output_normalize", f"""{BW}, wide AS (SELECT trade_time, max(close) FILTER (WHERE code = '1') AS a, max(close) FILTER (WHERE code = '2') AS b FROM bars GROUP BY 1)
    SELECT code, trade_time, CASE code WHEN '1' THEN a WHEN '2' THEN b END AS value FROM bars JOIN wide USING (trade_time)""")
def output_normalize(spark, sf):
    """A wide output with two code columns aligned to the whole panel."""
    bars = V.bars(spark, sf)
    wide = bars.groupBy("trade_time").pivot("code", ["1", "2"]).agg(F.max("close"))
    return S.normalize_output(bars.select(*P.KEYS), wide).select("code", "trade_time", "value")


@query("key_intersection", f"""{BW}, daily AS (SELECT date_trunc('month', o_orderdate) AS trade_time FROM orders WHERE o_totalprice > 400000)
    SELECT trade_time FROM bars INTERSECT SELECT trade_time FROM daily""")
def key_intersection(spark, sf):
    rich = V.table(spark, sf, "orders").where("o_totalprice > 400000").select(V.trunc("month", "o_orderdate").alias("trade_time"))
    return V.calendar(spark, sf).intersect(rich)


@query("name_except", "SELECT p_brand AS name FROM part WHERE p_size < 10 EXCEPT SELECT p_brand FROM part WHERE p_retailprice > 1800")
def name_except(spark, sf):
    part = V.table(spark, sf, "part")
    return part.where("p_size < 10").select(F.col("p_brand").alias("name")).subtract(
        part.where("p_retailprice > 1800").select("p_brand")
    )


def _csv(df, spark):
    path = f"{shared_dir(spark)}/factor-{uuid.uuid4().hex}"
    df.write.option("header", True).csv(path)
    return spark.read.option("header", True).csv(path)


@query("factor_scores_scan", f"""{BW} SELECT code, trade_time, CASE WHEN volume < 100 THEN NULL ELSE high - low END AS value FROM bars""")
def factor_scores_scan(spark, sf):
    """Factor CSV with broken cells, read back; the value column is `score`."""
    bars = V.bars(spark, sf)
    cell = F.when(F.col("volume") < 100, "bad").otherwise((F.col("high") - F.col("low")).cast("string"))
    text = bars.select("code", F.date_format("trade_time", "yyyy-MM-dd").alias("trade_time"), "close", cell.alias("score"))
    return M.factor_scores(_csv(text, spark)).select("code", "trade_time", "value")


@query("close_scan", f"{BW} SELECT code, trade_time, close FROM bars WHERE volume >= 100")
def close_scan(spark, sf):
    bars = V.bars(spark, sf)
    cell = F.when(F.col("volume") >= 100, F.col("close").cast("string"))
    text = bars.select("code", F.date_format("trade_time", "yyyy-MM-dd").alias("trade_time"), cell.alias("close"))
    return M.closes(_csv(text, spark)).select("code", "trade_time", "close")


@query("feature_augment_join", f"""{C.frame_sql()} SELECT c.code, c.trade_time, {out("c.label", "label")}, b.volume, {out("c.mom_1", "mom_1")}
    FROM cells c LEFT JOIN (SELECT code, trade_time, volume FROM bars WHERE volume > 120) b ON b.code = c.code AND b.trade_time = c.trade_time WHERE label IS NOT NULL""")
def feature_augment_join(spark, sf):
    frame = C.frame(spark, sf)
    label = ic.forward_return(frame, 1, "label", C.dates(spark, sf)).select(*P.KEYS, "label")
    base = V.bars(spark, sf).where("volume > 120").select(*P.KEYS, "volume")
    got = U.feature_frame(label, base, frame.select(*P.KEYS, "mom_1"))
    return rounded(got, "volume")


@query("augmented_uplift")
def augmented_uplift(spark, sf):
    frame = materialize(C.frame(spark, sf))
    lab = ic.forward_return(frame, 1, "label", C.dates(spark, sf))
    return rounded(U.augmented_uplift(lab, ["volume", "amount", "close"], ["mom_1", "mom_3", "vol_6"], "1995-01-01", "2001-12-31"))


@query("ts_udf", f"""{V.dense_sql()} SELECT code, trade_time, v AS spread FROM (SELECT *, {_framed("max", "close", 6, 1)} - {_framed("min", "close", 6, 1)} AS v FROM dense)
    WHERE observed""")
def ts_udf(spark, sf):
    """Rolling range in pandas, segment by segment."""

    def spread(pdf: pd.DataFrame) -> pd.Series:
        roll = pdf["close"].rolling(6, min_periods=1)
        return roll.max() - roll.min()

    got = S.ts_udf(
        V.bars(spark, sf), spread, "spread", 5, segment=24, times=V.calendar(spark, sf), codes=V.codes(spark, sf)
    )
    return got.select("code", "trade_time", "spread")


@query("cs_udf", f"""{BW} SELECT code, trade_time, {out("volume - quantile_cont(volume, 0.5) OVER (PARTITION BY trade_time)", "centered")} FROM bars""")
def cs_udf(spark, sf):
    """Volume less the median of its date, in pandas."""

    def centered(pdf: pd.DataFrame) -> pd.Series:
        return pdf["volume"] - pdf["volume"].median()

    return rounded(S.cs_udf(V.bars(spark, sf).select(*P.KEYS, "volume"), centered, "centered").select("code", "trade_time", "centered"))


@query("signal_evaluation", f"""{C.frame_sql()}, u AS (SELECT 'signal_1' AS slot, mom_1 AS s FROM frame UNION ALL SELECT 'signal_2', vol_6 FROM frame)
    SELECT slot, count(s) AS known, {out("avg(s)", "mean")}, {out("stddev_samp(s)", "std")} FROM u GROUP BY 1""")
def signal_evaluation(spark, sf):
    df = C.frame(spark, sf).select(*P.KEYS, *P.FIELDS, F.col("mom_1").alias("signal_1"), F.col("vol_6").alias("signal_2"))

    def size(frame, s):
        return [F.count(s).alias("known")]

    def spread(frame, s):
        return [F.avg(s).alias("mean"), F.stddev_samp(s).alias("std")]

    return rounded(S.evaluate_signals(df, [size, spread]))


@query("strategy_evaluation", f"""WITH trades AS ({V.TRADES_SQL}), fills AS ({V.FILLS_SQL}),
    a AS (SELECT count(*) FILTER (WHERE pnlcomm > 0) AS win, count(*) AS closed FROM trades), b AS (SELECT count(*) AS n_fills FROM fills)
    SELECT 'trades' AS part, 'closed' AS metric, closed::DOUBLE AS value FROM a UNION ALL SELECT 'trades', 'win', win FROM a
    UNION ALL SELECT 'trades', 'loss', (SELECT count(*) FROM trades WHERE pnlcomm < 0) UNION ALL SELECT 'trades', 'win_rate', {out("win / closed", "x")[:-5]} FROM a
    UNION ALL SELECT 'fills', 'n_fills', n_fills FROM b""")
def strategy_evaluation(spark, sf):
    count = lambda f: f.agg(F.count("*").alias("n_fills"))
    got = S.evaluate_strategy(V.trades(spark, sf), V.fills(spark, sf), T.win_rate, count)
    return got.withColumn("value", rnd("value"))
