"""Time-series and cross-section function queries (two clocks: the dense calendar here)."""

from pyspark.sql import functions as F

from ..functions import cs, ts
from ..functions.numeric import rnd
from ..operators import library_factors as lib
from ..operators import panel as P
from . import views as V
from .registry import out, query


def _ts(spark, sf, lookback, *stages, digits=6, unit="month"):
    df = V.dense(spark, sf, lookback, unit)
    for stage in stages:
        df = df.withColumns(stage)
    return df.where(~F.col("halo")).select(
        "code", "trade_time", *[(rnd(c, digits) if digits else F.col(c)).alias(c) for c in stages[-1]]
    )


def _sql(*cols, extra="", source="dense", digits=6, unit="month"):
    body = ", ".join(out(e, a, digits) if digits else f"{e} AS {a}" for e, a in cols)
    return f"{V.dense_sql(unit)}{extra} SELECT code, trade_time, {body} FROM {source} WINDOW w AS (PARTITION BY code ORDER BY trade_time)"


def _framed(fn, x, n, need=None):
    over = f"OVER (PARTITION BY code ORDER BY trade_time ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {over} >= {need or n} THEN {fn}({x}) {over} END"


def _ret(x, k):
    return f"{x} / nullif(lag({x}, {k}) OVER w, 0) - 1"


@query("ts_shift", _sql(("lag(close, 1) OVER w", "lag_1"), ("lag(volume, 5) OVER w", "lag_5"), unit="week", digits=0))
def ts_shift(spark, sf):
    return _ts(
        spark,
        sf,
        5,
        {"lag_1": ts.ts_shift("close", 1), "lag_5": ts.ts_shift("volume", 5)},
        unit="week",
        digits=0,
    )


@query("ts_return", _sql((_ret("close", 1), "ret_1"), (_ret("close", 5), "ret_5"), unit="week"))
def ts_return(spark, sf):
    return _ts(
        spark, sf, 5, {"ret_1": ts.ts_return("close", 1), "ret_5": ts.ts_return("close", 5)}, unit="week"
    )


@query(
    "ts_return_padded",
    _sql(
        (_ret("close", 1), "ret_1"),
        extra=""", padded AS (SELECT code, trade_time, last_value(close IGNORE NULLS) OVER
          (PARTITION BY code ORDER BY trade_time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS close FROM dense)""",
        source="padded",
        unit="week",
    ),
)
def ts_return_padded(spark, sf):
    df = P.pad(V.dense(spark, sf, 1, "week", ["close"]), "close", 1)
    df = df.withColumn("ret_1", ts.ts_return("close", 1))
    return df.where(~F.col("halo")).select("code", "trade_time", rnd("ret_1").alias("ret_1"))


@query("ts_diff", _sql(("close - lag(close, 3) OVER w", "diff_3"), digits=0))
def ts_diff(spark, sf):
    return _ts(spark, sf, 3, {"diff_3": ts.ts_diff("close", 3)}, digits=0)


def _rolling(name, fn, agg, col="close", digits=6):
    sql = _sql(
        (_framed(agg, col, 6), f"{name}_6"),
        (_framed(agg, col, 12, 3), f"{name}_12_3"),
        unit="week",
        digits=digits,
    )

    @query(f"ts_{name}", sql)
    def run(spark, sf):
        stage = {f"{name}_6": fn(col, 6), f"{name}_12_3": fn(col, 12, 3)}
        return _ts(spark, sf, 11, stage, unit="week", digits=digits)


_rolling("mean", ts.ts_mean, "avg", "volume")
_rolling("sum", ts.ts_sum, "sum", "amount", 2)
_rolling("std", ts.ts_std, "stddev_samp")
_rolling("min", ts.ts_min, "min", digits=0)
_rolling("max", ts.ts_max, "max", digits=0)


@query(
    "ts_zscore",
    _sql(
        (
            f"CASE WHEN ({_framed('stddev_samp', 'close', 12, 6)}) > 1e-12 THEN "
            f"(close - ({_framed('avg', 'close', 12, 6)})) / ({_framed('stddev_samp', 'close', 12, 6)}) END",
            "zscore",
        )
    ),
)
def ts_zscore(spark, sf):
    return _ts(spark, sf, 11, {"zscore": ts.ts_zscore("close", 12, 6)})


@query(
    "ts_vwap",
    _sql(
        (f"({_framed('sum', 'close * volume', 6, 1)}) / nullif({_framed('sum', 'volume', 6, 1)}, 0)", "vwap"),
        unit="week",
    ),
)
def ts_vwap(spark, sf):
    return _ts(spark, sf, 5, {"vwap": ts.ts_vwap("close", "volume", 6)}, unit="week")


@query(
    "ts_ewm",
    f"""{V.dense_sql("week")}
    SELECT a.code, a.trade_time,
      {out("sum(power(0.7, a.t - b.t) * b.close) / sum(power(0.7, a.t - b.t))", "ewm")}
    FROM dense a LEFT JOIN dense b ON a.code = b.code AND b.t <= a.t AND b.close IS NOT NULL
    GROUP BY 1, 2""",
)
def ts_ewm(spark, sf):
    dates = V.calendar(spark, sf, "week").count()
    df = P.ewm(V.dense(spark, sf, 2 * ts.ewm_block(0.3), "week"), "close", "ewm", 0.3, dates=dates)
    return df.where(~F.col("halo")).select("code", "trade_time", rnd("ewm").alias("ewm"))


@query(
    "ts_breakout",
    _sql(
        ("close / nullif(CASE WHEN count(high) OVER p >= 12 THEN max(high) OVER p END, 0) - 1", "over_high"),
        ("close / nullif(CASE WHEN count(low) OVER p >= 12 THEN min(low) OVER p END, 0) - 1", "over_low"),
    )
    + ", p AS (PARTITION BY code ORDER BY trade_time ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)",
)
def ts_breakout(spark, sf):
    top, bottom = ts.ts_breakout("close", "high", "low", 12)
    return _ts(spark, sf, 12, {"over_high": top, "over_low": bottom})


RET1 = f", step AS (SELECT *, {_ret('close', 1)} AS ret1 FROM dense WINDOW w AS (PARTITION BY code ORDER BY trade_time))"


@query(
    "ts_volatility",
    _sql(
        (
            f"CASE WHEN abs({_framed('stddev_samp', 'ret1', 6, 3)}) >= 1e-12 "
            f"THEN ({_framed('stddev_samp', 'ret1', 6, 3)}) END",
            "vol",
        ),
        extra=RET1,
        source="step",
    ),
)
def ts_volatility(spark, sf):
    return V.factor_frame(spark, sf, [lib.volatility(6, "vol")], dense_rows=True).select(
        "code", "trade_time", rnd("vol").alias("vol")
    )


def pct_rank_sql(x, part="trade_time"):
    """Average-tie rank over the non-null count, NULL for NULL."""
    return (
        f"CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY {part} ORDER BY {x} ASC NULLS LAST) "
        f"+ (count(*) OVER (PARTITION BY {part}, {x}) - 1) / 2.0) / count({x}) OVER (PARTITION BY {part}) END"
    )


@query("cs_pct_rank", _sql((pct_rank_sql("volume"), "volume_rank"), (pct_rank_sql("close"), "close_rank"), unit="week"))
def cs_pct_rank(spark, sf):
    stage = {"volume_rank": cs.cs_pct_rank("volume"), "close_rank": cs.cs_pct_rank("close")}
    return _ts(spark, sf, 0, stage, unit="week")


def case_sql(fast, slow, need):
    """CTE chain ending in `factor(code, trade_time, t, observed, close, score)` on the dense calendar."""
    return f""", step AS (SELECT *, {_ret('close', fast)} AS fast, {_ret('close', slow)} AS slow,
        {_ret('close', 1)} AS ret1, {_framed('avg', 'amount', slow, need)} AS liq FROM dense
        WINDOW w AS (PARTITION BY code ORDER BY trade_time)),
      step2 AS (SELECT *, {_framed('stddev_samp', 'ret1', slow, need)} AS vol, {pct_rank_sql('liq')} AS liq_rank FROM step),
      factor AS (SELECT code, trade_time, t, observed, close, CASE WHEN liq_rank >= 0.2 AND vol >= 1e-12
        THEN (fast - slow) / vol END AS score FROM step2)"""


@query(
    "case_momentum_vol",
    f"""{V.dense_sql()}{case_sql(5, 20, 10)}
    SELECT code, trade_time, {out("score", "case_momentum_vol")} FROM factor WHERE observed""",
)
def case_momentum_vol(spark, sf):
    return V.factor_frame(spark, sf, [lib.case_momentum_vol()]).select(
        "code", "trade_time", rnd("case_momentum_vol").alias("case_momentum_vol")
    )


@query(
    "factor_shift",
    f"""{V.dense_sql("week")}{case_sql(5, 20, 10)},
    shifted AS (SELECT code, trade_time, observed, lag(score, 1) OVER (PARTITION BY code ORDER BY trade_time) AS score FROM factor)
    SELECT code, trade_time, {out("score", "factor")} FROM shifted WHERE observed""",
)
def factor_shift(spark, sf):
    frame = V.factor_frame(spark, sf, [lib.case_momentum_vol(name="factor")], shift=1, unit="week")
    return frame.select("code", "trade_time", rnd("factor").alias("factor"))


@query("momentum", _sql((_ret("close", 20), "momentum"), unit="week"))
def momentum(spark, sf):
    return V.factor_frame(spark, sf, [lib.momentum(20, "momentum")], unit="week", dense_rows=True).select(
        "code", "trade_time", rnd("momentum").alias("momentum")
    )


@query("mean_reversion", _sql((f"-({_ret('close', 10)})", "mean_reversion")))
def mean_reversion(spark, sf):
    return V.factor_frame(spark, sf, [lib.mean_reversion(10, "mean_reversion")], dense_rows=True).select(
        "code", "trade_time", rnd("mean_reversion").alias("mean_reversion")
    )


@query(
    "liq_momentum",
    f"""{V.dense_sql()},
    step AS (SELECT *, {_ret('close', 5)} AS ret, {_framed('avg', 'amount', 20, 10)} AS amt FROM dense
      WINDOW w AS (PARTITION BY code ORDER BY trade_time)),
    ranked AS (SELECT *, {pct_rank_sql('ret')} AS rr, {pct_rank_sql('amt')} AS ar FROM step)
    SELECT code, trade_time, {out("CASE WHEN ar >= 0.2 THEN rr * ar END", "liq_momentum")} FROM ranked WHERE observed""",
)
def liq_momentum(spark, sf):
    return V.factor_frame(spark, sf, [lib.liq_momentum()]).select(
        "code", "trade_time", rnd("liq_momentum").alias("liq_momentum")
    )
