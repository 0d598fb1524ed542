"""Trade, fill, path and portfolio queries."""

import uuid

from pyspark.sql import functions as F

from ..functions.numeric import rnd
from ..operators import panel as P
from ..operators import paths as R
from ..operators import trades as T
from ..session import materialize, shared_dir
from . import cands as C
from . import views as V
from .evaluation import rounded
from .registry import out, query

TW = f"WITH trades AS ({V.TRADES_SQL})"
FW = f"WITH fills AS ({V.FILLS_SQL})"
ORDERED = "(ORDER BY dt_open, ref ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
EQUITY = f"""{TW}, eq AS (SELECT *, 1 + sum(pnlcomm) OVER {ORDERED} AS equity FROM trades),
    dd AS (SELECT *, max(equity) OVER {ORDERED} AS peak FROM eq),
    runs AS (SELECT pnlcomm, sum(CASE WHEN pnlcomm >= 0 THEN 1 ELSE 0 END) OVER {ORDERED} AS run FROM trades),
    streak AS (SELECT coalesce(max(n), 0) AS n FROM (SELECT count(*) AS n FROM runs WHERE pnlcomm < 0 GROUP BY run))"""
WIN = "avg(CASE WHEN pnlcomm > 0 THEN 1.0 ELSE 0.0 END)"
AW, AL = "avg(pnlcomm) FILTER (WHERE pnlcomm > 0)", "avg(pnlcomm) FILTER (WHERE pnlcomm < 0)"
GAIN, LOSS = "sum(pnlcomm) FILTER (WHERE pnlcomm > 0)", "-sum(pnlcomm) FILTER (WHERE pnlcomm < 0)"


@query("trade_report", f"""{EQUITY} SELECT count(*) AS n_trades, {out(WIN, "win_rate")}, {out(AW, "avg_win", 4)}, {out(AL, "avg_loss", 4)},
    {out(f"{GAIN} / ({LOSS})", "profit_factor")}, {out(f"{WIN} * {AW} + (1 - {WIN}) * {AL}", "expectancy", 4)},
    {out("avg(is_liq)", "liq_ratio")}, {out(f"{WIN} - (1 - {WIN}) / abs({AW} / {AL})", "kelly")},
    (SELECT {out("min(equity - peak)", "d", 2)[:-5]} FROM dd) AS max_drawdown, (SELECT n FROM streak) AS loss_streak FROM trades""")
def trade_report(spark, sf):
    rep = T.trade_report(V.trades(spark, sf))
    four = {c: rnd(c, 4) for c in ("avg_win", "avg_loss", "expectancy")}
    six = {c: rnd(c) for c in ("win_rate", "profit_factor", "liq_ratio", "kelly")}
    return rep.withColumns({**four, **six, "max_drawdown": rnd("max_drawdown", 2)})


@query("drawdown", f"""{EQUITY} SELECT ref, {out("equity", "equity", 5)}, {out("peak", "peak", 5)}, {out("equity - peak", "drawdown", 5)} FROM dd""")
def drawdown(spark, sf):
    return rounded(T.equity(V.trades(spark, sf)).select("ref", "equity", "peak", "drawdown"), digits=5)


@query("loss_streak", f"{EQUITY} SELECT n AS loss_streak FROM streak")
def loss_streak(spark, sf):
    return T.loss_streak(V.trades(spark, sf))


@query("pnl_moments", f"{TW} SELECT {out('skewness(pnlcomm)', 'skew')}, {out('kurtosis(pnlcomm)', 'kurtosis')} FROM trades")
def pnl_moments(spark, sf):
    return rounded(T.moments(V.trades(spark, sf), "pnlcomm"))


@query("pnl_autocorr", f"""{TW}, l AS (SELECT pnlcomm AS x, lag(pnlcomm, 3) OVER (ORDER BY dt_open, ref) AS y FROM trades)
    SELECT {out(C.corr_sql("x", "y"), "autocorr")} FROM l WHERE y IS NOT NULL""")
def pnl_autocorr(spark, sf):
    return rounded(T.autocorr(V.trades(spark, sf), 3))


@query("holding_stats", f"""{TW}, r AS (SELECT 'all' AS outcome, barlen FROM trades UNION ALL SELECT 'win', barlen FROM trades WHERE pnlcomm > 0
    UNION ALL SELECT 'loss', barlen FROM trades WHERE pnlcomm < 0)
    SELECT outcome, {out("avg(barlen)", "mean")}, {out("max(barlen)", "max")}, count(*) AS count,
    {", ".join(out(f"quantile_cont(CAST(barlen AS DOUBLE), {q})", n) for n, q in T.HOLDING.items())} FROM r GROUP BY 1""")
def holding_stats(spark, sf):
    return rounded(T.holding_stats(V.trades(spark, sf)))


@query("exact_percentiles", f"""{TW} SELECT is_liq, {out("quantile_cont(pnlcomm, 0.1)", "p10")}, {out("quantile_cont(pnlcomm, 0.5)", "p50")},
    {out("quantile_cont(pnlcomm, 0.99)", "p99")} FROM trades GROUP BY 1""")
def exact_percentiles(spark, sf):
    return T.exact_percentiles(V.trades(spark, sf), ["is_liq"], "pnlcomm", {"p10": 0.1, "p50": 0.5, "p99": 0.99}).select(
        "is_liq", *[rnd(c).alias(c) for c in ("p10", "p50", "p99")]
    )


@query("top_trades", f"""{TW}, b AS (SELECT ref, pnlcomm, 'best' AS side FROM trades ORDER BY pnlcomm DESC, dt_open, ref LIMIT 5),
    w AS (SELECT ref, pnlcomm, 'worst' AS side FROM trades ORDER BY pnlcomm, dt_open, ref LIMIT 5)
    SELECT ref, side, {out("pnlcomm", "pnlcomm", 4)} FROM (SELECT * FROM b UNION ALL SELECT * FROM w)""")
def top_trades(spark, sf):
    return T.top_trades(V.trades(spark, sf)).select("ref", "side", rnd("pnlcomm", 4).alias("pnlcomm"))


@query("cost_drag", f"""{TW} SELECT count(*) AS n_trades, {out("sum(pnl)", "gross_pnl", 2)}, {out("sum(pnlcomm)", "net_pnl", 2)},
    {out("sum(commission)", "commission", 2)}, {out("avg(pnl)", "avg_gross", 3)}, {out("avg(pnlcomm)", "avg_net", 3)},
    {out("avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0.0 END)", "gross_win_rate")}, {out(WIN, "net_win_rate")},
    {out("sum(pnl) - sum(pnlcomm)", "cost_drag", 2)}, {out("(sum(pnl) - sum(pnlcomm)) / abs(sum(pnl))", "cost_drag_ratio")} FROM trades""")
def cost_drag(spark, sf):
    digits = {"gross_win_rate": 6, "net_win_rate": 6, "cost_drag_ratio": 6, "avg_gross": 3, "avg_net": 3}
    df = T.cost_drag(V.trades(spark, sf))
    return df.select("n_trades", *[rnd(c, digits.get(c, 2)).alias(c) for c in df.columns if c != "n_trades"])


@query("win_rate", f"""{TW} SELECT count(*) AS closed, count(*) FILTER (WHERE pnlcomm > 0) AS win, count(*) FILTER (WHERE pnlcomm < 0) AS loss,
    {out(WIN, "win_rate")} FROM trades""")
def win_rate(spark, sf):
    return rounded(T.win_rate(V.trades(spark, sf)))


@query("commission_by_code", f"""{TW} SELECT code, {out("sum(commission)", "commission", 5)}, count(*) AS n_trades FROM trades GROUP BY ROLLUP (code)""")
def commission_by_code(spark, sf):
    return rounded(T.commission_by_code(V.trades(spark, sf)), digits=5)


@query("pnl_histogram", f"""{TW}, s AS (SELECT min(pnlcomm) AS lo, max(pnlcomm) AS hi, greatest(1, CAST(floor(sqrt(count(*))) AS INTEGER)) AS bins FROM trades),
    g AS (SELECT least(CAST(floor((pnlcomm - lo) / ((hi - lo) / bins)) AS INTEGER), bins - 1) AS bin, count(*) AS n FROM trades, s GROUP BY 1),
    slots AS (SELECT lo, hi, bins, CAST(unnest(range(bins)) AS INTEGER) AS bin FROM s)
    SELECT bin, {out("lo + bin * (hi - lo) / bins", "left_edge", 4)}, {out("lo + (bin + 1) * (hi - lo) / bins", "right_edge", 4)}, coalesce(n, 0) AS count
    FROM slots LEFT JOIN g USING (bin)""")
def pnl_histogram(spark, sf):
    return T.pnl_histogram(V.trades(spark, sf)).select(
        "bin", rnd("left_edge", 4).alias("left_edge"), rnd("right_edge", 4).alias("right_edge"), "count"
    )


@query("barlen_histogram", f"""{TW} SELECT CASE WHEN pnlcomm > 0 THEN 'win' ELSE 'loss' END AS outcome, barlen, count(*) AS count
    FROM trades WHERE pnlcomm <> 0 GROUP BY 1, 2""")
def barlen_histogram(spark, sf):
    return T.histogram_by_outcome(V.trades(spark, sf))


@query("minmax_norm", f"""{TW}, m AS (SELECT code, min(pnlcomm) AS lo, max(pnlcomm) AS hi FROM trades GROUP BY 1)
    SELECT ref, {out("CASE WHEN hi = lo THEN 0 ELSE (pnlcomm - lo) / (hi - lo) END", "norm")},
    {out("(pnlcomm - min(lo) OVER ()) / (max(hi) OVER () - min(lo) OVER ())", "global_norm")} FROM trades JOIN m USING (code)""")
def minmax_norm(spark, sf):
    df = T.minmax(V.trades(spark, sf), "pnlcomm", ["code"])
    return rounded(T.minmax(df, "pnlcomm", out="global_norm").select("ref", "norm", "global_norm"))


PREPARED = """prepared AS (SELECT *, CASE WHEN size >= 0 THEN size * CASE WHEN side = 'BUY' THEN 1 ELSE -1 END ELSE size END AS signed_size,
    abs(size) AS abs_size, abs(value) AS notional FROM fills)"""


@query("fill_report", f"""{FW}, {PREPARED} SELECT count(*) AS n_fills, {out("sum(abs_size)", "volume", 2)}, {out("sum(notional)", "notional", 2)},
    {out("sum(commission)", "commission", 3)}, {out("avg(commission)", "avg_commission", 5)},
    {out("sum(commission) / sum(notional)", "commission_per_notional")}, {out("sum(price * abs_size) / sum(abs_size)", "vwap")},
    {out("avg(abs_size)", "avg_size")}, {out("max(abs_size)", "max_size")}, {out("median(abs_size)", "median_size")},
    {out("avg(is_liq)", "liq_ratio")}, CAST(sum(is_liq) AS BIGINT) AS liq_count FROM prepared""")
def fill_report(spark, sf):
    digits = {"volume": 2, "notional": 2, "commission": 3, "avg_commission": 5}
    df = T.fill_report(V.fills(spark, sf))
    return df.select(*[F.col(c) if t != "double" else rnd(c, digits.get(c, 6)).alias(c) for c, t in df.dtypes])


@query("fill_by_side", f"""{FW}, {PREPARED} SELECT side, count(*) AS n_fills, {out("sum(notional)", "notional", 2)},
    {out("sum(price * abs_size) / sum(abs_size)", "vwap")} FROM prepared GROUP BY 1""")
def fill_by_side(spark, sf):
    return T.fill_by_side(V.fills(spark, sf)).select(
        "side", "n_fills", rnd("notional", 2).alias("notional"), rnd("vwap").alias("vwap")
    )


@query("signed_size", f"""{FW} SELECT ref, dt, size, CASE WHEN side = 'BUY' THEN size ELSE -size END AS signed_size,
    abs(size) * price AS notional FROM fills""")
def signed_size(spark, sf):
    """The value column is all missing here, so the notional is size times price."""
    raw = V.fills(spark, sf).withColumn("value", F.lit(None).cast("double"))
    return T.prepare_fills(raw.withColumn("side", F.concat(F.lit(" "), F.lower("side")))).select(
        "ref", "dt", "size", "signed_size", "notional"
    )


@query("weighted_avg", f"""{FW} SELECT reason, {out("sum(price * commission) / nullif(sum(commission), 0)", "avg_price")} FROM fills GROUP BY 1""")
def weighted_avg(spark, sf):
    return rounded(V.fills(spark, sf).groupBy("reason").agg(T.weighted_avg("price", "commission").alias("avg_price")))


@query("reason_topn", f"{FW} SELECT reason, count(*) AS count FROM fills GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def reason_topn(spark, sf):
    return T.reason_topn(V.fills(spark, sf), 5)


def _csv(df, spark, kind):
    path = f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    df.write.option("header", True).csv(path)
    return spark.read.option("header", True).schema(", ".join(f"`{c}` string" for c in df.columns)).csv(path)


@query("trade_log_scan", f"""{TW} SELECT ref, dt_open, CASE WHEN ref % 11 = 0 THEN NULL ELSE barlen END AS barlen,
    CASE WHEN ref % 7 = 0 THEN NULL ELSE pnl END AS pnl, CASE WHEN ref % 5 = 0 THEN 0 ELSE is_liq END AS is_liq FROM trades""")
def trade_log_scan(spark, sf):
    """CSV log with broken cells: they become NULL, a missing is_liq becomes 0."""
    ref = F.col("ref")
    text = V.trades(spark, sf).select(
        "ref",
        F.date_format("dt_open", "yyyy-MM-dd HH:mm:ss").alias("dt_open"),
        F.when(ref % 11 == 0, "n/a").otherwise(F.col("barlen").cast("string")).alias("barlen"),
        F.when(ref % 7 == 0, "broken").otherwise(F.col("pnl").cast("string")).alias("pnl"),
        F.when(ref % 5 == 0, None).otherwise(F.col("is_liq").cast("string")).alias("is_liq"),
    )
    return T.clean_trades(_csv(text, spark, "trades"))


@query("fill_log_scan", f"""{FW} SELECT ref, dt, side, size, CASE WHEN ref % 7 = 0 THEN NULL ELSE price END AS price,
    CASE WHEN ref % 5 = 0 THEN 0 ELSE is_liq END AS is_liq FROM fills""")
def fill_log_scan(spark, sf):
    ref = F.col("ref")
    text = V.fills(spark, sf).select(
        "ref",
        F.date_format("dt", "yyyy-MM-dd HH:mm:ss").alias("dt"),
        F.concat(F.lit(" "), F.lower("side"), F.lit(" ")).alias("side"),
        F.col("size").cast("string").alias("size"),
        F.when(ref % 7 == 0, "??").otherwise(F.col("price").cast("string")).alias("price"),
        F.when(ref % 5 == 0, None).otherwise(F.col("is_liq").cast("string")).alias("is_liq"),
    )
    return T.clean_fills(_csv(text, spark, "fills"))


# paths: a daily report from orders


def report(spark, sf):
    total = F.col("o_totalprice")
    urgent = F.when(F.col("o_orderpriority") == "1-URGENT", total)
    return (
        V.table(spark, sf, "orders")
        .groupBy(F.col("o_orderdate").alias("datetime"))
        .agg(
            ((F.avg(total) - 250000) / 1e7).alias("return"),
            (F.max(total) / 1e9).alias("cost"),
            ((F.avg(urgent) - 250000) / 1e7).alias("bench"),
        )
    )


REPORT = """WITH report AS (SELECT o_orderdate AS datetime, (avg(o_totalprice) - 250000) / 1e7 AS "return", max(o_totalprice) / 1e9 AS cost,
      (avg(o_totalprice) FILTER (WHERE o_orderpriority = '1-URGENT') - 250000) / 1e7 AS bench FROM orders GROUP BY 1),
    daily AS (SELECT datetime, "return" AS strategy_return, "return" - cost AS strategy_return_after_cost, coalesce(bench, 0) AS benchmark_return,
      "return" - cost - coalesce(bench, 0) AS excess_return_after_cost FROM report)"""
RUN = "(ORDER BY datetime ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


@query("return_curve", f"""{REPORT} SELECT datetime, {", ".join(out(f"exp(sum(ln(1 + {c})) OVER {RUN}) - 1", c) for c in R.SERIES)} FROM daily""")
def return_curve(spark, sf):
    return rounded(R.return_curve(report(spark, sf)))


@query("cum_return", f"""{REPORT} SELECT {", ".join(out(f"exp(sum(ln(1 + {c}))) - 1", c) for c in R.SERIES)} FROM daily""")
def cum_return(spark, sf):
    return rounded(R.total_return(R.daily_series(report(spark, sf)), [], R.SERIES))


@query("max_drawdown_ratio", f"""{REPORT}, w AS (SELECT datetime, exp(sum(ln(1 + strategy_return)) OVER {RUN}) AS v FROM daily),
    p AS (SELECT v, greatest(1, max(v) OVER {RUN}) AS peak FROM w) SELECT {out("least(0, min(v / peak - 1))", "max_drawdown")} FROM p""")
def max_drawdown_ratio(spark, sf):
    return rounded(R.max_drawdown_ratio(R.daily_series(report(spark, sf)), ["datetime"], "strategy_return"))


LONG_DAILY = " UNION ALL ".join(f"SELECT datetime, '{c}' AS series, {c} AS r FROM daily" for c in R.SERIES)


@query("risk_table", f"""{REPORT}, long AS ({LONG_DAILY}),
    c AS (SELECT *, sum(r) OVER (PARTITION BY series ORDER BY datetime ROWS UNBOUNDED PRECEDING) AS cum FROM long),
    p AS (SELECT *, max(cum) OVER (PARTITION BY series ORDER BY datetime ROWS UNBOUNDED PRECEDING) AS peak FROM c)
    SELECT series, {out("avg(r)", "mean", 9)}, {out("stddev_samp(r)", "std", 9)}, {out("avg(r) * 238", "annualized_return")},
    {out("avg(r) / stddev_samp(r) * sqrt(238)", "information_ratio")}, {out("min(cum - peak)", "max_drawdown")} FROM p GROUP BY 1""")
def risk_table(spark, sf):
    df = R.risk_table(report(spark, sf))
    return df.select("series", *[rnd(c, 9 if c in ("mean", "std") else 6).alias(c) for c in df.columns[1:]])


@query("sharpe", f"""{REPORT} SELECT {out("avg(strategy_return) / stddev_samp(strategy_return) * sqrt(365)", "sharpe")} FROM daily""")
def sharpe(spark, sf):
    return rounded(R.sharpe(R.daily_series(report(spark, sf)), "strategy_return"))


@query("excess_ratio", f"""{REPORT} SELECT {out("exp(sum(ln(1 + strategy_return))) / exp(sum(ln(1 + benchmark_return))) - 1", "excess")} FROM daily""")
def excess_ratio(spark, sf):
    return rounded(R.excess_ratio(R.daily_series(report(spark, sf)), "strategy_return", "benchmark_return"))


def _sides(spark, sf):
    """The strategy trades on all days, the benchmark exists on days with urgent orders only."""
    rep = report(spark, sf)
    return rep.select("datetime", F.col("return").alias("r")), rep.where("bench IS NOT NULL").select(
        "datetime", F.col("bench").alias("r")
    )


RELATIVE = f"""{REPORT}, s AS (SELECT datetime, exp(sum(ln(1 + "return")) OVER {RUN}) AS ws FROM report),
    b AS (SELECT datetime, exp(sum(ln(1 + bench)) OVER {RUN}) AS wb FROM report WHERE bench IS NOT NULL),
    rel AS (SELECT datetime, ws, wb, ws / wb AS w_rel FROM s JOIN b USING (datetime))"""


@query("relative_equity", f"""{RELATIVE} SELECT datetime, {out("ws", "ws")}, {out("wb", "wb")}, {out("w_rel", "w_rel")}, {out("w_rel - 1", "outperf")} FROM rel""")
def relative_equity(spark, sf):
    return rounded(R.relative_equity(*_sides(spark, sf)))


@query("benchmark_align", f"""{REPORT} SELECT datetime, {out('"return"', "r")}, {out("bench", "b")} FROM report WHERE bench IS NOT NULL""")
def benchmark_align(spark, sf):
    left, right = _sides(spark, sf)
    return rounded(left.join(right.withColumnRenamed("r", "b"), "datetime"))


@query("path_score", f"""{RELATIVE}, p AS (SELECT w_rel, max(w_rel) OVER {RUN} AS peak FROM rel)
    SELECT {out("min(w_rel)", "min")}, {out("greatest(0, 1 - min(w_rel))", "max_shortfall")},
    {out("sum(greatest(0, 1 - w_rel))", "violation_area")}, {out("max(1 - w_rel / peak)", "rel_mdd")} FROM p""")
def path_score(spark, sf):
    return rounded(R.path_score(R.relative_equity(*_sides(spark, sf))))


@query("minute_grid_ffill", """WITH one AS (SELECT event_type, ts, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2),
    e AS (SELECT event_type, min(ts) AS a, max(ts) AS b FROM one GROUP BY 1),
    grid AS (SELECT event_type, unnest(generate_series(date_trunc('minute', a) + INTERVAL 1 MINUTE, b, INTERVAL 1 MINUTE)) AS minute FROM e)
    SELECT g.event_type, g.minute, o.value FROM grid g ASOF JOIN one o ON g.event_type = o.event_type AND g.minute >= o.ts""")
def minute_grid_ffill(spark, sf):
    return R.minute_grid(V.table(spark, sf, "events"), ["event_type"], "ts", "event_id", "value")


# top-k portfolio over the monthly panel

SCORED = f"""{V.dense_sql()}{C.case_sql(5, 20, 10)},
    scored AS (SELECT code, trade_time, close, score, lead(close) OVER (PARTITION BY code ORDER BY trade_time) / nullif(close, 0) - 1 AS next_return
      FROM factor WHERE observed)"""
SIZES = "sizes AS (SELECT trade_time, count(*) AS n FROM scored WHERE score IS NOT NULL GROUP BY 1)"
TOPK = f"""{SCORED}, {SIZES}, k AS (SELECT greatest(1, least(20, min(n))) AS k FROM sizes),
    placed AS (SELECT *, row_number() OVER (PARTITION BY trade_time ORDER BY score DESC, code) AS place FROM scored WHERE score IS NOT NULL),
    held AS (SELECT placed.* FROM placed, k WHERE place <= k)"""


def _scored(spark, sf):
    return V.factor_frame(spark, sf, [C.lib.case_momentum_vol(name="score")]).select(*P.KEYS, "close", "score")


@query("min_daily_names", f"""{SCORED}, {SIZES} SELECT min(n) AS min_daily_names, greatest(1, least(50, min(n))) AS topk,
    greatest(0, least(5, greatest(1, least(50, min(n))))) AS n_drop FROM sizes""")
def min_daily_names(spark, sf):
    return R.min_daily_names(_scored(spark, sf))


@query("daily_topk", f"{TOPK} SELECT trade_time, code, {out('score', 'score')}, place FROM held")
def daily_topk(spark, sf):
    return rounded(R.daily_topk(materialize(_scored(spark, sf)), 20).select("trade_time", "code", "score", "place"))


@query("topk_portfolio", f"""{TOPK}, days AS (SELECT trade_time, lag(trade_time) OVER (ORDER BY trade_time) AS prior
      FROM (SELECT DISTINCT trade_time FROM scored)),
    size AS (SELECT trade_time, avg(coalesce(next_return, 0)) AS r, count(*) AS held FROM held GROUP BY 1),
    stay AS (SELECT h.trade_time, count(*) AS stay FROM held h JOIN days USING (trade_time) JOIN held p ON p.trade_time = prior AND p.code = h.code GROUP BY 1),
    bench AS (SELECT trade_time, avg(coalesce(next_return, 0)) AS bench FROM scored GROUP BY 1),
    moves AS (SELECT s.*, (s.held - coalesce(stay, 0)) / s.held AS bought, coalesce((p.held - coalesce(stay, 0)) / p.held, 0) AS sold
      FROM size s JOIN days USING (trade_time) LEFT JOIN stay USING (trade_time) LEFT JOIN size p ON p.trade_time = prior)
    SELECT trade_time AS datetime, {out("r", "return")[:-6]} "return", {out("bought * 0.0005 + sold * 0.0015", "cost")}, {out("bench", "bench")},
      {out("bought + sold", "turnover")}, held FROM moves JOIN bench USING (trade_time)""")
def topk_portfolio(spark, sf):
    return rounded(R.topk_portfolio(materialize(_scored(spark, sf)), 20, dates=C.dates(spark, sf)))


@query("signal_backtest", f"""{V.dense_sql()}{C.case_sql(5, 20, 10)},
    obs AS (SELECT code, trade_time, close, sign(coalesce(score, 0)) AS sig FROM factor WHERE observed),
    p AS (SELECT *, coalesce(lag(sig) OVER w, 0) AS position, coalesce(close / lag(close) OVER w - 1, 0) AS move FROM obs
      WINDOW w AS (PARTITION BY code ORDER BY trade_time)),
    f AS (SELECT *, position * move - abs(position - coalesce(lag(position) OVER w, 0)) * 0.0005 AS pnl FROM p
      WINDOW w AS (PARTITION BY code ORDER BY trade_time)),
    e AS (SELECT *, 1 + sum(pnl) OVER (PARTITION BY code ORDER BY trade_time ROWS UNBOUNDED PRECEDING) AS equity FROM f),
    h AS (SELECT *, max(CASE WHEN position <> 0 AND equity <= abs(position) * 0.05 THEN 1 ELSE 0 END)
      OVER (PARTITION BY code ORDER BY trade_time ROWS UNBOUNDED PRECEDING) AS hit FROM e)
    SELECT code, trade_time, {out("position", "position")}, {out("pnl", "pnl")}, {out("equity", "equity")}, hit = 1 AS breached FROM h""")
def signal_backtest(spark, sf):
    frame = V.factor_frame(spark, sf, [C.lib.case_momentum_vol(name="score")]).select(*P.KEYS, "close", "score")
    run = R.signal_backtest(materialize(frame), "score")
    return rounded(run.select("code", "trade_time", "position", "pnl", "equity", "breached"))


