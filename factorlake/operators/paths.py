"""Return paths: compounding, drawdowns, relative equity, Sharpe and risk tables, top-k portfolio."""

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import nz, spread
from ..functions.scan import cut, merged_paths, neighbour, path_summary, scan
from .ic import forward_return
from .panel import KEYS, SEGMENT

SERIES = ["strategy_return", "strategy_return_after_cost", "benchmark_return", "excess_return_after_cost"]


def _log_growth(r):
    """log(1 + r), NULL for a wipe-out, which is tracked on its own."""
    r = F.coalesce(nz(r), F.lit(0.0))
    return F.when(r > -1, F.log1p(r)).otherwise(F.lit(0.0)), (r <= -1).cast("int")


def compound(df: DataFrame, part: Sequence[str], order: Sequence[str], cols: Sequence[str], suffix: str = "_cum") -> DataFrame:
    """Running prod(1 + r) - 1 of several return columns; a return of -100% ends a path at -1."""
    logs = {}
    for c in cols:
        logs[f"_l_{c}"], logs[f"_z_{c}"] = _log_growth(c)
    blocks = cut(df.withColumns(logs), part, order)
    run = scan(
        blocks, part, order, sums={f"_s_{c}": f"_l_{c}" for c in cols}, maxes={f"_d_{c}": f"_z_{c}" for c in cols}
    )
    out = {f"{c}{suffix}": F.when(F.col(f"_d_{c}") == 1, -1.0).otherwise(F.expm1(f"_s_{c}")) for c in cols}
    return run.select(*df.columns, *[v.alias(k) for k, v in out.items()])


def total_return(df: DataFrame, part: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """prod(1 + r) - 1 per group as one aggregation."""
    aggs = []
    for c in cols:
        log, dead = _log_growth(c)
        aggs.append(F.when(F.max(dead) == 1, -1.0).otherwise(F.expm1(F.sum(log))).alias(c))
    return df.groupBy(*part).agg(*aggs)


def daily_series(report: DataFrame) -> DataFrame:
    """return, cost, bench to the four daily series, nulls as zero."""
    r, c, b = (F.coalesce(nz(x), F.lit(0.0)) for x in ("return", "cost", "bench"))
    return report.select(
        "datetime",
        r.alias("strategy_return"),
        (r - c).alias("strategy_return_after_cost"),
        b.alias("benchmark_return"),
        (r - c - b).alias("excess_return_after_cost"),
    )


def return_curve(report: DataFrame) -> DataFrame:
    """Cumulative curve of the four series, all in one sort."""
    cum = compound(daily_series(report), [], ["datetime"], SERIES)
    return cum.select("datetime", *[F.col(f"{c}_cum").alias(c) for c in SERIES])


def max_drawdown_ratio(df: DataFrame, order: Sequence[str], col: str) -> DataFrame:
    """min of compounded equity over its running peak - 1; the path starts at 1."""
    log, dead = _log_growth(col)
    blocks = cut(df.select(*order, log.alias("_l"), dead.alias("_z")), [], order)
    whole = merged_paths(path_summary(blocks, [], order, "_l", extra={"dead": F.sum("_z")}), [], ["dead"], start=True)
    # logarithms: the deepest fall is a difference; a wipe-out is a fall to nothing
    low = F.when(F.max("dead") > 0, -1.0).otherwise(F.least(F.expm1(F.min("fall")), F.lit(0.0)))
    return whole.agg(low.alias("max_drawdown"))


def risk_table(report: DataFrame, periods: float = 238.0) -> DataFrame:
    """mean, std, annualised return, information ratio, max drawdown of the additive curve, per series."""
    long = daily_series(report).unpivot(["datetime"], SERIES, "series", "r")
    blocks = cut(long, ["series"], ["datetime"])
    falls = merged_paths(path_summary(blocks, ["series"], ["datetime"], "r"), ["series"])
    mean, std = F.avg("r"), F.stddev_samp("r")
    base = blocks.groupBy("series").agg(
        mean.alias("mean"),
        std.alias("std"),
        (mean * periods).alias("annualized_return"),
        (mean / spread(std, mean) * math.sqrt(periods)).alias("information_ratio"),
    )
    return base.join(falls.select("series", F.col("fall").alias("max_drawdown")), "series")


def sharpe(df: DataFrame, col: str, periods: int = 365, part: Sequence[str] = ()) -> DataFrame:
    std = F.stddev_samp(col)
    return df.groupBy(*part).agg((F.avg(col) / spread(std, F.avg(col)) * math.sqrt(periods)).alias("sharpe"))


def excess_ratio(df: DataFrame, strategy: str, bench: str) -> DataFrame:
    """(1 + Rs) / (1 + Rb) - 1 of the compounded returns."""
    tot = total_return(df, [], [strategy, bench])
    return tot.select((F.try_divide(1 + F.col(strategy), 1 + F.col(bench)) - 1).alias("excess"))


def minute_grid(prices: DataFrame, part: Sequence[str], time: str, tie: str, value: str, step_seconds: int = 60) -> DataFrame:
    """Last known value on every minute between the first and last observation.

    Each observation emits the minutes it is in force for, up to the next one,
    so nothing is filled by a window over a whole series.
    """
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    one = prices.groupBy(*part, time).agg(F.max_by(value, tie).alias(value)).withColumn("_u", micros)
    step = step_seconds * 1_000_000
    nxt = neighbour(one, part, "_u", None, ["_u"], ahead=True, suffix="_next")
    first = F.ceil(F.col("_u") / step)
    # the last observation holds only at its own instant
    last = F.ceil(F.coalesce(F.col("_u_next"), F.col("_u") + 1) / step) - 1
    # day by day, so that a hole of years is many rows and no long array
    day = max(1, 86_400 // step_seconds)
    days = nxt.select(*part, value, first.alias("_a"), last.alias("_b")).where("_a <= _b")
    days = days.withColumn("_d", F.explode(F.sequence(F.floor(F.col("_a") / day), F.floor(F.col("_b") / day))))
    start, stop = F.greatest("_a", F.col("_d") * day), F.least("_b", F.col("_d") * day + (day - 1))
    ticks = days.select(*part, value, F.explode(F.sequence(start, stop)).alias("_m"))
    return ticks.select(
        *part, F.timestamp_micros(F.col("_m") * step).cast("timestamp_ntz").alias("minute"), value
    )


def relative_equity(strategy: DataFrame, bench: DataFrame, on: str = "datetime") -> DataFrame:
    """Ws, Wb, Ws / Wb and that minus one on the common times; each side compounds over its own times first."""
    ws = compound(strategy, [], [on], ["r"]).select(on, (1 + F.col("r_cum")).alias("ws"))
    wb = compound(bench, [], [on], ["r"]).select(on, (1 + F.col("r_cum")).alias("wb"))
    return ws.join(wb, on).withColumn("w_rel", F.try_divide("ws", "wb")).withColumn("outperf", F.col("w_rel") - 1)


def path_score(rel: DataFrame, on: str = "datetime") -> DataFrame:
    """min, largest shortfall, violation area and drawdown of a relative path."""
    run = scan(cut(rel.where("w_rel IS NOT NULL"), [], [on]), [], [on], maxes={"peak": "w_rel"})
    w = F.col("w_rel")
    zero = F.lit(0.0)
    return run.agg(
        F.min(w).alias("min"),
        F.greatest(zero, 1 - F.min(w)).alias("max_shortfall"),
        F.sum(F.greatest(zero, 1 - w)).alias("violation_area"),
        F.max(1 - w / F.col("peak")).alias("rel_mdd"),
    )


# top-k portfolio


def min_daily_names(scores: DataFrame, topk: int = 50, n_drop: int = 5) -> DataFrame:
    """Smallest cross-section and the k and drop it allows."""
    per = scores.where(nz("score").isNotNull()).groupBy("trade_time").agg(F.count("*").alias("n"))
    k = F.greatest(F.lit(1), F.least(F.lit(topk), F.min("n"))).cast("bigint")
    return per.agg(
        F.min("n").alias("min_daily_names"),
        k.alias("topk"),
        F.greatest(F.lit(0), F.least(F.lit(n_drop), k)).cast("bigint").alias("n_drop"),
    )


def daily_topk(scores: DataFrame, topk: int = 50) -> DataFrame:
    """The k highest scores of each date, k capped by the smallest cross-section."""
    known = scores.where(nz("score").isNotNull())
    k = min_daily_names(known, topk).first()["topk"]
    w = Window.partitionBy("trade_time").orderBy(F.desc("score"), "code")
    return known.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def topk_portfolio(
    frame: DataFrame, topk: int = 50, open_cost: float = 0.0005, close_cost: float = 0.0015, dates: int | None = None
) -> DataFrame:
    """Equal-weight top-k held to the next date: return, cost, bench per date.

    `frame` has (trade_time, code, close, score).  A name bought pays the open
    cost and one sold the close cost on its weight; the benchmark is the mean
    return of all names.
    """
    lab = forward_return(frame, 1, "next_return", dates)
    held = daily_topk(lab.select(*KEYS, "score", "next_return"), topk)
    days = frame.groupBy("trade_time").agg(F.lit(1).alias("_one"))
    w = Window.orderBy("trade_time")
    if dates is not None and dates > SEGMENT:
        order = neighbour(days.withColumn("_g", F.lit(0)), ["_g"], "trade_time", F.date_trunc("month", "trade_time"), ["trade_time"], ahead=True, suffix="_n")
        nexts = order.select("trade_time", F.col("trade_time_n").alias("next_time"))
    else:
        nexts = days.select("trade_time", F.lead("trade_time").over(w).alias("next_time"))
    size = held.groupBy("trade_time").agg(
        F.avg(F.coalesce("next_return", F.lit(0.0))).alias("return"), F.count("*").alias("held")
    )
    # names carried over: held on this date and on the one before
    moved = held.select("trade_time", "code").join(nexts, "trade_time").select(
        F.col("next_time").alias("trade_time"), "code"
    )
    stay = held.select("trade_time", "code").join(moved, KEYS).groupBy("trade_time").agg(F.count("*").alias("stay"))
    prior = size.join(nexts, "trade_time").select(F.col("next_time").alias("trade_time"), F.col("held").alias("was"))
    bench = lab.groupBy("trade_time").agg(F.avg(F.coalesce("next_return", F.lit(0.0))).alias("bench"))
    zero = F.lit(0)
    bought = (F.col("held") - F.coalesce("stay", zero)) / F.col("held")
    sold = F.coalesce(F.try_divide(F.coalesce("was", zero) - F.coalesce("stay", zero), F.col("was")), F.lit(0.0))
    return (
        size.join(stay, "trade_time", "left")
        .join(prior, "trade_time", "left")
        .join(bench, "trade_time")
        .select(
            F.col("trade_time").alias("datetime"),
            "return",
            (bought * open_cost + sold * close_cost).alias("cost"),
            "bench",
            (bought + sold).alias("turnover"),
            "held",
        )
    )


def signal_backtest(
    bars: DataFrame, signal: str, cash: float = 1.0, fee: float = 0.0005, maintenance: float = 0.05, leverage: float = 1.0
) -> DataFrame:
    """Per code: position = last bar's signal sign, cost on change, additive equity, first margin breach.

    Adds position, pnl, equity and breached to the bars.  A code's bars are
    bounded by the calendar, and the blocks of the scan split longer series.
    """
    day = F.date_trunc("month", "trade_time")
    known = F.coalesce(nz(signal), F.lit(0.0))
    step1 = neighbour(bars.withColumn("_sig", F.signum(known)), ["code"], "trade_time", day, ["_sig", "close"])
    position = F.coalesce("_sig_prev", F.lit(0.0)) * leverage
    step2 = neighbour(step1.withColumn("position", position), ["code"], "trade_time", day, ["position"])
    change = F.abs(F.col("position") - F.coalesce("position_prev", F.lit(0.0)))
    move = F.coalesce(F.try_divide(F.col("close"), F.col("close_prev")) - 1, F.lit(0.0))
    flow = step2.withColumn("pnl", F.col("position") * move - change * fee)
    run = scan(cut(flow, ["code"], ["trade_time"]), ["code"], ["trade_time"], sums={"_sum": "pnl"})
    eq = run.withColumn("equity", F.lit(float(cash)) + F.col("_sum"))
    breach = eq.withColumn(
        "_hit", ((F.col("position") != 0) & (F.col("equity") <= F.abs("position") * maintenance)).cast("int")
    )
    seen = scan(breach, ["code"], ["trade_time"], maxes={"_seen": "_hit"})
    return seen.select(*bars.columns, "position", "pnl", "equity", (F.col("_seen") == 1).alias("breached"))
