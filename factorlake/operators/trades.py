"""Trade and fill analytics over logs of any length.

Order-dependent numbers (equity, drawdown, streaks, autocorrelation) use blocks
of the sorted log, percentiles use value counts, the rest are plain aggregates.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import nz, safe_corr
from ..functions.ranks import exact_percentiles
from ..functions.scan import cut, merged_paths, numbered, path_offsets, path_summary

ORDER = ("dt_open", "ref")
HOLDING = {"median": 0.5, "p25": 0.25, "p75": 0.75, "p90": 0.9, "p99": 0.99}


def win_sums(pnl: str = "pnlcomm") -> dict[str, Column]:
    """Sums that the figures of winners and losers are made of; they add up over parts of a log."""
    x = F.col(pnl)
    return {
        "n_trades": F.count("*"),
        "wins": F.count(F.when(x > 0, 1)),
        "losses": F.count(F.when(x < 0, 1)),
        "gain": F.sum(F.when(x > 0, x)),
        "loss": -F.sum(F.when(x < 0, x)),
        "liquidated": F.sum(F.coalesce("is_liq", F.lit(0)).cast("bigint")),
    }


def win_figures() -> dict[str, Column]:
    """Figures from the columns of `win_sums`."""
    n, gain, loss = F.col("n_trades"), F.col("gain"), F.col("loss")
    win = F.try_divide(F.col("wins"), n)
    aw, al = F.try_divide(gain, F.col("wins")), -F.try_divide(loss, F.col("losses"))
    ratio = F.abs(F.try_divide(aw, al))
    return {
        "n_trades": n,
        "win_rate": win,
        "avg_win": aw,
        "avg_loss": al,
        "profit_factor": F.when(loss > 0, F.coalesce(gain, F.lit(0.0)) / loss).otherwise(float("inf")),
        "expectancy": win * aw + (1 - win) * al,
        "liq_ratio": F.try_divide(F.col("liquidated"), n),
        "kelly": F.coalesce(F.when(ratio > 0, win - F.try_divide(1 - win, ratio)), F.lit(0.0)),
    }


def path_blocks(trades: DataFrame, columns: Sequence[str], order: Sequence = ORDER, pnl: str = "pnlcomm") -> DataFrame:
    """The log cut and stored once, in time order: `columns`, the profit as `_x`, and whether a trade ends a run of losses."""
    x = F.coalesce(nz(pnl), F.lit(0.0))
    return cut(trades.select(*columns, x.alias("_x"), (F.coalesce(F.col(pnl), F.lit(0.0)) >= 0).alias("_stop")), [], order)


def equity(trades: DataFrame, initial: float = 1.0, order: Sequence = ORDER, pnl: str = "pnlcomm") -> DataFrame:
    """Running equity, its peak and the drawdown, per trade in time order."""
    blocks = path_blocks(trades, trades.columns, order, pnl)
    starts = path_offsets(path_summary(blocks, [], order, "_x"), []).select("blk", "before", "peak_before")
    upto = Window.partitionBy("blk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    run = blocks.withColumn("_p", F.sum("_x").over(upto)).withColumn("_m", F.max("_p").over(upto)).join(starts, "blk")
    first = F.lit(float(initial))
    run = run.withColumn("equity", first + F.col("before") + F.col("_p"))
    run = run.withColumn("peak", first + F.greatest("peak_before", F.col("before") + F.col("_m")))
    return run.select(*trades.columns, "equity", "peak", (F.col("equity") - F.col("peak")).alias("drawdown"))


def loss_streak(trades: DataFrame, order: Sequence = ORDER, pnl: str = "pnlcomm") -> DataFrame:
    """Longest run of losing trades."""
    summary = path_summary(path_blocks(trades, order, order, pnl), [], order, "_x", "_stop")
    return merged_paths(summary, []).agg(F.coalesce(F.max("streak"), F.lit(0)).cast("bigint").alias("loss_streak"))


def trade_report(trades: DataFrame, order: Sequence = ORDER) -> DataFrame:
    """All figures of a log from one cut and one summary per block of it."""
    sums = win_sums()
    blocks = path_blocks(trades, [*order, "pnlcomm", "is_liq"], order)
    whole = merged_paths(path_summary(blocks, [], order, "_x", "_stop", sums), [], list(sums))
    # one row also for an empty log
    whole = whole.agg(*[F.sum(c).alias(c) for c in sums], F.min("fall").alias("fall"), F.max("streak").alias("streak"))
    whole = whole.fillna(0, ["n_trades", "streak"])
    return whole.select(
        *[c.alias(n) for n, c in win_figures().items()], F.col("fall").alias("max_drawdown"), F.col("streak").alias("loss_streak")
    )


def moments(df: DataFrame, col: str) -> DataFrame:
    """Bias-corrected skewness and excess kurtosis."""
    x = F.col(col)
    n, g1, g2 = F.count(x).cast("double"), F.skewness(x), F.kurtosis(x)
    skew = F.when(n > 2, g1 * F.sqrt(n * (n - 1)) / (n - 2))
    kurt = F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6))
    return df.agg(skew.alias("skew"), kurt.alias("kurtosis"))


def autocorr(trades: DataFrame, lag: int = 1, order: Sequence = ORDER, pnl: str = "pnlcomm") -> DataFrame:
    """Correlation of a series with itself `lag` rows earlier, by a join on row numbers."""
    no = numbered(trades.select(*order, F.col(pnl).alias("x")), [], order).select("no", "x")
    late = no.select((F.col("no") + lag).alias("no"), F.col("x").alias("y"))
    return no.join(late, "no").agg(safe_corr("x", "y").alias("autocorr"))


def holding_stats(trades: DataFrame, col: str = "barlen", pnl: str = "pnlcomm") -> DataFrame:
    """Holding length overall and by outcome (all, win, loss)."""
    x = F.col(pnl)
    tags = F.array_compact(F.array(F.lit("all"), F.when(x > 0, F.lit("win")), F.when(x < 0, F.lit("loss"))))
    rows = trades.where(F.col(col).isNotNull()).select(F.explode(tags).alias("outcome"), F.col(col).cast("double").alias(col))
    base = rows.groupBy("outcome").agg(F.avg(col).alias("mean"), F.max(col).alias("max"), F.count("*").alias("count"))
    return base.join(exact_percentiles(rows, ["outcome"], col, HOLDING), "outcome")


def top_trades(trades: DataFrame, n: int = 5, pnl: str = "pnlcomm") -> DataFrame:
    """n best and n worst trades."""
    best = trades.orderBy(F.desc(pnl), *ORDER).limit(n).withColumn("side", F.lit("best"))
    worst = trades.orderBy(F.asc(pnl), *ORDER).limit(n).withColumn("side", F.lit("worst"))
    return best.unionByName(worst)


def cost_drag(trades: DataFrame) -> DataFrame:
    gross, net = F.sum("pnl"), F.sum("pnlcomm")
    share = lambda c: F.avg((F.col(c) > 0).cast("double"))
    return trades.agg(
        F.count("*").alias("n_trades"),
        gross.alias("gross_pnl"),
        net.alias("net_pnl"),
        F.sum("commission").alias("commission"),
        F.avg("pnl").alias("avg_gross"),
        F.avg("pnlcomm").alias("avg_net"),
        share("pnl").alias("gross_win_rate"),
        share("pnlcomm").alias("net_win_rate"),
        (gross - net).alias("cost_drag"),
        F.try_divide(gross - net, F.abs(gross)).alias("cost_drag_ratio"),
    )


def win_rate(trades: DataFrame, pnl: str = "pnlcomm") -> DataFrame:
    x = F.col(pnl)
    win, closed = F.count(F.when(x > 0, 1)), F.count("*")
    return trades.agg(
        closed.alias("closed"),
        win.alias("win"),
        F.count(F.when(x < 0, 1)).alias("loss"),
        F.coalesce(F.try_divide(win, closed), F.lit(0.0)).alias("win_rate"),
    )


def commission_by_code(trades: DataFrame) -> DataFrame:
    """Total (code NULL) and per-code commission and closed trades."""
    return trades.rollup("code").agg(F.sum("commission").alias("commission"), F.count("*").alias("n_trades"))


def pnl_histogram(trades: DataFrame, col: str = "pnlcomm") -> DataFrame:
    """Counts in int(sqrt(n)) equal bins, the last one closed; empty bins included."""
    x = F.col(col)
    span = trades.agg(F.min(x).alias("lo"), F.max(x).alias("hi"), F.count(x).alias("n")).select(
        "lo", "hi", F.greatest(F.lit(1), F.floor(F.sqrt("n"))).cast("int").alias("bins"), F.lit(1).alias("_k")
    )
    rows = trades.where(x.isNotNull()).select(x.alias("x"), F.lit(1).alias("_k")).join(F.broadcast(span), "_k")
    width = F.try_divide(F.col("hi") - F.col("lo"), F.col("bins").cast("double"))
    idx = F.coalesce(F.floor(F.try_divide(F.col("x") - F.col("lo"), width)), F.lit(0)).cast("int")
    got = rows.groupBy(F.least(idx, F.col("bins") - 1).alias("bin")).agg(F.count("*").alias("count"))
    slots = span.select("lo", "hi", "bins", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)).alias("bin"))
    edge = lambda i: F.col("lo") + i * (F.col("hi") - F.col("lo")) / F.col("bins")
    return slots.join(got, "bin", "left").select(
        "bin", edge(F.col("bin")).alias("left_edge"), edge(F.col("bin") + 1).alias("right_edge"),
        F.coalesce("count", F.lit(0)).alias("count"),
    )


def histogram_by_outcome(trades: DataFrame, col: str = "barlen", pnl: str = "pnlcomm") -> DataFrame:
    """Counts of an integer length by win and loss."""
    side = F.when(F.col(pnl) > 0, "win").when(F.col(pnl) < 0, "loss")
    return trades.where(side.isNotNull()).groupBy(side.alias("outcome"), col).agg(F.count("*").alias("count"))


def minmax(df: DataFrame, col: str, part: Sequence[str] = (), out: str = "norm") -> DataFrame:
    """(x - min) / (max - min) inside `part`, 0 for a constant; the extremes are joined in."""
    ends = df.groupBy(*part).agg(F.min(col).alias("_lo"), F.max(col).alias("_hi"))
    if part:
        both = df.join(ends, list(part))
    else:
        both = df.withColumn("_k", F.lit(1)).join(F.broadcast(ends.withColumn("_k", F.lit(1))), "_k").drop("_k")
    x = F.coalesce(F.try_divide(F.col(col) - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.col(col) * 0.0)
    return both.withColumn(out, x).drop("_lo", "_hi")


# fills


def prepare_fills(fills: DataFrame) -> DataFrame:
    """Signed size from the side where unsigned, absolute size, notional.

    Notional is |value|, or |size| * price when no row has a value.
    """
    size = F.col("size").cast("double")
    side = F.upper(F.trim("side"))
    sign = F.when(side == "BUY", 1.0).otherwise(-1.0)
    have = "value" in fills.columns and bool(fills.where(nz("value").isNotNull()).limit(1).count())
    notional = F.abs(F.col("value").cast("double")) if have else F.abs(size) * F.col("price")
    return fills.withColumns(
        {
            "side": side,
            "signed_size": F.when(size >= 0, size * sign).otherwise(size),
            "abs_size": F.abs(size),
            "notional": notional,
            "is_liq": F.coalesce(F.col("is_liq"), F.lit(0)).cast("int"),
        }
    )


def weighted_avg(value, weight) -> Column:
    v, w = (F.col(c) if isinstance(c, str) else c for c in (value, weight))
    total = F.sum(w)
    return F.when(total > 0, F.try_divide(F.sum(v * w), total))


def fill_report(fills: DataFrame) -> DataFrame:
    df = prepare_fills(fills)
    key = F.lit(1).alias("_k")
    base = df.agg(
        F.count("*").alias("n_fills"),
        F.sum("abs_size").alias("volume"),
        F.sum("notional").alias("notional"),
        F.sum("commission").alias("commission"),
        F.avg("commission").alias("avg_commission"),
        F.try_divide(F.sum("commission"), F.sum("notional")).alias("commission_per_notional"),
        weighted_avg("price", "abs_size").alias("vwap"),
        F.avg("abs_size").alias("avg_size"),
        F.max("abs_size").alias("max_size"),
        F.avg(F.col("is_liq").cast("double")).alias("liq_ratio"),
        F.sum(F.col("is_liq").cast("bigint")).alias("liq_count"),
    ).select("*", key)
    median = exact_percentiles(df, [], "abs_size", {"median_size": 0.5}).select("*", key)
    return base.join(median, "_k").drop("_k")


def fill_by_side(fills: DataFrame) -> DataFrame:
    return prepare_fills(fills).groupBy("side").agg(
        F.count("*").alias("n_fills"),
        F.sum("notional").alias("notional"),
        weighted_avg("price", "abs_size").alias("vwap"),
    )


def reason_topn(fills: DataFrame, n: int = 10) -> DataFrame:
    counts = fills.groupBy(F.coalesce("reason", F.lit("")).alias("reason")).agg(F.count("*").alias("count"))
    return counts.orderBy(F.desc("count"), "reason").limit(n)


def clean_trades(raw: DataFrame) -> DataFrame:
    """Text log to types, best effort: what does not parse is NULL, is_liq NULL is 0."""
    num = {"barlen": "int", "pnl": "double", "pnlcomm": "double", "commission": "double", "ref": "bigint"}
    cols = {c: F.col(c).try_cast(t) for c, t in num.items() if c in raw.columns}
    for c in ("dt_open", "dt_close"):
        if c in raw.columns:
            cols[c] = F.col(c).try_cast("timestamp_ntz")
    if "is_liq" in raw.columns:
        cols["is_liq"] = F.coalesce(F.col("is_liq").try_cast("int"), F.lit(0))
    return raw.withColumns(cols)


def clean_fills(raw: DataFrame) -> DataFrame:
    num = {"size": "double", "price": "double", "value": "double", "commission": "double", "ref": "bigint"}
    cols = {c: F.col(c).try_cast(t) for c, t in num.items() if c in raw.columns}
    if "dt" in raw.columns:
        cols["dt"] = F.col("dt").try_cast("timestamp_ntz")
    if "is_liq" in raw.columns:
        cols["is_liq"] = F.coalesce(F.col("is_liq").try_cast("int"), F.lit(0))
    cols["side"] = F.upper(F.trim("side"))
    return raw.withColumns(cols)


