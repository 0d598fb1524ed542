"""Single-series research: rolling rank IC, IC curves, buckets, hit rates.

All run for every code at once.  A code's rows are bounded by the calendar; up
to one segment of dates its window is used, beyond it rows are numbered in
blocks and cut into chunks that carry the leading rows a frame needs.
"""

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import mean_over_std, nz, rank_corr
from ..functions.ranks import avg_rank, exact_percentiles, pooled_ranks
from ..functions.scan import neighbour, numbered
from .ic import forward_return
from .panel import SEGMENT

DAY_SECONDS = 86_400
DAILY_SWITCH = 1400


def chunked(df: DataFrame, part: Sequence[str], order: str, back: int, dates: int | None, segment: int = SEGMENT) -> DataFrame:
    """Adds `_no` (row number in the group), `_chunk` and `_lead` (a row that only serves the next chunk)."""
    if dates is not None and dates <= segment:
        no = F.row_number().over(Window.partitionBy(*part).orderBy(order))
        return df.withColumns({"_no": no.cast("bigint"), "_chunk": F.lit(0), "_lead": F.lit(False)})
    rows = numbered(df, part, [order], "_no")
    home = F.floor((F.col("_no") - 1) / segment).cast("int")
    late = (F.col("_no") - 1) % segment >= segment - back
    both = rows.withColumn("_home", home).withColumn(
        "_chunk", F.explode(F.when(late, F.array(home, home + 1)).otherwise(F.array(home)))
    )
    return both.withColumn("_lead", F.col("_chunk") != F.col("_home")).drop("_home")


def _places(x: np.ndarray, a: int, b: int, n: int) -> np.ndarray:
    """Twice the rank, less its mean, of rows a to b in each of the n windows that hold them.

    Entry (i, p) is for the window in which row a + i stands at place p. A row is compared once with the n - 1 rows on
    either side; a running sum of those comparisons gives its rank in every window as one difference.
    """
    pad = np.full(n - 1, np.nan)
    near = sliding_window_view(np.concatenate([pad, x, pad]), 2 * n - 1)[a:b]
    own = x[a:b, None]
    run = np.zeros((b - a, 2 * n), dtype=np.int32)
    np.cumsum(2 * (near < own) + (near == own), axis=1, dtype=np.int32, out=run[:, 1:])
    # windows of place p hold the rows from n - 1 - p to 2n - 2 - p
    return (run[:, n:] - run[:, :n])[:, ::-1].astype(np.int64) - n


def _window_sums(product: np.ndarray, n: int) -> np.ndarray:
    """Sums over each window: window s has the entries (s + p, p)."""
    row, col = product.strides
    return np.lib.stride_tricks.as_strided(product, (len(product) - n + 1, n), (row, row + col)).sum(axis=1)


def sliding_spearman(x: np.ndarray, y: np.ndarray, n: int, cells: int = 2_000_000) -> np.ndarray:
    """Spearman of every n consecutive rows, NaN for a constant side: n comparisons a row, not n x n a window.

    All sums are whole numbers. Rows are taken some at a time, so that `cells` comparisons are held.
    """
    out = np.full(max(0, len(x) - n + 1), np.nan)
    step = max(1, cells // (2 * n))
    for s in range(0, len(out), step):
        e = min(len(out), s + step) + n - 1
        rx, ry = _places(x, s, e, n), _places(y, s, e, n)
        sxy, sxx, syy = (_window_sums(p, n).astype(float) for p in (rx * ry, rx * rx, ry * ry))
        down = np.sqrt(sxx * syy)
        np.divide(sxy, down, out=out[s : s + step], where=down > 0)
    return out


def rolling_rank_ic(
    pairs: DataFrame, n: int = 60, part: Sequence[str] = ("code",), dates: int | None = None, segment: int = SEGMENT
) -> DataFrame:
    """Spearman of x and y over the last n rows, for every row that has n.

    A chunk of rows is shipped once; ranks are counted along it, a bounded number of windows at a time.
    """
    rows = chunked(pairs.select(*part, "trade_time", "x", "y"), part, "trade_time", n - 1, dates, segment)
    keep = [*part, "trade_time"]
    types = dict(rows.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in keep) + ", rank_ic double"

    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("_no").to_numpy())
        ends = order[n - 1 :]
        x, y = (table.column(c).to_numpy()[order] for c in ("x", "y"))
        ic = sliding_spearman(x, y, n)
        own = ~table.column("_lead").to_numpy()[ends]
        return table.select(keep).take(pa.array(ends[own])).append_column("rank_ic", pa.array(ic[own]))

    full = rows.groupBy(*part, "_chunk").applyInArrow(run, schema)
    return full.withColumn("rank_ic", nz("rank_ic"))


def rank_ic_single(
    panel: DataFrame, signal: str, horizon: int = 1, window: int = 60, dates: int | None = None
) -> DataFrame:
    """Per code: full rank IC, and mean, deviation and ratio of the rolling one; NULL below `window` rows.

    `panel` has (code, trade_time, close, signal); the forward return steps over
    the rows that have both.
    """
    known = panel.select("code", "trade_time", nz("close").alias("close"), nz(signal).alias("x")).dropna()
    rows = forward_return(known, horizon, "y", dates).dropna(subset=["y"])
    roll = rolling_rank_ic(rows, window, dates=dates)
    per = roll.groupBy("code").agg(
        F.avg("rank_ic").alias("m"), F.stddev_samp("rank_ic").alias("s"), F.count("rank_ic").alias("k")
    )
    if dates is not None and dates <= SEGMENT:
        ranked = rows.withColumns({"rx": avg_rank("x", ["code"]), "ry": avg_rank("y", ["code"])})
    else:
        ranked = pooled_ranks(pooled_ranks(rows, ["code"], "x", "rx"), ["code"], "y", "ry")
    full = ranked.groupBy("code").agg(rank_corr("rx", "ry").alias("rank_ic"), F.count("*").alias("n"))
    enough, two = F.col("n") >= window, F.col("k") >= 2
    return (
        panel.select("code")
        .distinct()
        .join(full, "code", "left")
        .join(per, "code", "left")
        .select(
            "code",
            F.when(enough, F.col("rank_ic")).alias("rank_ic"),
            F.when(enough & two, F.col("m")).alias("ic_mean"),
            F.when(enough & two, F.col("s")).alias("ic_std"),
            F.when(enough & two, mean_over_std("m", "s")).alias("icir"),
        )
    )


def rolling_pairs(df: DataFrame, n: int, part: Sequence[str] = ("code",)) -> DataFrame:
    """Every row number as `window_no` with the rows of its trailing window: no in (window_no - n, window_no].

    A band join: rows are keyed by blocks of n row numbers. A window lies in its own block and the one before, so a
    row is at home in one block and copied to the next; at most two copies move, whatever n. `df` has (part..., no, ...).
    """
    keys, block = [*part, "_blk"], F.floor((F.col("no") - 1) / n)
    ends = df.select(*part, F.col("no").alias("window_no"), block.alias("_blk"))
    members = df.withColumn("_blk", F.explode(F.array(block, block + 1)))
    band = (F.col("no") <= F.col("window_no")) & (F.col("no") > F.col("window_no") - n)
    on = [ends[c].eqNullSafe(members[c]) for c in part] + [ends["_blk"] == members["_blk"], band]
    return members.join(ends, on).select(*[members[c] for c in df.columns], "window_no")


def describe(panel: DataFrame, signal: str, part: Sequence[str] = ("code",)) -> DataFrame:
    """count, mean, std, min, quartiles, max per code."""
    x = panel.select(*part, nz(signal).alias("x")).where("x IS NOT NULL")
    base = x.groupBy(*part).agg(
        F.count("x").alias("count"),
        F.avg("x").alias("mean"),
        F.stddev_samp("x").alias("std"),
        F.min("x").alias("min"),
        F.max("x").alias("max"),
    )
    return base.join(exact_percentiles(x, part, "x", {"p25": 0.25, "p50": 0.5, "p75": 0.75}), list(part))


def bar_seconds(panel: DataFrame, part: Sequence[str] = ("code",)) -> DataFrame:
    """Median positive time step in whole seconds; 60 where a series has under three rows."""
    micros = F.unix_micros(F.col("trade_time").cast("timestamp"))
    rows = panel.select(*part, micros.alias("_u"))
    steps = neighbour(rows, part, "_u", F.floor(F.col("_u") / (DAY_SECONDS * 1_000_000)), ["_u"])
    gap = ((F.col("_u") - F.col("_u_prev")) / 1_000_000).alias("gap")
    median = exact_percentiles(steps.select(*part, gap).where("gap > 0"), part, "gap", {"m": 0.5})
    sizes = rows.groupBy(*part).agg(F.count("*").alias("n"))
    value = F.when(F.col("n") >= 3, F.floor("m")).otherwise(F.lit(60))
    return sizes.join(median, list(part), "left").select(*part, F.coalesce(value, F.lit(60)).cast("bigint").alias("bar_seconds"))


def _dates(panel: DataFrame, dates: int | None) -> int:
    return panel.select("trade_time").distinct().count() if dates is None else dates


def smoothed(panel: DataFrame, col: str, n: int, out: str, dates: int | None = None) -> DataFrame:
    """Rolling mean of the last n rows of a code, NULL below n values."""
    if n == 1:
        return panel.withColumn(out, F.col(col))
    rows = chunked(panel, ["code"], "trade_time", n - 1, dates)
    w = Window.partitionBy("code", "_chunk").orderBy("_no").rowsBetween(-(n - 1), 0)
    mean = F.when(F.count(col).over(w) >= n, F.avg(col).over(w))
    return rows.withColumn(out, mean).where(~F.col("_lead")).drop("_no", "_chunk", "_lead")


def _lagged(panel: DataFrame, cols: Sequence[str], dates: int) -> DataFrame:
    """Columns one row late per code."""
    if dates <= SEGMENT:
        w = Window.partitionBy("code").orderBy("trade_time")
        return panel.withColumns({c: F.lag(c).over(w) for c in cols})
    got = neighbour(panel, ["code"], "trade_time", None, cols)
    return got.withColumns({c: F.col(f"{c}_prev") for c in cols}).drop(*[f"{c}_prev" for c in cols])


def eval_frame(
    panel: DataFrame,
    signals: Sequence[str],
    horizon: int,
    smooth: int = 1,
    step_seconds: int = 60,
    lag: bool = True,
    dates: int | None = None,
) -> DataFrame:
    """Smoothed price, forward return and, by default, signals one row late.

    A horizon above 1400 bars switches to the last known values of each day,
    with the horizon in days.
    """
    if horizon < 1:
        raise ValueError("horizon must be positive")
    df = panel.select("code", "trade_time", *[nz(s).alias(s) for s in signals], "close")
    df = smoothed(df, "close", smooth, "close", dates)
    h = horizon
    if horizon > DAILY_SWITCH:
        h = max(1, round(horizon / max(1, round(DAY_SECONDS / step_seconds))))
        last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("trade_time"))).alias(c)
        day = F.date_trunc("day", "trade_time").cast("timestamp_ntz").alias("trade_time")
        df = df.groupBy("code", day).agg(*[last(c) for c in [*signals, "close"]])
        dates = None
    n = _dates(df, dates)
    df = forward_return(df, h, "ret", n).withColumnRenamed("close", "price")
    return _lagged(df, signals, n) if lag else df


def ic_curve(panel: DataFrame, signals: Sequence[str], horizons: Sequence[int], dates: int | None = None) -> DataFrame:
    """Spearman of each signal with the forward return of each horizon, complete rows, per code."""
    n = _dates(panel, dates)
    wide = panel.select("code", "trade_time", "close", *[nz(s).alias(s) for s in signals])
    for h in horizons:
        wide = forward_return(wide, h, f"_r{h}", n)
    wide = _lagged(wide, signals, n)
    returns = F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"_r{h}").alias("y")) for h in horizons])
    by_h = wide.select("code", "trade_time", *signals, F.explode(returns).alias("o"))
    by_h = by_h.select("code", "trade_time", *signals, "o.horizon", "o.y").dropna()
    long = by_h.unpivot(["code", "trade_time", "horizon", "y"], list(signals), "signal", "x")
    part = ["code", "horizon", "signal"]
    if n <= SEGMENT:
        ranked = long.withColumns({"rx": avg_rank("x", part), "ry": avg_rank("y", part)})
    else:
        ranked = pooled_ranks(pooled_ranks(long, part, "x", "rx"), part, "y", "ry")
    return ranked.groupBy(*part).agg(rank_corr("rx", "ry").alias("ic"))


def bucket_test(rows: DataFrame, buckets: int = 5, part: Sequence[str] = ("code",), dates: int | None = None) -> DataFrame:
    """Mean forward return of equal-count buckets of a signal, lowest first; needs `buckets` distinct values.

    `rows` has (part..., trade_time, x, y); equal values are ordered by time.
    """
    known = rows.dropna(subset=["x", "y"])
    values = known.select(*part, "x").distinct().groupBy(*part).agg(F.count("*").alias("_d"))
    sizes = known.groupBy(*part).agg(F.count("*").alias("_n")).join(values, list(part)).where(F.col("_d") >= buckets)
    if dates is not None and dates <= SEGMENT:
        r = F.row_number().over(Window.partitionBy(*part).orderBy("x", "trade_time"))
        placed = known.withColumn("_r", r)
    else:
        placed = numbered(known, part, ["x", "trade_time"], "_r")
    up = F.floor(((F.col("_r") - 1) * buckets + F.col("_n") - 2) / (F.col("_n") - 1)).cast("int")
    bucket = (F.greatest(F.lit(1), up) - 1).alias("bucket")
    return (
        placed.join(sizes, list(part)).groupBy(*part, bucket).agg(F.avg("y").alias("mean_return"), F.count("*").alias("n"))
    )


def rolling_ic(rows: DataFrame, n: int, part: Sequence[str] = ("code",), dates: int | None = None) -> DataFrame:
    """Rolling Pearson of x and y over complete rows."""
    known = chunked(rows.dropna(subset=["x", "y"]), part, "trade_time", n - 1, dates)
    w = Window.partitionBy(*part, "_chunk").orderBy("_no").rowsBetween(-(n - 1), 0)
    x, y = F.col("x"), F.col("y")
    corr = F.try_divide(F.covar_pop(x, y).over(w), F.stddev_pop(x).over(w) * F.stddev_pop(y).over(w))
    scored = known.withColumn("ic", F.when(F.count(x).over(w) >= n, corr))
    return scored.where(~F.col("_lead")).drop("_no", "_chunk", "_lead")


def hit_rate(panel: DataFrame, signal: str, smooth: int = 20, dates: int | None = None) -> DataFrame:
    """Share of non-zero signals whose sign the next return of the smoothed close has, per code."""
    n = _dates(panel, dates)
    df = panel.select("code", "trade_time", nz(signal).alias("s"), "close")
    df = forward_return(smoothed(df, "close", smooth, "close", n), 1, "r", n)
    valid = df.where("r IS NOT NULL AND s IS NOT NULL AND s != 0")
    hit = (F.signum("s") == F.signum("r")).cast("double")
    return valid.groupBy("code").agg(F.avg(hit).alias("hit_rate"), F.count("*").alias("n"))
