"""The bar panel: de-duplication, densification, joins of factors, factor evaluation."""

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import nz
from ..functions.ranks import ordered_blocks
from ..functions.ts import SERIES, ewm_block, ts_ewm, ts_shift
from ..session import broadcast_rows, materialize, small

KEYS = ["trade_time", "code"]
FIELDS = ["open", "high", "low", "close", "volume", "amount"]
MARKET = {*KEYS, *FIELDS, "vwap"}
SEGMENT = 65_536
# cells of a dense panel that one task aggregates and sorts, on average
CELLS_PER_TASK = 500_000


def require(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def factor_columns(df: DataFrame, score: str = "score") -> list[str]:
    """Numeric columns that are not market fields, the score last."""
    numeric = {"tinyint", "smallint", "int", "bigint", "float", "double"}
    cols = [n for n, t in df.dtypes if n not in MARKET and (t in numeric or t.startswith("decimal"))]
    return [c for c in cols if c != score] + ([score] if score in cols else [])


def dedup_mean(df: DataFrame, fields: Sequence[str] = FIELDS) -> DataFrame:
    """Duplicate (time, code) rows averaged."""
    return df.groupBy(*KEYS).agg(*[F.avg(nz(c)).alias(c) for c in fields])


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return _keep(df, keys, order, F.max_by)


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return _keep(df, keys, order, F.min_by)


def _keep(df, keys, order, pick) -> DataFrame:
    """One row per key, chosen by an explicit order.

    An aggregate rather than a row_number window: copies of a key are combined
    before the shuffle, so a key with very many copies stays one row per task.
    """
    rest = [c for c in df.columns if c not in keys]
    one = df.groupBy(*keys).agg(pick(F.struct(*rest), F.struct(*order)).alias("row"))
    return one.select(*keys, *[F.col(f"row.{c}").alias(c) for c in rest]).select(*df.columns)


def index_calendar(times: DataFrame) -> tuple[DataFrame, int]:
    """(trade_time, t) with t = 0, 1, ... in time order, and the number of dates.

    The distinct times are stored, so the table they come from is scanned once.
    """
    cal = materialize(times.select("trade_time").distinct())
    n = cal.count()
    if n <= broadcast_rows(times.sparkSession):
        return cal.select(
            "trade_time",
            (F.row_number().over(Window.orderBy("trade_time")) - 1).cast("int").alias("t"),
        ), n
    cut = ordered_blocks(cal, ["trade_time"])
    sizes = cut.groupBy("blk").agg(F.count("*").alias("n"))
    w = Window.orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("blk", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"))
    pos = F.row_number().over(Window.partitionBy("blk").orderBy("trade_time")) - 1
    local = cut.select("trade_time", "blk", pos.alias("pos"))
    return local.join(F.broadcast(before), "blk").select(
        "trade_time", (F.col("before") + F.col("pos")).cast("int").alias("t")
    ), n


def densify(
    bars: DataFrame,
    times: DataFrame | None = None,
    codes: DataFrame | None = None,
    fields: Sequence[str] = FIELDS,
    lookback: int = 0,
    segment: int = SEGMENT,
) -> DataFrame:
    """Every calendar date for every code; duplicate cells averaged.

    Output: code, t, seg, trade_time, fields, observed, halo.  The empty cells
    are generated from the code list and united with the bars, then one
    aggregation on (code, seg, t) places both: one exchange, which the
    time-series windows reuse.  `times` and `codes` let the caller give stored
    or cheaper-to-scan lists.  The exchange has a task for every `CELLS_PER_TASK` cells:
    empty cells compress to next to nothing, so sizes in bytes would put too many into one.
    """
    if lookback >= segment:
        raise ValueError("lookback must be shorter than a segment")
    cal, n = index_calendar(bars if times is None else times)
    names = materialize((bars if codes is None else codes).select("code").distinct())
    spark = names.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, -(-names.count() * n // CELLS_PER_TASK))
    # cells segment by segment, each with its leading rows
    last = max(n - 1, 0) // segment
    first = F.greatest(F.col("seg") * segment - (lookback if last else 0), F.lit(0))
    stop = F.least((F.col("seg") + 1) * segment, F.lit(n)) - 1
    empty = (
        names.repartition(tasks, "code")
        .select("code", F.explode(F.sequence(F.lit(0), F.lit(last))).alias("seg"))
        .select("code", "seg", F.explode(F.sequence(first, stop)).alias("t"))
        .select(
            "code", "seg", "t", *[F.lit(None).cast("double").alias(c) for c in fields], F.lit(0).alias("observed")
        )
    )
    placed = bars.join(small(cal, n), "trade_time").select(
        "code", "t", *[nz(c).alias(c) for c in fields], F.lit(1).alias("observed")
    )
    home = F.floor(F.col("t") / segment).cast("int")
    if lookback and last:
        early = (F.col("t") % segment >= segment - lookback) & (home < last)
        placed = placed.withColumn("seg", F.explode(F.when(early, F.array(home, home + 1)).otherwise(F.array(home))))
    else:
        placed = placed.withColumn("seg", home)
    cells = (
        empty.unionByName(placed)
        .repartition(tasks, *SERIES)
        .groupBy(*SERIES, "t")
        .agg(*[F.avg(c).alias(c) for c in fields], F.max("observed").alias("observed"))
    )
    return cells.join(small(cal, n), "t").select(
        "code",
        "t",
        "seg",
        "trade_time",
        *fields,
        (F.col("observed") == 1).alias("observed"),
        (F.col("seg") != home).alias("halo"),
    )


def pad(frame: DataFrame, col: str, lookback: int = 0, segment: int = SEGMENT, dates: int | None = None) -> DataFrame:
    """Fill missing cells of a dense frame with the last known value of the code.

    Inside a segment by a running window; what was known before the segment's
    first row comes from one summary row per (code, segment). Where the number of
    `dates` is known to fit into one segment, nothing comes before it and the frame is computed once.
    """
    upto = Window.partitionBy(*SERIES).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    if dates is not None and dates <= segment:
        return frame.withColumn(col, F.last(col, ignorenulls=True).over(upto))
    body = F.col("t") % segment < segment - lookback
    own = frame.where(~F.col("halo") & F.col(col).isNotNull())
    ends = own.groupBy(*SERIES).agg(
        F.max_by(col, "t").alias("end"), F.max_by(F.when(body, F.col(col)), F.when(body, F.col("t"))).alias("inner")
    )
    known = frame.select(*SERIES).distinct().join(ends, SERIES, "left")
    w = Window.partitionBy("code").orderBy("seg")
    carry = F.coalesce(
        F.lag("inner").over(w),
        F.last("end", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -2)),
    )
    return (
        frame.join(known.select(*SERIES, carry.alias("carry")), SERIES, "left")
        .withColumn(col, F.coalesce(F.last(col, ignorenulls=True).over(upto), "carry"))
        .drop("carry")
    )


def ewm(frame: DataFrame, col: str, out: str, alpha: float, segment: int = SEGMENT, dates: int | None = None) -> DataFrame:
    """Exponentially weighted mean of a dense frame with a lookback of two blocks, carried over gaps of any length."""
    lookback = 2 * ewm_block(alpha)
    return pad(frame.withColumn(out, ts_ewm(col, alpha)), out, lookback, segment, dates)


@dataclass(frozen=True)
class Factor:
    """A named factor: stages of Column expressions over the dense panel.

    `stages()` returns a list of dicts; a later stage may use names of earlier
    ones, and the last stage must define `name`.  `lookback` is the number of
    earlier calendar rows the whole expression can reach.
    """

    name: str
    stages: Callable[[], list[dict[str, Column]]] = field(repr=False)
    lookback: int = 0


def factors_on(frame: DataFrame, factors: Sequence[Factor], shift: int = 0) -> DataFrame:
    """A dense frame plus one column per factor, shifted after compute; the n-th stages of all go into one select."""
    names = [f.name for f in factors]
    plans = [f.stages() for f in factors]
    for level in range(max(len(p) for p in plans)):
        new = {k: v for p in plans if level < len(p) for k, v in p[level].items()}
        frame = frame.withColumns(new)
    frame = frame.select(
        *["code", "t", "seg", "trade_time", *FIELDS, "observed", "halo"],
        *[nz(n).alias(n) for n in names],
    )
    return frame.withColumns({n: ts_shift(n, shift) for n in names}) if shift else frame


def compute_factors(
    bars: DataFrame,
    factors: Sequence[Factor],
    shift: int = 0,
    score: str = "score",
    times: DataFrame | None = None,
    codes: DataFrame | None = None,
    segment: int = SEGMENT,
    dense_rows: bool = False,
) -> DataFrame:
    """Panel plus one column per factor plus the row mean `score`.

    The n-th stages of all factors go into one select, so factors share their
    windows.  A uniform `shift` is applied after compute.
    """
    if not factors:
        raise ValueError("at least one factor is needed")
    if not isinstance(shift, int) or shift < 0:
        raise ValueError("shift must be a non-negative integer")
    names = [f.name for f in factors]
    lookback = max(f.lookback for f in factors) + shift
    frame = densify(bars, times, codes, lookback=lookback, segment=segment)
    frame = factors_on(frame, factors, shift)
    keep = ~F.col("halo") if dense_rows else (~F.col("halo") & F.col("observed"))
    out = frame.where(keep).select(*KEYS, *FIELDS, *names)
    return out if score in names else out.withColumn(score, row_mean(names))


def row_mean(cols: Sequence[str]) -> Column:
    """Mean over columns, skipping nulls."""
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in cols), F.lit(0.0))
    known = sum((F.col(c).isNotNull().cast("int") for c in cols), F.lit(0))
    return F.try_divide(total, known.cast("double"))


def melt(frame: DataFrame, factors: Sequence[str], keep: Sequence[str] = (*KEYS, "close")) -> DataFrame:
    """Wide factor frame to rows (keep..., factor, score)."""
    return frame.unpivot(list(keep), [F.col(f).cast("double").alias(f) for f in factors], "factor", "score")


def attach_factor(panel: DataFrame, factor: DataFrame, name: str, value: str = "value") -> DataFrame:
    """Left join one factor onto the panel by time and code."""
    return panel.join(factor.select(*KEYS, F.col(value).alias(name)), KEYS, "left")
