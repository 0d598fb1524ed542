"""Running values and numbers over groups of any size.

A window over a whole group puts it into one task.  Here a table is cut into
consecutive blocks of its sort order, each block is scanned on its own, and the
totals of the blocks before it are joined in: one row per (group, block).
"""

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranks import ordered_blocks


def cut(df: DataFrame, part: Sequence[str], order: Sequence) -> DataFrame:
    return ordered_blocks(df, [*part, *order])


def scan(
    blocks: DataFrame,
    part: Sequence[str],
    order: Sequence,
    sums: Mapping[str, str] | None = None,
    maxes: Mapping[str, str] | None = None,
) -> DataFrame:
    """Adds running sums and maxima (current row included) to a table from `cut`.

    `sums` and `maxes` map an output name to the column to run over.
    """
    sums, maxes = dict(sums or {}), dict(maxes or {})
    keys = [*part, "blk"]
    totals = blocks.groupBy(*keys).agg(
        *[F.sum(c).alias(o) for o, c in sums.items()], *[F.max(c).alias(o) for o, c in maxes.items()]
    )
    before = Window.partitionBy(*(list(part) or [F.lit(0)])).orderBy("blk").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = totals.select(
        *keys,
        *[F.sum(o).over(before).alias(f"_b_{o}") for o in sums],
        *[F.max(o).over(before).alias(f"_b_{o}") for o in maxes],
    )
    here = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = blocks.withColumns(
        {
            **{f"_h_{o}": F.sum(c).over(here) for o, c in sums.items()},
            **{f"_h_{o}": F.max(c).over(here) for o, c in maxes.items()},
        }
    ).join(offsets, keys)
    add = lambda o: F.coalesce(F.col(f"_b_{o}") + F.col(f"_h_{o}"), f"_h_{o}", f"_b_{o}")
    return out.select(
        *blocks.columns,
        *[add(o).alias(o) for o in sums],
        *[F.greatest(f"_b_{o}", f"_h_{o}").alias(o) for o in maxes],
    )


def path_summary(
    blocks: DataFrame, part: Sequence[str], order: Sequence, value: str, stop: str | None = None, extra: Mapping | None = None
) -> DataFrame:
    """One row per (part, blk) that tells all about a stretch of a path that its neighbours need.

    The path adds up `value`. total: its sum; high, low: the highest and lowest running sum; fall: the deepest one under
    an earlier high. A row with `stop` ends a streak: rows, first and last stop, and the longest streak between two of them.
    Summaries are associative (`merged_paths`). `extra` names further aggregates of a block, which add up.
    """
    keys = [*part, "blk"]
    here = Window.partitionBy(*keys).orderBy(*order)
    upto = here.rowsBetween(Window.unboundedPreceding, 0)
    rows = blocks.withColumn("_p", F.sum(value).over(upto)).withColumn("_m", F.max("_p").over(upto))
    cols = [F.sum(value).alias("total"), F.max("_p").alias("high"), F.min("_p").alias("low"), F.min(F.col("_p") - F.col("_m")).alias("fall")]
    if stop is not None:
        rows = rows.withColumn("_i", F.row_number().over(here))
        ends = F.when(F.col(stop), F.col("_i"))
        rows = rows.withColumn("_streak", F.col("_i") - F.coalesce(F.max(ends).over(upto), F.lit(0)))
        cols += [F.count("*").alias("rows"), F.min(ends).alias("first_stop"), F.max(ends).alias("last_stop"), F.max("_streak").alias("streak")]
    return rows.groupBy(*keys).agg(*cols, *[c.alias(n) for n, c in (extra or {}).items()])


def path_offsets(summary: DataFrame, part: Sequence[str], start: bool = False) -> DataFrame:
    """Adds to each block's summary the path's value (`before`) and highest value (`peak_before`) at its beginning.

    With `start` the beginning of the path, 0, counts as a value of it.
    """
    earlier = Window.partitionBy(*(list(part) or [F.lit(0)])).orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    placed = summary.withColumn("before", F.coalesce(F.sum("total").over(earlier), F.lit(0.0)))
    peak = F.max(F.col("before") + F.col("high")).over(earlier)
    return placed.withColumn("peak_before", F.greatest(peak, F.lit(0.0)) if start else peak)


def merged_paths(summary: DataFrame, part: Sequence[str], extra: Sequence[str] = (), start: bool = False) -> DataFrame:
    """The summary of whole paths from those of their blocks: total, high, low, fall and, if there, streak; one row per part."""
    placed = path_offsets(summary, part, start)
    fall = F.least("fall", F.col("before") + F.col("low") - F.col("peak_before"))
    ends = [F.max(F.col("before") + F.col("high")).alias("high"), F.min(F.col("before") + F.col("low")).alias("low"), F.min(fall).alias("fall")]
    whole = placed.groupBy(*part).agg(F.sum("total").alias("total"), *ends, *[F.sum(c).alias(c) for c in extra])
    if "streak" not in summary.columns:
        return whole
    # a streak over borders: the tail of a block, whole blocks without a stop, the head of the next one with a stop
    earlier = Window.partitionBy(*(list(part) or [F.lit(0)])).orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    stops = F.coalesce(F.sum(F.col("first_stop").isNotNull().cast("bigint")).over(earlier), F.lit(0))
    head = F.struct(F.col("run"), F.coalesce(F.col("first_stop") - 1, F.col("rows")).cast("bigint").alias("n"))
    tail = F.struct((F.col("run") + 1).alias("run"), F.coalesce(F.col("rows") - F.col("last_stop"), F.lit(0)).cast("bigint").alias("n"))
    pieces = summary.withColumn("run", stops).select(*part, F.col("streak").cast("bigint").alias("streak"), F.explode(F.array(head, tail)).alias("_e"))
    runs = pieces.groupBy(*part, "_e.run").agg(F.sum("_e.n").alias("n"), F.max("streak").alias("streak"))
    longest = runs.groupBy(*part).agg(F.greatest(F.max("n"), F.max("streak")).alias("streak"))
    if part:
        return whole.join(longest, list(part))
    key = F.lit(1).alias("_k")
    return whole.select("*", key).join(longest.select("*", key), "_k").drop("_k")


def numbered(df: DataFrame, part: Sequence[str], order: Sequence, out: str = "no") -> DataFrame:
    """Row numbers from 1 inside `part`; `order` must be unique there."""
    blocks = cut(df.withColumn("_one", F.lit(1).cast("bigint")), part, order)
    return scan(blocks, part, order, sums={out: "_one"}).drop("_one", "blk")


def neighbour(
    df: DataFrame, part: Sequence[str], order: str, bucket, cols: Sequence[str], ahead: bool = False, suffix: str = "_prev"
) -> DataFrame:
    """Values of `cols` in the previous (or next) row of the group, without a window over the group.

    `bucket` is a Column rising with `order` that bounds the rows of a group in
    it, such as the day of bars; without one the table is cut into even blocks.
    Windows run inside (group, bucket), and a bucket's edge comes from one
    summary row per bucket.
    """
    keys = [*part, "_bkt"]
    if bucket is None:
        rows = cut(df, part, [order]).withColumnRenamed("blk", "_bkt")
    else:
        rows = df.withColumn("_bkt", bucket)
    value = F.struct(*cols)
    pick = F.min_by if ahead else F.max_by
    edges = rows.groupBy(*keys).agg(pick(value, order).alias("_edge"))
    step = F.lead if ahead else F.lag
    across = edges.select(*keys, step("_edge").over(Window.partitionBy(*part).orderBy("_bkt")).alias("_out"))
    near = step(value).over(Window.partitionBy(*keys).orderBy(order))
    both = rows.withColumn("_in", near).join(across, keys)
    pickd = F.coalesce("_in", "_out")
    return both.select(*df.columns, *[pickd[c].alias(c + suffix) for c in cols])


def asof_backward(
    left: DataFrame, right: DataFrame, by: Sequence[str], on: str, cols: Sequence[str], bucket=None
) -> DataFrame:
    """Left rows with the last known right values at or before their time, per group.

    Both sides are united and filled inside (group, bucket); the last known
    values of earlier buckets come from one summary row per bucket.
    """
    bucket = F.date_trunc("month", on) if bucket is None else bucket
    keys = [*by, "_bkt"]
    mine = left.select(*[F.col(c) for c in left.columns], F.lit(1).alias("_side"))
    other = right.select(*by, on, *cols, F.lit(0).alias("_side"))
    both = mine.unionByName(other, allowMissingColumns=True).withColumn("_bkt", bucket)
    ends = both.groupBy(*keys).agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(on))).alias(c) for c in cols]
    )
    w = Window.partitionBy(*by).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(*keys, *[F.last(c, ignorenulls=True).over(w).alias(f"_c_{c}") for c in cols])
    here = Window.partitionBy(*keys).orderBy(on, "_side").rowsBetween(Window.unboundedPreceding, 0)
    filled = both.withColumns({f"_h_{c}": F.last(c, ignorenulls=True).over(here) for c in cols})
    return (
        filled.where("_side = 1")
        .join(carry, keys)
        .select(*left.columns, *[F.coalesce(f"_h_{c}", f"_c_{c}").alias(c) for c in cols])
    )
