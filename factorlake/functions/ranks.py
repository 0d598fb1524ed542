"""Average-tie ranks.

`avg_rank` and `pct_rank` are windows for groups of bounded size (one date's
names).  `row_ranks` is for groups of any size, down to a single group holding
every row: rows are ranked in range-partitioned blocks, so no task ever sorts a
whole group or gathers all copies of a tied value.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize, small


def _window(x: Column, part: Sequence[str]):
    return Window.partitionBy(*part).orderBy(x.asc_nulls_last())


def avg_rank(x, part: Sequence[str]) -> Column:
    """Rank with ties averaged inside `part`; NULL stays NULL."""
    x = F.col(x) if isinstance(x, str) else x
    w = _window(x, part)
    ties = F.count(x).over(w.rangeBetween(Window.currentRow, Window.currentRow))
    return F.when(x.isNotNull(), F.rank().over(w) + (ties - 1) / F.lit(2.0))


def pct_rank(x, part: Sequence[str]) -> Column:
    """Average rank over the number of non-null values of the group."""
    x = F.col(x) if isinstance(x, str) else x
    whole = _window(x, part).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return avg_rank(x, part) / F.count(x).over(whole)


def ordered_blocks(df: DataFrame, order: Sequence, blocks: int | None = None) -> DataFrame:
    """Cut a whole table into consecutive blocks of its sort order, stored with a block id.

    The ids come from a range partitioning and are written out before use, so a
    recomputed task cannot see other boundaries.  Without a given number the
    shuffle's own size decides: adaptive execution joins neighbouring partitions
    that are small.
    """
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    cut = df.repartitionByRange(blocks, *cols) if blocks else df.repartitionByRange(*cols)
    return materialize(cut.withColumn("blk", F.spark_partition_id()))


def _before(cols: Sequence[str], part: Sequence, order: Sequence[str]):
    w = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return [F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"before_{c}") for c in cols]


def row_ranks(
    df: DataFrame, group: Sequence[str], value: str, out: str, masks: Sequence[Column] | None = None
) -> DataFrame:
    """Rows with a value, and its average rank in a group of any size.

    With `masks` the rank is an array: entry i ranks the value among the rows
    where mask i holds.  Rows are cut into blocks by (group, value, row hash), so
    even equal values are spread; a value that crosses a block border gets its
    rank from a small table of such values.  That table and the blocks' offsets have at
    most a row per group and block, so they are broadcast and the rows stay where they are.
    """
    group = list(group)
    flags = [f"_f{i}" for i in range(len(masks or [0]))]
    marks = [m.cast("bigint") for m in masks] if masks else [F.lit(1).cast("bigint")]
    rows = df.where(F.col(value).isNotNull()).withColumns(dict(zip(flags, marks)))
    cut = ordered_blocks(rows.withColumn("_salt", F.xxhash64(*df.columns)), [*group, value, "_salt"])
    cut = cut.drop("_salt")
    keys, part = [*group, "blk"], group or [F.lit(0)]
    edges = cut.groupBy(*keys).agg(
        F.min(value).alias("_lo"), F.max(value).alias("_hi"), *[F.sum(f).alias(f) for f in flags]
    )
    following = F.lead("_lo").over(Window.partitionBy(*part).orderBy("blk"))
    edges = materialize(
        edges.select("*", *_before(flags, part, ["blk"]), (F.col("_hi") == following).alias("_cross"))
    )
    n = edges.count()
    crossing = edges.where("_cross").select(*group, F.col("_hi").alias(value)).distinct()
    copies = cut.join(small(crossing, n), [*group, value]).groupBy(*keys, value).agg(*[F.sum(f).alias(f"_c{f}") for f in flags])
    # the first block that holds a crossing value ends with it
    crossed = (
        copies.join(edges, keys)
        .groupBy(*group, value)
        .agg(
            F.min_by(
                F.array(*[F.col(f"before_{f}") + F.col(f) - F.col(f"_c{f}") for f in flags]), "blk"
            ).alias("_less"),
            F.array(*[F.sum(f"_c{f}") for f in flags]).alias("_same"),
        )
    )
    run = Window.partitionBy(*keys).orderBy(value)
    upto = run.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    same = run.rangeBetween(Window.currentRow, Window.currentRow)
    local = cut.withColumns(
        {**{f"_u{f}": F.sum(f).over(upto) for f in flags}, **{f"_t{f}": F.sum(f).over(same) for f in flags}}
    )
    offsets = edges.select(*keys, *[f"before_{f}" for f in flags])
    ranks = []
    for i, f in enumerate(flags):
        inside = F.col(f"before_{f}") + F.col(f"_u{f}") - (F.col(f"_t{f}") - 1) / F.lit(2.0)
        across = F.col("_less")[i] + (F.col("_same")[i] + 1) / F.lit(2.0)
        ranks.append(F.coalesce(across, inside))
    result = F.array(*ranks) if masks else ranks[0]
    return (
        local.join(small(offsets, n), keys)
        .join(small(crossed, n), [*group, value], "left")
        .select(*df.columns, result.alias(out))
    )


def pooled_ranks(df: DataFrame, group: Sequence[str], value: str, out: str) -> DataFrame:
    """`row_ranks` without masks: one rank column; rows without a value are dropped."""
    return row_ranks(df, group, value, out)


def exact_percentiles(df: DataFrame, group: Sequence[str], value: str, qs: dict[str, float]) -> DataFrame:
    """Linear-interpolated percentiles of groups of any size, one row per group.

    Works on value counts in ordered blocks, so neither all values nor all
    distinct values of a group meet in one task.
    """
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(*group, value)
        .agg(F.count("*").cast("bigint").alias("n"))
    )
    cut = ordered_blocks(counts, [*group, value])
    keys = [*group, "blk"]
    totals = cut.groupBy(*keys).agg(F.sum("n").alias("n"))
    part = list(group) or [F.lit(0)]
    whole = Window.partitionBy(*part)
    offsets = totals.select(*keys, *_before(["n"], part, ["blk"]), F.sum("n").over(whole).alias("_size"))
    upto = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    rows = cut.withColumn("_upto", F.sum("n").over(upto)).join(offsets, keys)
    last = F.col("before_n") + F.col("_upto")  # position after this value's last copy
    first = last - F.col("n")

    def at(pos):
        return F.max(F.when((first <= pos) & (pos < last), F.col(value)))

    cols = []
    for name, q in qs.items():
        pos = (F.col("_size") - 1) * F.lit(float(q))
        low, high = at(F.floor(pos)), at(F.ceil(pos))
        frac = F.max(pos - F.floor(pos))
        cols.append((low + (high - low) * frac).alias(name))
    return rows.groupBy(*group).agg(*cols)
