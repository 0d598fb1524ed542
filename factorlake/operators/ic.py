"""Information coefficients, distributions and decile layers.

Long tables have (factor, trade_time, code, score, label).  A cross-section
window sorts one date's names in a task, so it is used only while the universe
is under `NAMES`; beyond it the same ranks come from `pooled_ranks`, and layers
from pieces of a date's order.
"""

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import div, mean_over_std, nz, rank_corr, safe_corr
from ..functions.ranks import avg_rank, pooled_ranks
from ..functions.scan import numbered
from ..session import drop_table, materialize, materialize_alone, small
from .corr import spearman_matrix
from .panel import KEYS, SEGMENT, melt

NAMES = 1_000_000
#: Numbers of one date (names times columns) that one task holds.
CELLS = 20_000_000
#: Rows of one factor and date, following each other by score, that are stored as one row and ranked in one piece.
PIECE = 1 << 20
#: Rows that one task sorts to cut pieces, on average.
BLOCK = 1 << 20
LAYERS = 10
QUANTILES = {"p05": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95}


def forward_return(
    panel: DataFrame,
    horizon: int = 1,
    out: str = "future_return",
    dates: int | None = None,
    part: Sequence[str] = ("code",),
) -> DataFrame:
    """close[h rows later] / close - 1 over the rows each code has.

    With unique (time, code) rows a code has at most `dates` of them.  Up to one
    segment of dates the code's window is used; beyond it rows are numbered per
    code in calendar blocks and joined on (code, number + h), which spreads a
    long series over tasks.
    """
    if dates is None:
        dates = panel.select("trade_time").distinct().count()
    if dates <= SEGMENT:
        later = F.lead("close", horizon).over(Window.partitionBy(*part).orderBy("trade_time"))
        return panel.withColumn(out, nz(div(later, "close") - 1))
    return lead_by_number(panel, horizon, out, part=part)


def lead_by_number(
    panel: DataFrame, horizon: int, out: str, block: str = "month", part: Sequence[str] = ("code",)
) -> DataFrame:
    """`forward_return` without a window over a whole code."""
    part = list(part)
    cut = panel.withColumn("_blk", F.date_trunc(block, "trade_time"))
    sizes = cut.groupBy(*part, "_blk").agg(F.count("*").alias("n"))
    w = Window.partitionBy(*part).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(*part, "_blk", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("_off"))
    pos = F.row_number().over(Window.partitionBy(*part, "_blk").orderBy("trade_time"))
    rows = (
        cut.withColumn("_pos", pos)
        .join(before, [*part, "_blk"])
        .withColumn("_no", F.col("_off") + F.col("_pos"))
        .drop("_blk", "_off", "_pos")
    )
    later = rows.select(*part, (F.col("_no") - horizon).alias("_no"), F.col("close").alias("_later"))
    return (
        rows.join(later, [*part, "_no"], "left")
        .withColumn(out, nz(div("_later", "close") - 1))
        .drop("_no", "_later")
    )


def labelled(frame: DataFrame, factors: Sequence[str], horizon: int = 1, dates: int | None = None) -> DataFrame:
    """Long scores with the forward return as label, rows with both."""
    return long_scores(forward_return(frame, horizon, "label", dates), factors)


def long_scores(wide: DataFrame, factors: Sequence[str]) -> DataFrame:
    """Rows (factor, time, code, score, label) with both numbers."""
    long = melt(wide.where("label IS NOT NULL"), factors, [*KEYS, "label"])
    return long.select("factor", *KEYS, nz("score").alias("score"), "label").dropna(subset=["score", "label"])


def largest(df: DataFrame, part: Sequence[str], names: int | None = None) -> int:
    """Rows of the largest group, counted unless given."""
    if names is None:
        names = df.groupBy(*part).count().agg(F.max("count")).first()[0] or 0
    return names


def sized(df: DataFrame, part: Sequence[str], names: int | None) -> tuple[DataFrame, int]:
    """The table and the bound of a group's rows. Without a known bound the table is stored, so that counting it runs nothing twice."""
    if names is None:
        df = materialize(df)
        names = largest(df, part)
    return df, names


def ranked(df: DataFrame, part: Sequence[str], names: int) -> DataFrame:
    """Average ranks of score and label inside `part`, of at most `names` rows, as rx and ry; rows without both are dropped."""
    df = df.where(F.col("score").isNotNull() & F.col("label").isNotNull())
    if names <= NAMES:
        return df.withColumns({"rx": avg_rank("score", part), "ry": avg_rank("label", part)})
    return pooled_ranks(pooled_ranks(df, part, "score", "rx"), part, "label", "ry")


def daily_ic(long: DataFrame, part: Sequence[str] = ("factor", "trade_time"), names: int | None = None) -> DataFrame:
    """Pearson and Spearman of score and label per factor and date."""
    long, names = sized(long, part, names)
    return (
        ranked(long, part, names)
        .groupBy(*part)
        .agg(
            safe_corr("score", "label").alias("ic"),
            rank_corr("rx", "ry", names).alias("rank_ic"),
            F.count("*").alias("names"),
        )
    )


def pooled_ic(long: DataFrame) -> DataFrame:
    """Pearson and Spearman over all rows of a factor, NULL below two rows."""
    r = pooled_ranks(pooled_ranks(long, ["factor"], "score", "rx"), ["factor"], "label", "ry")
    return r.groupBy("factor").agg(
        safe_corr("score", "label").alias("ic"),
        rank_corr("rx", "ry").alias("rank_ic"),
        F.count("*").alias("rows"),
    )


def pooled_ic_wide(wide: DataFrame, factors: Sequence[str], label: str = "label") -> DataFrame:
    """`pooled_ic` of many columns of a stored frame: the label is one more column of the rank matrix."""
    names = [*factors, label]
    pairs = spearman_matrix(wide, names, pairs=[(f, label) for f in factors], stored=True)
    one = wide.agg(*[safe_corr(_both(f, label), _both(label, f)).alias(f) for f in factors])
    pearson = one.unpivot([], list(factors), "factor", "ic")
    return pearson.join(
        pairs.select(F.col("left").alias("factor"), F.col("spearman").alias("rank_ic"), F.col("n").alias("rows")), "factor"
    )


def _both(x: str, y: str):
    return F.when(nz(x).isNotNull() & nz(y).isNotNull(), nz(x))


def summary_columns():
    """Aggregates over daily ICs; `icir` is the rank ICIR by definition."""
    ic, rk = F.col("ic"), F.col("rank_ic")
    rank_icir = mean_over_std(F.avg(rk), F.stddev_samp(rk))
    return [
        F.avg(ic).alias("daily_ic_mean"),
        F.stddev_samp(ic).alias("daily_ic_std"),
        F.avg(rk).alias("daily_rank_ic_mean"),
        F.stddev_samp(rk).alias("daily_rank_ic_std"),
        rank_icir.alias("icir"),
        rank_icir.alias("rank_icir"),
        mean_over_std(F.avg(ic), F.stddev_samp(ic)).alias("pearson_icir"),
        F.count(ic).alias("daily_ic_count"),
        F.count(rk).alias("daily_rank_ic_count"),
    ]


def ic_summary(daily: DataFrame, part: Sequence[str] = ("factor",)) -> DataFrame:
    return daily.groupBy(*part).agg(*summary_columns())


def distribution_columns(col: str, prefix: str = ""):
    """Count, moments, exact percentiles and sign shares of a daily series."""
    x = F.col(col)
    qs = F.percentile(x, F.array(*[F.lit(q) for q in QUANTILES.values()]))
    share = lambda cond: F.avg(F.when(x.isNotNull(), cond.cast("double")))
    cols = {
        "count": F.count(x),
        "mean": F.avg(x),
        "std": F.stddev_samp(x),
        "min": F.min(x),
        **{name: qs[i] for i, name in enumerate(QUANTILES)},
        "max": F.max(x),
        "positive_rate": share(x > 0),
        "negative_rate": share(x < 0),
        "zero_rate": share(x == 0),
    }
    return [c.alias(prefix + n) for n, c in cols.items()]


def ic_distribution(daily: DataFrame, col: str = "rank_ic", part: Sequence[str] = ("factor",)) -> DataFrame:
    return daily.groupBy(*part).agg(*distribution_columns(col))


def decile_layer(
    long: DataFrame,
    part: Sequence[str] = ("factor", "trade_time"),
    layers: int = LAYERS,
    descending: bool = True,
    names: int | None = None,
) -> DataFrame:
    """Equal-count layers per date by first-come rank, layer 1 the highest; none under `layers` names."""
    order = F.col("score").desc() if descending else F.col("score").asc()
    long, names = sized(long, part, names)
    if names <= NAMES:
        placed = long.withColumn("_r", F.row_number().over(Window.partitionBy(*part).orderBy(order, "code")))
        placed = placed.withColumn("_n", F.count("*").over(Window.partitionBy(*part)))
    else:
        sizes = long.groupBy(*part).agg(F.count("*").alias("_n"))
        placed = numbered(long, part, [order, F.col("code").asc()], "_r").join(sizes, list(part))
    # ceil((r - 1) * layers / (n - 1)) in integers
    up = F.floor(((F.col("_r") - 1) * layers + F.col("_n") - 2) / (F.col("_n") - 1)).cast("int")
    layer = F.when(F.col("_n") >= layers, F.greatest(F.lit(1), up))
    return placed.withColumn("layer", layer).drop("_r", "_n")


def layered_ic(long: DataFrame, layers: int = LAYERS, names: int | None = None) -> DataFrame:
    """Daily ICs inside each decile layer, summarised; all layer names present."""
    long, names = sized(long, ("factor", "trade_time"), names)
    if names <= NAMES:
        cut = decile_layer(long, layers=layers, names=names).where(F.col("layer").isNotNull())
        daily, factors = daily_ic(cut, ("factor", "layer", "trade_time"), names), long.select("factor").distinct()
    else:
        daily, factors = layers_in_pieces(long, layers, names)
    got = daily.groupBy("factor", "layer").agg(*summary_columns(), F.sum("names").alias("rows"))
    return with_all_layers(got, factors, layers)


def layers_in_pieces(long: DataFrame, layers: int, names: int) -> tuple[DataFrame, DataFrame]:
    """Daily ICs inside the layers of `decile_layer` for dates of any size, and the factors there are.

    The long table is stored, so that nothing else of its making stays on disk, and exchanged once: sorted by factor, date,
    score and code in blocks, and kept as pieces, the numbers of one factor and date in their order. A layer is a stretch of
    that order. Where a single piece holds all of it, it is ranked there; only rows of layers that reach over several pieces
    meet again, in block ranks.
    """
    part, columns = ["factor", "trade_time"], ["factor", "layer", "trade_time", "ic", "rank_ic", "names"]
    order = [*part, F.col("score").desc(), F.col("code").asc()]
    long = materialize_alone(long.select(*part, "code", *[F.col(c).cast("double").alias(c) for c in ("score", "label")]))
    blocks = max(long.sparkSession.sparkContext.defaultParallelism, -(-long.count() // BLOCK))
    rows = long.repartitionByRange(blocks, *order).sortWithinPartitions(*order).select(
        *part, "score", "label", F.spark_partition_id().alias("blk")
    )
    keys = ", ".join(f"{c} {t}" for c, t in long.select(*part).dtypes)
    stored = f"{keys}, blk int, run int, n bigint, score binary, label binary, known binary"
    pieces = materialize_alone(rows.mapInArrow(_pieces(part, PIECE), stored))
    drop_table(long)
    group = Window.partitionBy(*part)
    earlier = group.orderBy("blk", "run").rowsBetween(Window.unboundedPreceding, -1)
    before, total = F.coalesce(F.sum("n").over(earlier), F.lit(0)), F.sum("n").over(group)
    places = materialize(pieces.select(*part, "blk", "run", "n", before.alias("before"), total.alias("total")))
    # most dates lie in one piece; of the others there are a few pieces per block, or large ones
    split = places.where("total > n").select("blk", "run", "before", "total")
    placed = pieces.join(small(split, split.count()), ["blk", "run"], "left").dropna(subset=part)
    placed = placed.select(*part, F.coalesce("before", F.lit(0)).alias("before"), F.coalesce("total", "n").alias("total"), "n", "score", "label", "known")
    found = f"{keys}, layer int, ic double, rank_ic double, names bigint, score double, label double"
    found = materialize(placed.mapInArrow(_piece_layers(part, layers), found))
    drop_table(pieces)
    across = daily_ic(found.where("names IS NULL").select(*part, "layer", "score", "label"), ("factor", "layer", "trade_time"), names)
    daily = found.where("names IS NOT NULL").select(*columns).unionByName(across.select(*columns))
    return daily, places.select("factor").distinct()


def _pieces(part: Sequence[str], most: int):
    """Sorted rows of a block to a row per piece of at most `most` rows: their numbers as bytes, and which rows have both unless all do."""

    def packed(batch, rows):
        kinds = [*[batch.schema.field(c).type for c in part], pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 3]
        names = [*part, "blk", "run", "n", "score", "label", "known"]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def piece(key, run, held):
        score, label, known = (np.concatenate(a) for a in zip(*held, strict=True))
        return (*key, run, len(score), score.tobytes(), label.tobytes(), None if known.all() else np.packbits(known).tobytes())

    def run(batches):
        key, held, size, no, batch = None, [], 0, 0, None
        for batch in batches:
            score, label = batch.column("score"), batch.column("label")
            known = pc.and_(pc.is_valid(score), pc.is_valid(label)).to_numpy(zero_copy_only=False)
            numbers = [score.to_numpy(zero_copy_only=False), label.to_numpy(zero_copy_only=False), known]
            changes = np.zeros(max(len(batch) - 1, 0), dtype=bool)
            for c in part:
                codes = batch.column(c).dictionary_encode(null_encoding="encode").indices.to_numpy()
                changes |= codes[1:] != codes[:-1]
            starts = [*np.r_[0, np.flatnonzero(changes) + 1].tolist(), len(batch)] if len(batch) else []
            done = []
            for start, stop in zip(starts[:-1], starts[1:], strict=True):
                here = (*[batch.column(c)[start].as_py() for c in part], batch.column("blk")[start].as_py())
                while start < stop:
                    if held and (here != key or size == most):
                        done.append(piece(key, no, held))
                        held, size, no = [], 0, no + 1
                    key, end = here, min(stop, start + most - size)
                    held.append([a[start:end].copy() for a in numbers])
                    size, start = size + end - start, end
            if done:
                yield packed(batch, done)
        if held:
            yield packed(batch, [piece(key, no, held)])

    return run


def _piece_layers(part: Sequence[str], layers: int):
    """Pieces to the ICs of the layers that lie in one piece, and to the rows of other layers, which have no `names`."""
    columns = [*part, "layer", "ic", "rank_ic", "names", "score", "label"]
    kinds = [pa.int32(), pa.float64(), pa.float64(), pa.int64(), pa.float64(), pa.float64()]

    def run(batches):
        for batch in batches:
            types = [*[batch.schema.field(c).type for c in part], *kinds]
            whole = []
            for i in range(len(batch)):
                before, total, n = (batch.column(c)[i].as_py() for c in ("before", "total", "n"))
                if total < layers:
                    continue
                score, label = (np.frombuffer(batch.column(c)[i].as_buffer()) for c in ("score", "label"))
                bits, known = batch.column("known")[i], np.ones(n, dtype=bool)
                if bits.is_valid:
                    known = np.unpackbits(np.frombuffer(bits.as_buffer(), dtype="uint8"), count=n).astype(bool)
                # the first and the last place, from 0, of each layer on its date
                last = [k * (total - 1) // layers for k in range(1, layers + 1)]
                for k, (first, end) in enumerate(zip([0, *[x + 1 for x in last[:-1]]], last, strict=True), 1):
                    at = slice(max(first - before, 0), max(min(end + 1 - before, n), 0))
                    x, y = score[at][known[at]], label[at][known[at]]
                    if not len(x):
                        continue
                    if before <= first and end < before + n:
                        key = [batch.column(c)[i].as_py() for c in part]
                        # as the sums of `safe_corr`, which are NaN with such a number
                        odd = not (np.isfinite(x).all() and np.isfinite(y).all())
                        whole.append((*key, k, float("nan") if odd else _correlation(x, y), _rank_correlation(x, y), len(x), None, None))
                        continue
                    key = [pa.repeat(batch.column(c)[i], len(x)) for c in part]
                    rest = [pa.nulls(len(x), t) for t in kinds[1:4]]
                    yield pa.RecordBatch.from_arrays([*key, pa.repeat(pa.scalar(k, pa.int32()), len(x)), *rest, pa.array(x), pa.array(y)], names=columns)
            if whole:
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*whole, strict=True), types, strict=True)], names=columns)

    return run


def layer_diagnostics(long: DataFrame, factors: Sequence[str] | None = None, layers: int = LAYERS) -> DataFrame:
    """Per factor: rows with score and label, rows in a layer and in none, dates, dates with too few names, and the reason where no row has a layer.

    A date has layers if `layers` names have both, so the counts per date are enough: no row is ranked. `factors`
    adds those without any row.
    """
    known = F.col("score").isNotNull() & F.col("label").isNotNull()
    daily = long.groupBy("factor", "trade_time").agg(F.count(F.when(known, 1)).alias("n")).where("n > 0")
    enough = F.col("n") >= layers
    got = daily.groupBy("factor").agg(
        F.sum("n").alias("joined_rows"),
        F.sum(F.when(enough, F.col("n")).otherwise(0)).alias("layered_rows"),
        F.sum(F.when(enough, 0).otherwise(F.col("n"))).alias("unlayered_rows"),
        F.count("*").alias("dates"),
        F.count(F.when(~enough, 1)).alias("thin_dates"),
    )
    names = long.select("factor").distinct()
    if factors is not None:
        slots = F.explode(F.array(*[F.lit(f) for f in factors]).cast("array<string>")).alias("factor")
        names = long.sparkSession.range(1).select(slots)
    reason = F.when(F.col("joined_rows") == 0, "no non-null score/label rows").when(
        F.col("layered_rows") == 0, f"no date has {layers} names with score and label"
    )
    return names.join(got, "factor", "left").fillna(0).withColumn("reason", reason)


def with_all_layers(got: DataFrame, factors: DataFrame, layers: int) -> DataFrame:
    """One row for every layer of every factor; counts of a layer without rows are zero."""
    slots = factors.select("factor", F.explode(F.sequence(F.lit(1), F.lit(layers))).alias("layer"))
    zero = {c: 0 for c in ("rows", "daily_ic_count", "daily_rank_ic_count")}
    return (
        slots.join(got, ["factor", "layer"], "left")
        .fillna(zero)
        .select(F.concat(F.lit("Decile"), F.col("layer")).alias("layer_name"), "*")
        .drop("layer")
    )


def coverage(frame: DataFrame, factors: Sequence[str]) -> DataFrame:
    """Share of panel rows with and without a value, per factor, in one pass."""
    one = frame.agg(*[F.avg(nz(f).isNotNull().cast("double")).alias(f) for f in factors])
    return one.unpivot([], list(factors), "factor", "coverage").withColumn(
        "missing_rate", 1 - F.col("coverage")
    )


def prediction_ic(label: DataFrame, pred: DataFrame, names: int | None = None) -> DataFrame:
    """Rank IC of predictions against labels with the reason when there is none.

    `label` and `pred` have (trade_time, code, label | score).  One output row.
    """
    j = materialize(label.join(pred, KEYS, "left"))
    both = j.where(nz("score").isNotNull() & nz("label").isNotNull()).withColumn("factor", F.lit("pred"))
    total = pooled_ic(both).select("rank_ic")
    daily = daily_ic(both, names=names).agg(
        F.avg("rank_ic").alias("daily_rank_ic_mean"),
        F.stddev_samp("rank_ic").alias("daily_rank_ic_std"),
        F.count("rank_ic").alias("daily_ic_count"),
    )
    sizes = j.agg(
        F.count("*").alias("test_label_rows"),
        F.count(F.when(nz("score").isNotNull() & nz("label").isNotNull(), 1)).alias("joined_rows"),
    )
    uniq = both.agg(
        F.countDistinct("score").alias("prediction_unique"), F.countDistinct("label").alias("label_unique")
    )
    reason = (
        F.when(F.col("joined_rows") == 0, "prediction and label have no overlapping non-null rows")
        .when(F.col("prediction_unique") < 2, "prediction is constant or has fewer than 2 unique values")
        .when(F.col("label_unique") < 2, "label is constant or has fewer than 2 unique values")
        .when(
            F.col("daily_ic_count") == 0,
            "no date has at least 2 non-null instruments with non-constant pred/label",
        )
    )
    key = F.lit(1).alias("_k")
    parts = [x.select("*", key) for x in (sizes, uniq, daily, total)]
    row = parts[0]
    for p in parts[1:]:
        row = row.join(p, "_k", "left")
    return row.drop("_k").select(
        "*",
        mean_over_std("daily_rank_ic_mean", "daily_rank_ic_std").alias("icir"),
        reason.alias("nan_reason"),
    )


def _average_ranks(x: np.ndarray) -> np.ndarray:
    _, at, counts = np.unique(x, return_inverse=True, return_counts=True)
    ends = np.cumsum(counts)
    return (ends - (counts - 1) / 2.0)[at]


def _correlation(x: np.ndarray, y: np.ndarray) -> float | None:
    if len(x) < 2 or x.max() == x.min() or y.max() == y.min():
        return None
    dx, dy = x - x.mean(), y - y.mean()
    return float((dx @ dy) / np.sqrt((dx @ dx) * (dy @ dy)))


def _rank_correlation(x: np.ndarray, y: np.ndarray) -> float | None:
    """`numeric.rank_corr` of up to two million rows: whole sums of twice the ranks, less their mean."""
    rx, ry = ((2 * _average_ranks(v)).astype("int64") - (len(v) + 1) for v in (x, y))
    sxy, sxx, syy = (float(a @ b) for a, b in ((rx, ry), (rx, rx), (ry, ry)))
    return sxy / np.sqrt(sxx * syy) if sxx > 0 and syy > 0 else None


def daily_ic_wide(wide: DataFrame, factors: Sequence[str], names: int) -> DataFrame:
    """`daily_ic` of many columns of a frame with labels: one exchange by date where a date's columns fit into a task (`CELLS`)."""
    if names * (len(factors) + 2) <= CELLS:
        return ics_by_date(wide, factors, layers=0).drop("layer")
    return daily_ic(long_scores(wide, factors), names=names)


def ics_by_date(wide: DataFrame, factors: Sequence[str], layers: int = LAYERS) -> DataFrame:
    """(factor, layer, trade_time, ic, rank_ic, names) of every date, layer 0 being the whole date; no others if `layers` is 0.

    The wide table is exchanged once, by date, and a date's columns fit into a task (`CELLS`).
    There every label ranking is made once per set of rows that a factor has,
    and the same sorted scores give ranks and layers.
    """
    factors, columns = list(factors), ["factor", "layer", "trade_time", "ic", "rank_ic", "names"]
    time_type = wide.schema["trade_time"].dataType.simpleString()

    def run(table):
        # by code: sums and first-come layers do not depend on how rows arrive
        table = table.take(pc.sort_indices(table.column("code")))
        label, code = table.column("label").to_numpy(), np.arange(len(table))
        known_label, at, ranked_label, rows = np.isfinite(label), table.column("trade_time")[0], {}, []

        def add(factor, layer, score, y, ry):
            rows.append((factor, layer, _correlation(score, y), _correlation(_average_ranks(score), ry), len(score)))

        for f in factors:
            score = table.column(f).to_numpy().astype(float)
            has = known_label & np.isfinite(score)
            n = int(has.sum())
            if n == 0:
                continue
            x, y = score[has], label[has]
            mask = has.tobytes()
            if mask not in ranked_label:
                ranked_label[mask] = _average_ranks(y)
            add(f, 0, x, y, ranked_label[mask])
            if 0 < layers <= n:
                order = np.lexsort((code[has], -x))
                layer = np.maximum(1, (np.arange(n) * layers + n - 2) // (n - 1))
                for k in range(1, layers + 1):
                    some = order[layer == k]
                    if len(some):
                        add(f, k, x[some], y[some], _average_ranks(y[some]))
        cols = list(zip(*rows, strict=True)) or [(), (), (), (), ()]
        kinds = (pa.string(), pa.int32(), pa.float64(), pa.float64(), pa.int64())
        factor, layer, ic_value, rank_ic, names = (pa.array(c, t) for c, t in zip(cols, kinds, strict=True))
        times = pa.array([at.as_py()] * len(rows), at.type)
        return pa.table([factor, layer, times, ic_value, rank_ic, names], names=columns)

    kept = wide.where("label IS NOT NULL").select("trade_time", "code", "label", *[nz(f).alias(f) for f in factors])
    schema = f"factor string, layer int, trade_time {time_type}, ic double, rank_ic double, names long"
    return kept.groupBy("trade_time").applyInArrow(run, schema)


def frame_summary(frame: DataFrame) -> DataFrame:
    """Rows, instruments and the first and last date of a factor frame, in one row."""
    codes = frame.select("code").distinct().agg(F.count("*").alias("instruments"))
    ends = frame.agg(F.count("*").alias("rows"), F.min("trade_time").alias("start"), F.max("trade_time").alias("end"))
    return ends.crossJoin(F.broadcast(codes))


def factor_analyze(
    frame: DataFrame, factors: Sequence[str], horizon: int = 1, dates: int | None = None, names: int | None = None
) -> DataFrame:
    """The full metric record of every factor, all factors in one plan.

    Panel, factors and label are stored once; every part of the record reads
    that copy, whose rows are already one per (date, code). Daily and layered ICs come
    out of one exchange by date; beyond `CELLS` numbers on a date they come from windows or block ranks.
    """
    frame = frame.select(*KEYS, "close", *factors)
    frame = materialize(forward_return(frame, horizon, "label", dates))
    names = largest(frame, ["trade_time"]) if names is None else names
    if names * (len(factors) + 2) <= CELLS:
        by_date = materialize(ics_by_date(frame, factors))
        daily = by_date.where("layer = 0")
        layered = by_date.where("layer > 0").groupBy("factor", "layer").agg(*summary_columns(), F.sum("names").alias("rows"))
        layered = with_all_layers(layered, daily.select("factor").distinct(), LAYERS)
    else:
        long = long_scores(frame, factors)
        daily = daily_ic(long, names=names)
        layered = layered_ic(long, names=names)
    scalars = daily.groupBy("factor").agg(
        *summary_columns(),
        F.struct(*distribution_columns("ic")).alias("ic_distribution"),
        F.struct(*distribution_columns("rank_ic")).alias("rank_ic_distribution"),
    )
    pooled = pooled_ic_wide(frame, factors).select("factor", "ic", "rank_ic", F.col("rows").alias("joined_rows"))
    record = [c for c in layered.columns if c not in ("factor", "layer_name")]
    layers = (
        layered.groupBy("factor")
        .agg(
            F.map_from_entries(
                F.array_sort(F.collect_list(F.struct("layer_name", F.struct(*record).alias("record"))))
            ).alias("deciles"),
            F.sum("rows").alias("layered_rows"),
        )
    )
    return (
        coverage(frame, factors)
        .join(pooled, "factor", "left")
        .join(scalars, "factor", "left")
        .join(layers, "factor", "left")
    )
