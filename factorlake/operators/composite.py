"""IC-weighted composite of accepted factors, the marginal gate and out-of-sample windows.

Scores are long: (factor, trade_time, code, score, close).  A scenario is a set
of weights, so several library variants are evaluated in one plan.

A library under change is kept as a table of sums per cell: of w * rank, of |w|, and of the
factors present. A factor that comes or goes adds or subtracts its own share, so judging a
candidate reads the rows of that candidate and of what it replaces, and one row per cell, however many factors the library
has. Shares are whole numbers in units of 1 / `UNITS`, so that a sum after additions and subtractions
is the sum of what is left, to the last bit.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import nz, rank_corr
from ..functions.ranks import ordered_blocks, pct_rank, pooled_ranks
from ..session import materialize
from . import ic as I
from .panel import KEYS

MIN_DELTA = 0.0
#: Units of a share: |w| up to 1 leaves room for 32,000 factors in 64 bits, and errs by 4e-15 at most.
UNITS = float(1 << 47)


def components(metrics: DataFrame, threshold: float = 0.01) -> DataFrame:
    """(factor, weight) of factors whose IC passes the screen; `metrics` has factor, ic."""
    return metrics.where(nz("ic") > threshold).select("factor", F.col("ic").alias("weight"))


def normalized_weights(weights: DataFrame, part: Sequence[str] = ()) -> DataFrame:
    total = weights.groupBy(*part).agg(F.sum(F.abs("weight")).alias("_total"))
    if part:
        both = weights.join(total, list(part))
    else:
        both = weights.withColumn("_k", F.lit(1)).join(total.withColumn("_k", F.lit(1)), "_k").drop("_k")
    return both.withColumn("normalized", F.try_divide("weight", "_total")).drop("_total")


def composite_rank(scores: DataFrame, names: int | None = None) -> DataFrame:
    """Per factor and date the percentile rank minus one half."""
    known = scores.where(nz("score").isNotNull())
    part = ["factor", "trade_time"]
    known, names = I.sized(known, part, names)
    if names <= I.NAMES:
        return known.withColumn("rank", pct_rank("score", part) - 0.5)
    sizes = known.groupBy(*part).agg(F.count("*").alias("_n"))
    ranked = pooled_ranks(known, part, "score", "_r").join(sizes, part)
    return ranked.withColumn("rank", F.col("_r") / F.col("_n") - 0.5).drop("_r", "_n")


def composite_score(ranked: DataFrame, weights: DataFrame, part: Sequence[str] = ()) -> DataFrame:
    """sum(w * rank) / sum(|w|) over the factors present; close from the first factor that has one.

    `weights` has (part..., factor, weight, ord); one row per library member.
    """
    top, bottom = F.sum(F.col("weight") * F.col("rank")), F.sum(F.abs("weight"))
    known_close = F.when(nz("close").isNotNull(), F.col("ord"))
    return (
        ranked.join(weights, "factor")
        .groupBy(*part, *KEYS)
        .agg(
            F.try_divide(top, bottom).alias("score"),
            F.min_by("close", known_close).alias("close"),
        )
        .where("score IS NOT NULL")
    )


def with_order(weights: DataFrame, part: Sequence[str] = ()) -> DataFrame:
    """Component order (by name) for choosing a close; a library is a small table."""
    w = Window.partitionBy(*(list(part) or [F.lit(0)])).orderBy("factor")
    return weights.withColumn("ord", F.row_number().over(w))


def composite_ic(
    composite: DataFrame, part: Sequence[str] = (), horizon: int = 1, dates: int | None = None, names: int | None = None
) -> DataFrame:
    """Daily rank IC mean and count of each scenario's composite over its own rows; `names` bounds those of a date."""
    lab = I.forward_return(composite, horizon, "label", dates, (*part, "code"))
    rows = lab.where("label IS NOT NULL")
    day = [*part, "trade_time"]
    rows, names = I.sized(rows, day, names)
    daily = I.ranked(rows, day, names).groupBy(*day).agg(rank_corr("rx", "ry", names).alias("rank_ic"))
    return daily.groupBy(*part).agg(F.avg("rank_ic").alias("rank_ic"), F.count("rank_ic").alias("days"))


def replace_components(library: DataFrame, replaced: DataFrame, candidate: DataFrame) -> DataFrame:
    """Library without the replaced names and the candidate's own old row, plus the candidate."""
    gone = replaced.select("factor").unionByName(candidate.select("factor")).distinct()
    return library.join(gone, "factor", "left_anti").unionByName(candidate)


def stored_ranks(scores: DataFrame, names: int | None = None) -> DataFrame:
    """`composite_rank` of all scores, stored in the order of factors, so that those of one factor are few row groups."""
    ranked = composite_rank(scores, names).select("factor", *KEYS, "rank", "close")
    return ordered_blocks(ranked, ["factor", *KEYS]).drop("blk")


def composite_sums(ranked: DataFrame, weights: DataFrame) -> DataFrame:
    """(time, code, top, bottom, members, close): the sums of a library, which `composite_change` moves on.

    `weights` has (factor, weight), and a sign of -1 for a factor that goes. The close is that of the first factor with one.
    """
    sign = F.col("sign") if "sign" in weights.columns else F.lit(1)
    known_close = F.when(nz("close").isNotNull(), F.col("factor"))
    top, bottom = (F.round(x * UNITS).cast("bigint") for x in (F.col("weight") * F.col("rank"), F.abs("weight")))
    rows = ranked.join(weights, "factor")
    return rows.groupBy(*KEYS).agg(
        F.sum(sign * top).alias("top"),
        F.sum(sign * bottom).alias("bottom"),
        F.sum(sign.cast("bigint")).alias("members"),
        F.min_by("close", known_close).alias("close"),
    )


def composite_change(sums: DataFrame, ranked: DataFrame, change: DataFrame) -> DataFrame:
    """The sums after factors came (sign 1) or went (sign -1); cells without a factor are gone.

    `change` has (factor, weight, sign). A cell keeps its close, which is the market's and not a factor's.
    """
    moved = composite_sums(ranked, change).withColumn("_new", F.lit(1))
    both = sums.withColumn("_new", F.lit(0)).unionByName(moved)
    known_close = F.when(nz("close").isNotNull(), F.col("_new"))
    after = both.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in ("top", "bottom", "members")], F.min_by("close", known_close).alias("close"))
    return after.where("members > 0")


def composite_of(sums: DataFrame) -> DataFrame:
    """`composite_score` of a library kept as sums."""
    score = F.try_divide(F.col("top").cast("double"), F.col("bottom").cast("double"))
    return sums.where("members > 0").select(*KEYS, score.alias("score"), "close").where("score IS NOT NULL")


def marginal_gate(
    scores: DataFrame,
    library: DataFrame,
    candidate: DataFrame,
    replaced: DataFrame | None = None,
    min_delta: float = MIN_DELTA,
    horizon: int = 1,
    dates: int | None = None,
    names: int | None = None,
    ranked: DataFrame | None = None,
) -> DataFrame:
    """Composite rank IC with the candidate minus without; one row with the verdict.

    `library` and `candidate` have (factor, weight). The library is summed once, the candidate and
    what it replaces are the change of those sums; `judged_change` judges further changes of a stored library.
    """
    replaced = library.limit(0) if replaced is None else replaced
    base, new = library.select("factor", "weight"), candidate.select("factor", "weight")
    gone = base.join(replaced.select("factor").unionByName(new.select("factor")).distinct(), "factor", "left_semi")
    change = new.withColumn("sign", F.lit(1)).unionByName(gone.withColumn("sign", F.lit(-1)))
    if ranked is None:
        needed = base.select("factor").unionByName(new.select("factor")).distinct()
        ranked = stored_ranks(scores.join(needed, "factor", "left_semi"), names)
    sums = materialize(composite_sums(ranked, base))
    sizes = base.agg(F.count("*").alias("baseline_count")).withColumn("_k", F.lit(1))
    moved = change.agg(F.coalesce(F.sum("sign"), F.lit(0)).alias("_d")).withColumn("_k", F.lit(1))
    before = composite_ic(composite_of(sums), (), horizon, dates, names).select(F.col("rank_ic").alias("baseline_rank_ic"), F.lit(1).alias("_k"))
    after = composite_ic(composite_of(composite_change(sums, ranked, change)), (), horizon, dates, names)
    after = after.select(F.col("rank_ic").alias("with_candidate_rank_ic"), F.lit(1).alias("_k"))
    row = sizes.join(moved, "_k").join(before, "_k").join(after, "_k").drop("_k")
    row = row.withColumn("with_candidate_count", F.col("baseline_count") + F.col("_d")).drop("_d")
    return gate_verdict(row, min_delta)


def judged_change(
    sums: DataFrame, before: float | None, count: int, ranked: DataFrame, change: Sequence[tuple[str, float, int]],
    min_delta: float = MIN_DELTA, horizon: int = 1, dates: int | None = None, names: int | None = None,
) -> tuple[DataFrame, dict]:
    """The stored sums after a change (factor, weight, sign) of a library, and the gate's verdict on it.

    `before` is the composite rank IC of `sums` and `count` its factors, known from the step before. Only the rows of the
    changed factors are read from `ranked`.
    """
    spark = ranked.sparkSession
    rows = ranked.where(F.col("factor").isin([f for f, _, _ in change]))
    table = F.broadcast(spark.createDataFrame(change, "factor string, weight double, sign int"))
    after = materialize(composite_change(sums, rows, table))
    ic = composite_ic(composite_of(after), (), horizon, dates, names).first()["rank_ic"]
    schema = "baseline_rank_ic double, with_candidate_rank_ic double, baseline_count long, with_candidate_count long"
    row = spark.createDataFrame([(before, ic, count, count + sum(s for _, _, s in change))], schema)
    return after, gate_verdict(row, min_delta).first().asDict()


def gate_verdict(row: DataFrame, min_delta: float = MIN_DELTA) -> DataFrame:
    """Adds delta, passed, verdict and reason to the two rank ICs and counts of a gate."""
    delta = F.col("with_candidate_rank_ic") - F.col("baseline_rank_ic")
    reason = (
        F.when(F.col("baseline_count") == 0, "no existing accepted components")
        .when(F.col("delta_rank_ic").isNull(), "composite rank IC unavailable")
        .when(F.col("passed"), "candidate improves or preserves composite rank IC")
        .otherwise("candidate reduces composite rank IC")
    )
    verdict = (
        F.when(F.col("baseline_count") == 0, "skipped").when(F.col("passed"), "accepted").otherwise("rejected")
    )
    return (
        row.withColumn("delta_rank_ic", delta)
        .withColumn(
            "passed",
            (F.col("baseline_count") == 0) | F.coalesce(F.col("delta_rank_ic") >= min_delta, F.lit(False)),
        )
        .withColumns({"verdict": verdict, "reason": reason})
    )


def oos_period(end: Column, start: Column | None = None, stop: Column | None = None, warmup: Column | None = None):
    """Dates of the out-of-sample window: (start, end, warm-up start, warm-up days)."""
    null = F.lit(None).cast("date")
    begin = F.coalesce(start if start is not None else null, F.date_add(end, 1))
    stop = F.coalesce(stop if stop is not None else null, F.date_add(F.add_months(begin, 12), -1))
    warm = F.coalesce(warmup if warmup is not None else null, F.add_months(begin, -12))
    return begin, stop, warm, F.datediff(begin, warm)


def oos_problem(begin: Column, stop: Column, warm: Column) -> Column:
    """What is wrong with the order of a window's dates, the first that applies; NULL where nothing is."""
    return F.when(begin > stop, "start is after the end").when(warm > begin, "warm-up begins after the start")


def oos_window(end: Column, start: Column | None = None, stop: Column | None = None, warmup: Column | None = None) -> dict[str, Column]:
    """Columns of the out-of-sample window by name, with where each date comes from and what is wrong with their order."""
    begin, until, warm, days = oos_period(end, start, stop, warmup)
    given = {"start": start, "stop": stop, "warmup": warmup}
    source = {
        f"{n}_source": F.lit("default") if c is None else F.when(c.isNull(), "default").otherwise("configured") for n, c in given.items()
    }
    dates = {"in_sample_end": end, "start": begin, "stop": until, "warmup": warm, "warmup_days": days.cast("bigint")}
    return dates | source | {"problem": oos_problem(begin, until, warm)}


def oos_trim(frame: DataFrame, start) -> DataFrame:
    """Rows from the out-of-sample start on; applied after the factor windows."""
    return frame.where(F.col("trade_time") >= F.lit(start).cast("timestamp_ntz"))


def train_valid_test(frame: DataFrame, start: str, end: str) -> DataFrame:
    """60/80 percent calendar-day split; both ends inclusive, so boundary days are in two segments."""
    begin, stop = F.to_date(F.lit(start)), F.to_date(F.lit(end))
    days = F.datediff(stop, begin) + 1
    cut_a = F.date_add(begin, F.floor(days * 0.6).cast("int"))
    cut_b = F.date_add(begin, F.floor(days * 0.8).cast("int"))
    day = F.to_date("trade_time")
    tags = F.array_compact(
        F.array(
            F.when(day.between(begin, cut_a), F.lit("train")),
            F.when(day.between(cut_a, cut_b), F.lit("valid")),
            F.when(day.between(cut_b, stop), F.lit("test")),
        )
    )
    return frame.withColumn("segment", F.explode(tags))
