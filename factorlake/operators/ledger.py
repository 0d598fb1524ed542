"""Analytics over the ledger of past candidates: rates, directions, failures, patterns, rounds.

Tables with one row per candidate may be of any size and are always aggregated
or block-scanned first.  Tables with one row per round, direction key or error
type are small by construction; windows over them are plain.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import nz
from ..functions.scan import cut, numbered, scan
from .panel import keep_first

# Weights of the direction score and of its sums.
PRIOR_A, PRIOR_B, EXPLORE = 1.0, 4.0, 0.25
IC_CLIP, IC_GAIN, DUPLICATE_COST, FAILURE_COST = 0.1, 2.0, 0.15, 0.10
BRANCH_WEIGHT, MODE_WEIGHT, MODE_AXIS_WEIGHT = 0.4, 0.2, 0.3
SUCCESS_BASE = {"High": 2.0, "Medium": 1.0, "Low": 0.5}
EVENT_COLUMNS = ["round", "candidate_index", "module", "branch", "mode", "axis", "parent", "ic"]


def admission_events(ledger: DataFrame) -> DataFrame:
    return ledger.where("accepted").select(*EVENT_COLUMNS)


def rejection_events(ledger: DataFrame) -> DataFrame:
    """Failed and duplicate candidates, and good ones the library refused."""
    own = ledger.where(F.col("label").isin("failed", "duplicate")).select(
        *EVENT_COLUMNS, "label", F.coalesce("error", F.lit("")).alias("reason"), "error_type"
    )
    refused = ledger.where(~F.col("accepted") & ~F.col("label").isin("failed", "duplicate")).select(
        *EVENT_COLUMNS,
        F.lit("library_rejected").alias("label"),
        F.lit("library review failed").alias("reason"),
        F.lit("FactorLibraryRejected").alias("error_type"),
    )
    return own.unionByName(refused)


def admission_rate(ledger: DataFrame, last: int = 5) -> DataFrame:
    """Admitted, rejected and rate per round, and the mean rate of the last rounds."""
    per = ledger.groupBy("round").agg(
        F.sum(F.col("accepted").cast("bigint")).alias("admitted"),
        F.sum((~F.col("accepted")).cast("bigint")).alias("rejected"),
    )
    rate = F.col("admitted") / (F.col("admitted") + F.col("rejected"))
    recent = Window.orderBy("round").rowsBetween(-(last - 1), 0)
    return per.withColumn("rate", rate).withColumn("recent_rate", F.avg("rate").over(recent))


def library_size(deltas: DataFrame, order: Sequence[str] = ("round",), delta: str = "delta") -> DataFrame:
    """Running size floored at zero after every step.

    S_t = P_t - min(0, lowest P up to t) for the prefix sum P, so no fold is needed.
    """
    run = scan(cut(deltas, [], order), [], order, sums={"_p": delta}).withColumn("_n", -F.col("_p"))
    low = scan(run, [], order, maxes={"_m": "_n"})
    return low.select(*deltas.columns, (F.col("_p") + F.greatest(F.lit(0), "_m")).cast("bigint").alias("library_size"))


def direction_stats(admissions: DataFrame, rejections: DataFrame) -> DataFrame:
    """Attempts, successes, duplicates, failures, IC sum and count by six kinds of key."""
    cols = ["branch", "mode", "axis", "parent", "ic"]
    both = admissions.select(*cols, F.lit(True).alias("win"), F.lit("accepted").alias("label")).unionByName(
        rejections.select(*cols, F.lit(False).alias("win"), "label")
    )
    both = both.where(F.coalesce(F.trim("branch"), F.lit("")) != "").withColumn(
        "mode", F.coalesce("mode", F.lit("novelty"))
    )

    def key(kind, *parts, need=None):
        entry = F.struct(F.lit(kind).alias("kind"), F.concat_ws("|", *parts).alias("key"))
        return entry if need is None else F.when(F.coalesce(F.trim(need), F.lit("")) != "", entry)

    keys = F.array_compact(
        F.array(
            key("branch", "branch"),
            key("mode", "mode"),
            key("mode_branch", "mode", "branch"),
            key("axis", "axis", need="axis"),
            key("mode_axis", "mode", "axis", need="axis"),
            key("parent", "parent", need="parent"),
        )
    )
    known = nz("ic")
    lose = ~F.col("win")
    return (
        both.withColumn("k", F.explode(keys))
        .groupBy(F.col("k.kind").alias("kind"), F.col("k.key").alias("key"))
        .agg(
            F.count("*").alias("attempts"),
            F.sum(F.col("win").cast("bigint")).alias("successes"),
            F.sum((lose & (F.col("label") == "duplicate")).cast("bigint")).alias("duplicates"),
            F.sum((lose & (F.col("label") != "duplicate")).cast("bigint")).alias("failures"),
            F.coalesce(F.sum(known), F.lit(0.0)).alias("ic_sum"),
            F.count(known).alias("ic_count"),
        )
    )


def score_column(total: Column) -> Column:
    """Smoothed success share, exploration bonus, clipped IC gain, duplicate and failure costs."""
    c = lambda n: F.coalesce(F.col(n).cast("double"), F.lit(0.0))
    n = c("attempts")
    share = lambda x: F.coalesce(F.try_divide(c(x), n), F.lit(0.0))
    mean = F.coalesce(F.try_divide(c("ic_sum"), c("ic_count")), F.lit(0.0))
    return (
        (c("successes") + PRIOR_A) / (n + PRIOR_A + PRIOR_B)
        + EXPLORE * F.sqrt(F.log(total + 1.0) / (n + 1.0))
        + IC_GAIN * F.greatest(F.lit(0.0), F.least(mean, F.lit(IC_CLIP)))
        - DUPLICATE_COST * share("duplicates")
        - FAILURE_COST * share("failures")
    )


def direction_score(stats: DataFrame) -> DataFrame:
    """Score per key; attempts are summed over all keys."""
    total = stats.agg(F.sum("attempts").cast("double").alias("_total")).withColumn("_k", F.lit(1))
    both = stats.withColumn("_k", F.lit(1)).join(F.broadcast(total), "_k")
    return both.withColumn("score", score_column(F.col("_total"))).drop("_k", "_total")


def _scored(choices: DataFrame, stats: DataFrame, kind: str, key: Column, out: str) -> DataFrame:
    """Adds the score of one kind of key to choices; unseen keys score with zeros."""
    own = stats.where(F.col("kind") == kind).drop("kind").withColumnRenamed("key", "_key")
    total = stats.agg(F.sum("attempts").cast("double").alias("_total")).withColumn("_one", F.lit(1))
    seen = choices.withColumn("_key", key).withColumn("_one", F.lit(1))
    both = seen.join(own, "_key", "left").join(F.broadcast(total), "_one", "left")
    return both.withColumn(out, score_column(F.coalesce("_total", F.lit(0.0)))).select(*choices.columns, out)


def branch_rank(stats: DataFrame, branches: DataFrame, modes: Sequence[str]) -> DataFrame:
    """Branches per mode by score of mode+branch, 0.4 branch, 0.2 mode; ties by name."""
    c = branches.select("branch", F.explode(F.array(*[F.lit(m) for m in modes])).alias("mode"))
    c = _scored(c, stats, "mode_branch", F.concat_ws("|", "mode", "branch"), "_a")
    c = _scored(c, stats, "branch", F.col("branch"), "_b")
    c = _scored(c, stats, "mode", F.col("mode"), "_c")
    score = F.col("_a") + BRANCH_WEIGHT * F.col("_b") + MODE_WEIGHT * F.col("_c")
    w = Window.partitionBy("mode").orderBy(F.desc("score"), "branch")
    return c.select("mode", "branch", score.alias("score")).withColumn("place", F.row_number().over(w))


def axis_rank(stats: DataFrame, axes: DataFrame) -> DataFrame:
    """Mutation axes by score of axis and 0.3 of mutation+axis; ties by name."""
    c = _scored(axes.select("axis"), stats, "axis", F.col("axis"), "_a")
    c = _scored(c, stats, "mode_axis", F.concat_ws("|", F.lit("mutation"), F.col("axis")), "_b")
    out = c.select("axis", (F.col("_a") + MODE_AXIS_WEIGHT * F.col("_b")).alias("score"))
    return numbered(out, [], [F.desc("score"), F.col("axis")], "place")


def parent_rank(stats: DataFrame, parents: DataFrame) -> DataFrame:
    """Parents (parent, ic) by score plus twice the clipped IC; ties by name."""
    c = _scored(parents.select("parent", "ic"), stats, "parent", F.col("parent"), "_a")
    gain = IC_GAIN * F.greatest(F.lit(0.0), F.least(F.coalesce(nz("ic"), F.lit(0.0)), F.lit(IC_CLIP)))
    out = c.select("parent", (F.col("_a") + gain).alias("score"))
    return numbered(out, [], [F.desc("score"), F.col("parent")], "place")


def failure_stats(reports: DataFrame) -> DataFrame:
    """Per error type: total count, rounds seen, and the newest name, cause, evidence and fix.

    `reports` has (round, error_type, count, cause, evidence, fix, seq).
    """
    order = F.struct("round", "seq")
    newest = lambda c: F.max_by(c, order)
    return reports.groupBy(F.lower("error_type").alias("key")).agg(
        newest("error_type").alias("error_type"),
        F.sum(F.greatest(F.lit(1), F.col("count"))).alias("count"),
        F.sort_array(F.collect_set("round")).alias("rounds"),
        F.max("round").alias("latest_round"),
        newest("cause").alias("latest_cause"),
        newest("evidence").alias("latest_evidence"),
        newest("fix").alias("latest_fix"),
    )


def failure_topn(stats: DataFrame, n: int) -> DataFrame:
    return stats.orderBy(F.desc("count"), F.desc("latest_round"), "error_type").limit(n)


def dominant_branch(ledger: DataFrame) -> DataFrame:
    """Branch with most failed or duplicate candidates per round; ties by name."""
    bad = ledger.where(F.col("label").isin("failed", "duplicate") & (F.coalesce(F.trim("branch"), F.lit("")) != ""))
    per = bad.groupBy("round", "branch").agg(F.count("*").alias("n"))
    w = Window.partitionBy("round").orderBy(F.desc("n"), "branch")
    return per.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def keep_recent(events: DataFrame, section: str, order: Sequence[str], n: int) -> DataFrame:
    """Last n events per section; Spark cuts each task's rows to n before the shuffle."""
    w = Window.partitionBy(section).orderBy(*[F.desc(c) for c in order])
    return events.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def round_best(ledger: DataFrame) -> DataFrame:
    """Best usable IC per round against the best of all earlier rounds."""
    per = ledger.groupBy("round").agg(F.max(F.when(F.col("ok"), nz("ic"))).alias("best_ic"))
    before = Window.orderBy("round").rowsBetween(Window.unboundedPreceding, -1)
    run = per.withColumn("previous_best_ic", F.max("best_ic").over(before))
    better = F.col("best_ic").isNotNull() & (
        F.col("previous_best_ic").isNull() | (F.col("best_ic") > F.col("previous_best_ic"))
    )
    return run.withColumns({"improved": better, "delta": F.col("best_ic") - F.col("previous_best_ic")})


def pattern_merge(patterns: DataFrame) -> DataFrame:
    """Same name: counts summed, newest non-empty text, highest confidence, number of different examples.

    `patterns` has (seq, name, count, text, confidence, example).  The examples
    themselves stay rows, see `pattern_examples`.
    """
    text = F.when(F.length("text") > 0, F.col("seq"))
    main = patterns.groupBy("name").agg(
        F.sum("count").alias("count"),
        F.max_by("text", text).alias("text"),
        F.max("confidence").alias("confidence"),
    )
    sizes = pattern_examples(patterns).groupBy("name").agg(F.count("*").alias("examples"))
    return main.join(sizes, "name", "left").fillna(0, ["examples"])


def pattern_examples(patterns: DataFrame) -> DataFrame:
    """Each different example of a name with its first position."""
    known = patterns.where("example IS NOT NULL")
    return known.groupBy("name", "example").agg(F.min("seq").alias("first_seq"))


def insight_merge(insights: DataFrame) -> DataFrame:
    """Unique on (phase, insight), the first kept; `seq` orders them."""
    return keep_first(insights, ["phase", "insight"], ["seq"])


def success_relevance(success: Column, count: Column, saturation: Column) -> Column:
    base = F.lit(1.0)
    for name, value in SUCCESS_BASE.items():
        base = F.when(success == name, value).otherwise(base)
    damp = F.when(saturation >= 0.7, 0.2).when(saturation >= 0.5, 0.6).otherwise(1.0)
    return base * F.when(count > 0, 1 + F.log1p(count.cast("double"))).otherwise(1.0) * damp


def forbidden_relevance(directions: DataFrame, rejections: DataFrame, recent: int, order: Sequence[str]) -> DataFrame:
    """(1 + correlation)(1 + log1p n), times 1.5 when a recent rejection's words occur in the text.

    `directions` has (name, text, correlation, count); words are those longer
    than four letters of the last `recent` reasons, and the error types, so the
    word list is bounded by `recent`.
    """
    last = rejections.orderBy(*[F.desc(c) for c in order]).limit(recent)
    words = F.filter(F.split(F.lower(F.coalesce("reason", F.lit(""))), r"\s+"), lambda w: F.length(w) > 4)
    types = F.filter(F.array(F.lower(F.coalesce("error_type", F.lit("")))), lambda w: F.length(w) > 0)
    hits = last.select(F.explode(F.concat(words, types)).alias("w")).agg(F.collect_set("w").alias("_words"))
    both = directions.withColumn("_k", F.lit(1)).join(F.broadcast(hits.withColumn("_k", F.lit(1))), "_k")
    hit = F.exists("_words", lambda w: F.contains(F.lower(F.col("text")), w))
    grow = F.when(F.col("count") > 0, 1 + F.log1p(F.col("count").cast("double"))).otherwise(1.0)
    score = (1 + F.coalesce("correlation", F.lit(0.0))) * grow * F.when(hit, 1.5).otherwise(1.0)
    return both.withColumn("score", score).drop("_k", "_words")


def pattern_topn(scored: DataFrame, n: int) -> DataFrame:
    return scored.orderBy(F.desc("score"), "name").limit(n)


def accepted_topn(ledger: DataFrame, n: int) -> DataFrame:
    """Accepted by IC descending, nulls last, with the total and a truncated flag."""
    ok = ledger.where("accepted")
    total = ok.agg(F.count("*").alias("total")).withColumn("_k", F.lit(1))
    top = ok.orderBy(F.col("ic").desc_nulls_last(), "candidate_index").limit(n).withColumn("_k", F.lit(1))
    return top.join(total, "_k").drop("_k").withColumn("truncated", F.col("total") > n)


def best_factor(ledger: DataFrame) -> DataFrame:
    """The accepted candidate with the highest IC; the first of equals."""
    best = F.struct("ic", (-F.col("candidate_index")).alias("i"))
    return ledger.where("accepted AND ic IS NOT NULL").agg(
        F.max_by("module", best).alias("module"), F.max("ic").alias("ic")
    )


def rel_improve(current: Column, best: Column, lower: bool = False, eps: float = 1e-8) -> Column:
    """(current - best) / max(|best|, eps), sign turned where lower is better."""
    gain = best - current if lower else current - best
    return gain / F.greatest(F.abs(best), F.lit(eps))


def flatten_metrics(df: DataFrame, key: str, nested: str) -> DataFrame:
    """map(string, map(string, double)) to rows (key, group, metric, value)."""
    outer = df.select(key, F.explode(nested).alias("group", "_inner"))
    return outer.select(key, "group", F.explode("_inner").alias("metric", "value"))


def seed_unique(existing: DataFrame, new: DataFrame) -> DataFrame:
    """New texts not yet present, case-insensitively, each once; both have (text), new also (seq)."""
    have = existing.select(F.lower(F.trim("text")).alias("_t")).distinct()
    fresh = new.withColumn("_t", F.lower(F.trim("text"))).where("_t != ''")
    first = fresh.groupBy("_t").agg(F.min_by("text", "seq").alias("text"), F.min("seq").alias("seq"))
    return first.join(have, "_t", "left_anti").select("seq", F.trim("text").alias("text"))


def merge_unique(values: DataFrame, key: str, array: str) -> DataFrame:
    """Ordered case-insensitive union of string lists: the first spelling of each value per key.

    `values` has (key, seq, array); one output row per kept value with its place.
    """
    rows = values.select(key, "seq", F.posexplode(array).alias("pos", "value"))
    rows = rows.where(F.trim("value") != "").withColumn("value", F.trim("value"))
    kept = rows.groupBy(key, F.lower("value").alias("_v")).agg(
        F.min_by("value", F.struct("seq", "pos")).alias("value"), F.min(F.struct("seq", "pos")).alias("at")
    )
    return kept.select(key, "value", F.col("at.seq").alias("seq"), F.col("at.pos").alias("pos"))


