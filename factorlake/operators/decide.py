"""Rules over metric records: which IC counts, screens, reviews, labels, reasons."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import nz

FAST_SCREEN = 0.01
# Metric paths in order of preference.
IC_METRICS = (
    "daily_rank_ic_mean",
    "rank_ic_distribution.mean",
    "rank_ic",
    "daily_ic_mean",
    "ic_distribution.mean",
)
# Error types that say the factor is weak, not that the run broke.
WEAK_ERRORS = (
    "MissingIC",
    "NonPositiveIC",
    "NegativeRankICRequiresReverse",
    "LowRankIC",
    "MockRejectedSignal",
)
MIN_COVERAGE = 0.8
MAX_MISSING = 0.2


def choose_metric(values: dict[str, Column]) -> tuple[Column, Column]:
    """First finite metric in order of preference, and its name."""
    clean = {m: nz(values[m]) for m in IC_METRICS if m in values}
    ic = F.coalesce(*clean.values())
    name = F.coalesce(*[F.when(v.isNotNull(), F.lit(m)) for m, v in clean.items()], F.lit(""))
    return ic, name


def json_metric(doc: str, path: str) -> Column:
    """Nested metric of a JSON text, NULL unless it is a finite number."""
    return nz(F.get_json_object(doc, f"$.{path}").try_cast("double"))


def passes_screen(ic: Column, threshold: float = FAST_SCREEN) -> Column:
    return F.coalesce(nz(ic) > threshold, F.lit(False))


def ic_status(ic: Column) -> Column:
    ic = nz(ic)
    return (
        F.when(ic.isNull(), "MissingIC")
        .when(ic < 0, "NegativeRankICRequiresReverse")
        .when(ic == 0, "NonPositiveIC")
        .when(ic <= FAST_SCREEN, "LowRankIC")
        .otherwise("ok")
    )


def review(df: DataFrame, layers: Column) -> DataFrame:
    """Seven checks on a metric record; all must hold.

    Uses columns runs_ok, coverage, missing_rate, ic, icir, ic_count; `layers`
    is the number of decile layers present.  Adds failed_checks and verdict.
    """
    # fixed values: names of the checks and verdicts
    checks = {
        "runs_without_error": F.col("runs_ok"),
        "coverage_ok": nz("coverage") >= MIN_COVERAGE,
        "missing_rate_ok": nz("missing_rate") <= MAX_MISSING,
        "rank_ic_ok": nz("ic") > 0,
        "icir_ok": nz("icir") > 0,
        "sample_count_ok": F.col("ic_count") > 0,
        "decile_layer_ok": layers > 0,
    }
    held = {k: F.coalesce(v, F.lit(False)) for k, v in checks.items()}
    failed = F.array_compact(F.array(*[F.when(~v, F.lit(k)) for k, v in held.items()]))
    return df.withColumns(held).withColumns(
        {
            "failed_checks": failed,
            "verdict": F.when(F.size(failed) == 0, "accepted").otherwise("rejected"),
        }
    )


def label_candidates(ledger: DataFrame) -> DataFrame:
    """failed / best / average per round; the first of equal ICs is best.

    The best of a round is an aggregate joined back, so a large round is not
    sorted in one task.
    """
    usable = F.col("ok") & passes_screen(F.col("ic"))
    best = (
        ledger.where(usable)
        .groupBy("round")
        .agg(F.max_by("candidate_index", F.struct("ic", -F.col("candidate_index"))).alias("_best"))
    )
    label = (
        F.when(~usable, "failed").when(F.col("candidate_index") == F.col("_best"), "best").otherwise("average")
    )
    return ledger.join(best, "round", "left").withColumn("label", label).drop("_best")


def failure_reason(label: Column, error_type: Column, error: Column, ic: Column, ok: Column) -> Column:
    has = lambda c: F.coalesce(F.length(c) > 0, F.lit(False))
    weak = ~passes_screen(ic)
    # fixed values: labels and reasons
    return (
        F.when(label == "best", "none")
        .when(label == "duplicate", "duplicate")
        .when(label == "average", "factor_not_good")
        .when((label == "failed") & F.coalesce(error_type.isin(*WEAK_ERRORS), F.lit(False)), "factor_not_good")
        .when((label == "failed") & (has(error_type) | has(error)), "error")
        .when((label == "failed") & weak, "factor_not_good")
        .when(label == "failed", "unknown_failure")
        .when(ok, "none")
        .otherwise("unknown_failure")
    )


def failure_detail(
    label: Column, error_type: Column, error: Column, ic: Column, dedup_of: Column, dedup_corr: Column
) -> Column:
    text = F.regexp_replace(
        F.concat(F.coalesce(error_type, F.lit("")), F.lit(": "), F.coalesce(error, F.lit(""))), "^[: ]+|[: ]+$", ""
    )
    dup = F.concat(
        F.lit("duplicate of "),
        F.coalesce(dedup_of, F.lit("<unknown>")),
        F.coalesce(F.concat(F.lit("; correlation="), F.format_string("%.6f", dedup_corr)), F.lit("")),
    )
    return (
        F.when(label == "best", "round best candidate")
        .when(label == "average", "valid factor, but weaker than the round best")
        .when(label == "duplicate", dup)
        .when(F.length(text) > 0, text)
        .when(nz(ic).isNull(), "no finite rank IC")
        .when(nz(ic) <= FAST_SCREEN, "rank IC <= 0.01")
        .otherwise("not applicable")
    )
