"""Portfolio history and per-round return curves as files."""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numeric import nz

DOUBLES = (
    "composite_rank_ic",
    "round_best_rank_ic",
    "cumulative_return",
    "cumulative_return_after_cost",
    "cumulative_benchmark_return",
    "cumulative_excess_return_after_cost",
)
LONGS = ("round", "component_count", "score_rows")
CURVE_COLUMNS = ("strategy_return", "strategy_return_after_cost", "benchmark_return", "excess_return_after_cost")


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """Records of the new rounds replace old ones; sorted by round."""
    kept = old.join(new.select("round").distinct(), "round", "left_anti")
    return kept.unionByName(new, allowMissingColumns=True).orderBy("round")


def write_history(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(f"{path}/json")
    df.write.mode("overwrite").option("header", True).csv(f"{path}/csv")


def read_history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(f"{path}/json")


def clean_history(raw: DataFrame, summaries: DataFrame | None = None) -> DataFrame:
    """Numbers where they parse, no record without a round, missing best ICs from the round summaries."""
    cols = {c: F.col(c).cast("string").try_cast("bigint") for c in LONGS if c in raw.columns}
    cols |= {c: nz(F.col(c).cast("string").try_cast("double")) for c in DOUBLES if c in raw.columns}
    df = raw.withColumns(cols).where("round IS NOT NULL")
    if summaries is None:
        return df
    best = summaries.select("round", F.col("round_best_rank_ic").alias("_best"))
    filled = df.join(best, "round", "left")
    return filled.withColumn("round_best_rank_ic", F.coalesce("round_best_rank_ic", "_best")).drop("_best")


def accepted_count(names: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(names, F.lit("")), ","), lambda v: F.trim(v) != ""))


def deltas(df: DataFrame) -> DataFrame:
    """Round-over-round change of the composite IC and accepted factors; one row per round."""
    change = F.col("composite_rank_ic") - F.lag("composite_rank_ic").over(Window.orderBy("round"))
    return df.withColumns(
        {"composite_rank_ic_change": change, "accepted_factor_count": accepted_count(F.col("admitted_factors"))}
    )


#: Columns of the history row after the round, and where a nested summary has them. Fixed values.
RECORD = {
    "status": "portfolio.status", "component_count": "portfolio.component_count", "score_rows": "portfolio.score_rows",
    "composite_rank_ic": "portfolio.composite_rank_ic", "composite_rank_ic_name": "portfolio.composite_rank_ic_name",
    "round_best_rank_ic": "round_ic.best_ic", "round_best_module": "round_ic.best_module", "round_best_improved": "round_ic.improved",
    "composite_analysis_status": "portfolio.composite_analysis.status", "composite_analysis_json": "portfolio.composite_analysis_json",
    "admission_status": "admission.status", "admitted_factor": "admission.factor_name", "admitted_factors": "",
    "composite_factor_csv": "portfolio.composite_factor_csv", "weights_json": "portfolio.weights_json", "portfolio_json": "portfolio.portfolio_json",
    "cumulative_return": "portfolio.portfolio.cumulative_return", "cumulative_return_after_cost": "portfolio.portfolio.cumulative_return_after_cost",
    "cumulative_benchmark_return": "portfolio.portfolio.cumulative_benchmark_return",
    "cumulative_excess_return_after_cost": "portfolio.portfolio.cumulative_excess_return_after_cost",
    "latest_return_after_cost": "portfolio.portfolio.latest_return_after_cost", "topk": "portfolio.portfolio.topk", "n_drop": "portfolio.portfolio.n_drop",
    "prediction_rows": "portfolio.portfolio.prediction_rows", "prediction_start": "portfolio.portfolio.prediction_start",
    "prediction_end": "portfolio.portfolio.prediction_end", "error_type": "portfolio.error_type", "error": "portfolio.error",
}


def _has(schema, path: str) -> bool:
    for name in path.split("."):
        if name not in getattr(schema, "names", []):
            return False
        schema = schema[name].dataType
    return True


def round_record(summary: DataFrame) -> DataFrame:
    """Nested round summary (round, portfolio, admission, round_ic) to the flat history row; missing parts are NULL.

    Admitted are the names of the accepted candidates, or else the one factor of the admission.
    """
    at = lambda path: F.col(path) if _has(summary.schema, path) else F.lit(None)
    single = at("admission.factor_name").cast("string")
    names = F.lit(None).cast("string")
    if _has(summary.schema, "admission.accepted_candidates"):
        many = summary.schema["admission"].dataType["accepted_candidates"].dataType.elementType
        found = F.col("admission.accepted_candidates.factor_name" if hasattr(many, "names") else "admission.accepted_candidates")
        names = F.array_join(F.filter(found, lambda v: F.length(v) > 0), ",")
    admitted = F.coalesce(F.when(F.length(names) > 0, names), single, F.lit(""))
    return summary.select("round", *[(admitted if c == "admitted_factors" else at(path)).alias(c) for c, path in RECORD.items()])


def write_curves(df: DataFrame, path: str) -> None:
    """One folder per round; `df` has round, datetime and return columns."""
    text = df.withColumn("datetime", F.date_format("datetime", "yyyy-MM-dd HH:mm:ss"))
    text.write.mode("overwrite").option("header", True).partitionBy("round").csv(path)


def read_curves(spark: SparkSession, path: str) -> DataFrame:
    """All rounds' curves with the round taken from the path; rows without a date are dropped."""
    raw = spark.read.option("header", True).csv(path)
    cols = {c: F.col(c).cast("string").try_cast("double") for c in CURVE_COLUMNS if c in raw.columns}
    cols["round"] = F.regexp_extract(F.col("_metadata.file_path"), r"round=(\d+)", 1).cast("int")
    cols["datetime"] = F.col("datetime").cast("string").try_cast("timestamp_ntz")
    return raw.withColumns(cols).where("datetime IS NOT NULL")
