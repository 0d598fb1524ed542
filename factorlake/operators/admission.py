"""Order-dependent admission of candidates into the factor library.

Metrics, reviews and rank correlations of all candidates come from three Spark
plans up front.  Only the walk itself is sequential, because each candidate is
judged against the library its predecessors left: the driver holds one small
row per factor. The library itself is a stored table of sums per cell; a candidate
that reaches the gate adds its share and takes away those of what it replaces, so
a step reads the rows of the changed factors and the sums, whatever the library's size.
"""

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from . import composite as C
from . import corr, decide, ic
from .panel import KEYS, melt

# Fixed value: the reason in an archive event.
REPLACED = "replaced_by_higher_ic_correlated_factor"
TYPES = {"ic": "double", "horizon": "int", "factor_shift": "int", "tags": "array<string>"}
SCHEMA = """attempt int, factor string, ic double, status string, reason string, failed_checks array<string>,
 replaced array<string>, blocking array<string>, baseline_rank_ic double, with_candidate_rank_ic double"""


def reviewed(
    frame: DataFrame, factors: Sequence[str], horizon: int = 1, dates: int | None = None, names: int | None = None
) -> DataFrame:
    """One metric row per factor with its review verdict."""
    record = ic.factor_analyze(frame, factors, horizon, dates, names)
    flat = record.select(
        "factor",
        F.lit(True).alias("runs_ok"),
        "coverage",
        "missing_rate",
        F.col("daily_rank_ic_mean").alias("ic"),
        F.col("rank_icir").alias("icir"),
        F.col("daily_rank_ic_count").alias("ic_count"),
        F.size("deciles").alias("layers"),
    )
    return decide.review(flat, F.col("layers"))


def admit_candidates(
    frame: DataFrame,
    candidates: Sequence[str],
    accepted: Sequence[str] = (),
    min_delta: float = 0.0,
    horizon: int = 1,
    dates: int | None = None,
    store=None,
    record: dict | None = None,
) -> DataFrame:
    """Walk candidates by IC: screen, review, correlation, gate; save and archive as it goes.

    `accepted` names factor columns already in the library; `record` holds further fields of the
    stored records (universe, factor_shift, tags, signal_class, source).  One row per attempt.
    """
    spark = frame.sparkSession
    names = [*accepted, *[c for c in candidates if c not in accepted]]
    frame = materialize(frame.select(*KEYS, "close", *names))
    most = ic.largest(frame, ["trade_time"])
    ranked = C.stored_ranks(melt(frame, names), most)
    records = {r["factor"]: r for r in reviewed(frame, names, horizon, dates, most).collect()}
    near: dict = {}
    for r in corr.close_pairs(frame, names, corr.LIBRARY_DUPLICATE, stored=True).pairs.collect():
        near.setdefault(r["left"], {})[r["right"]] = r["spearman"]
        near.setdefault(r["right"], {})[r["left"]] = r["spearman"]
    value = lambda n: records[n]["ic"]
    library = [n for n in accepted]
    weight = lambda n: float(value(n) or 0.0)
    members = lambda: [m for m in library if weight(m) > decide.FAST_SCREEN]
    table = spark.createDataFrame([(m, weight(m)) for m in members()], "factor string, weight double")
    sums = materialize(C.composite_sums(ranked, table))
    library_ic = C.composite_ic(C.composite_of(sums), (), horizon, dates, most).first()["rank_ic"]
    walk = sorted(candidates, key=lambda n: (value(n) is None, -(value(n) or 0.0), n))
    rows = []
    for attempt, name in enumerate(walk, 1):
        own = records[name]
        close = sorted(near.get(name, {}).keys() & set(library))
        better = value(name) is not None
        replaced = [m for m in close if better and (value(m) is None or value(name) > value(m))]
        blocking = [m for m in close if m not in replaced]
        # fixed values: states and reasons
        gate, status, reason = None, "rejected", "deterministic_review_or_library_correlation_failed"
        if value(name) is None or value(name) <= decide.FAST_SCREEN:
            reason = "rank_ic_fast_screen_failed"
        elif own["verdict"] == "accepted" and not blocking:
            # what it replaces goes, and its own old row
            gone = [m for m in members() if m in replaced or m == name]
            change = [(name, weight(name), 1), *[(m, weight(m), -1) for m in gone]]
            after, gate = C.judged_change(sums, library_ic, len(members()), ranked, change, min_delta, horizon, dates, most)
            status, reason = ("accepted", "") if gate["passed"] else ("rejected", "marginal_contribution_gate_failed")
        if status == "accepted":
            library = [m for m in library if m not in replaced and m != name] + [name]
            sums, library_ic = after, gate["with_candidate_rank_ic"]
            if store is not None:
                archived = {m: {"replaced_factor_ic": value(m), "spearman": near[name][m]} for m in replaced}
                _record(spark, store, own, gate, archived, {"horizon": horizon} | (record or {}))
        rows.append(
            (
                attempt,
                name,
                value(name),
                status,
                reason,
                own["failed_checks"],
                replaced if status == "accepted" else [],
                blocking,
                gate and gate["baseline_rank_ic"],
                gate and gate["with_candidate_rank_ic"],
            )
        )
    return spark.createDataFrame(rows, SCHEMA)


def _record(spark, store, own, gate, archived: dict, fields: dict) -> None:
    """The accepted factor with its metrics and review, and an archive event for each factor that it replaces."""
    metrics = {k: v for k, v in own.asDict(recursive=True).items() if k not in ("factor", "verdict", "failed_checks")}
    review = {"verdict": own["verdict"], "failed_checks": own["failed_checks"], "marginal_gate": gate}
    row = {"name": own["factor"], "ic": own["ic"], "status": "accepted", "metrics": json.dumps(metrics), **fields}
    schema = ", ".join(f"{k} {TYPES.get(k, 'string')}" for k in row)
    store.save(spark.createDataFrame([tuple(row.values())], schema), overwrite=True)
    store.add_review(spark.createDataFrame([(own["factor"], json.dumps(review))], "name string, review string"))
    if archived:
        event = {"archived_by": own["factor"], "reason": REPLACED, "replacement_ic": own["ic"], "threshold": corr.LIBRARY_DUPLICATE}
        note = [(m, json.dumps(event | more)) for m, more in archived.items()]
        store.archive(spark.createDataFrame(note, "name string, review string"))
