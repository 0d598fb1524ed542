"""Stopping rules that need a fold over the rounds of a run.

The bests of a run move only at rows that beat everything before them.  Block
scans find those rows first; only they pass through the ordered fold, which
streams over sorted partitions and holds one state, never a whole run.
Counters are distances to the last reset, again by block scans.
"""

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scan import cut, scan

MIN_GAIN = 0.05
EPS = 1e-8


def stream_fold(df: DataFrame, part: str, order: str, step: Callable, columns: Sequence[str], out: str) -> DataFrame:
    """Run `step(state, row values) -> (state, value)` over each group in order.

    Yields (part, order, out); the state starts as None for every group.
    """
    types = dict(df.dtypes)
    schema = f"`{part}` {types[part]}, `{order}` {types[order]}, `{out}` boolean"
    rows = df.select(part, order, *columns).repartition(part).sortWithinPartitions(part, order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, state = None, None
        for pdf in batches:
            flags = []
            for key, values in zip(pdf[part], pdf[list(columns)].itertuples(index=False)):
                if key != group:
                    group, state = key, None
                state, flag = step(state, values)
                flags.append(flag)
            yield pd.DataFrame({part: pdf[part], order: pdf[order], out: flags})

    return rows.mapInPandas(run, schema)


def _gain(current: float, best: float) -> float:
    return (current - best) / max(abs(best), EPS)


def _threshold_step(min_gain: float):
    def step(best, values):
        x = values[0]
        if best is None or _gain(x, best) >= min_gain:
            return x, True
        return best, False

    return step


def plateau_strategy(
    rounds: DataFrame, min_gain: float = MIN_GAIN, plateau_rounds: int = 3, success_rounds: int = 2
) -> DataFrame:
    """Best of three metrics, plateau and success counters and the decision, per run and round.

    `rounds` has (run, pos from 1, excess_return, information_ratio,
    risk_to_reward, hypothesis_true); the third metric is better when lower.
    """
    names = ["excess_return", "information_ratio", "risk_to_reward"]
    long = rounds.select(
        "run", "pos", F.explode(F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(
            F.col(names[0]), F.col(names[1]), -F.col(names[2])))).alias("metric", "x")
    )
    series = long.withColumn("series", F.concat_ws("|", "run", "metric"))
    run = scan(cut(series, ["series"], ["pos"]), ["series"], ["pos"], maxes={"top": "x"})
    # a row can only become the best if nothing before it was as high
    before = run.groupBy("series", "top").agg(F.min("pos").alias("pos")).select("series", "pos")
    records = series.join(before, ["series", "pos"], "left_semi")
    flags = stream_fold(records, "series", "pos", _threshold_step(min_gain), ["x"], "good")
    marked = series.join(flags, ["series", "pos"], "left").withColumn("good", F.coalesce("good", F.lit(False)))
    marked = marked.withColumn("held", F.when(F.col("good"), F.col("x")))
    best = scan(cut(marked, ["series"], ["pos"]), ["series"], ["pos"], maxes={"best": "held"})
    wide = best.groupBy("run", "pos").agg(
        *[F.max(F.when(F.col("metric") == n, F.col("best"))).alias(f"best_{n}") for n in names],
        F.max("good").alias("any_good"),
    )
    wide = wide.withColumn("best_risk_to_reward", -F.col("best_risk_to_reward"))
    both = rounds.select("run", "pos", "hypothesis_true").join(wide, ["run", "pos"])
    return _counters(both, F.col("any_good"), ~(F.col("hypothesis_true") & ~F.col("any_good"))).withColumns(
        _decision(
            [
                ("plateau_count", plateau_rounds, f"strategy_plateau_{plateau_rounds}_rounds"),
                ("success_plateau_count", success_rounds, "hypothesis_true_and_strategy_plateau"),
            ],
            "still_improving_or_not_yet_plateau",
        )
    )


def _counters(df: DataFrame, reset_plateau, reset_success) -> DataFrame:
    """Rows since the last reset; the first row of a run is one."""
    first = F.col("pos") == 1
    marked = df.withColumns(
        {
            "_a": F.when(first | reset_plateau, F.col("pos")),
            "_b": F.when(first | reset_success, F.col("pos")),
        }
    )
    run = scan(cut(marked, ["run"], ["pos"]), ["run"], ["pos"], maxes={"_la": "_a", "_lb": "_b"})
    return run.select(
        *df.columns,
        (F.col("pos") - F.col("_la")).alias("plateau_count"),
        (F.col("pos") - F.col("_lb")).alias("success_plateau_count"),
    )


def _decision(rules, default: str) -> dict:
    reason = F.when(F.col("pos") == 1, "first_round")
    end = F.lit(False)
    for col, limit, text in rules:
        hit = (F.col("pos") > 1) & (F.col(col) >= limit)
        reason, end = reason.when(hit, text), end | hit
    return {
        "decision": F.when(end, "end").otherwise("continue"),
        "reason": reason.otherwise(default),
    }


def _signal_step(min_gain: float):
    def step(state, values):
        moved, x, y = values
        if state is None:
            return (x, y), True
        a, b = state
        new = bool(moved) or _gain(x, a) >= min_gain or _gain(y, b) >= min_gain
        if new:
            return (max(a, x), max(b, y)), True
        return state, False

    return step


def signal_rounds(signals: DataFrame, min_ic_1h: float, min_ic_5h: float) -> DataFrame:
    """Per (run, pos) averages and counts of the signals tested in that round.

    `signals` has (run, pos, hypothesis_true, profitable, rank_ic_1h, rank_ic_5h).
    """
    per = signals.groupBy("run", "pos").agg(
        F.sum(F.col("hypothesis_true").cast("bigint")).alias("hypothesis_passed"),
        F.sum(F.col("profitable").cast("bigint")).alias("profitable_count"),
        F.avg(F.coalesce("rank_ic_1h", F.lit(0.0))).alias("avg_rank_ic_1h"),
        F.avg(F.coalesce("rank_ic_5h", F.lit(0.0))).alias("avg_rank_ic_5h"),
        F.min(F.col("hypothesis_true") & F.col("profitable")).alias("_all"),
    )
    ok = F.col("_all") & (F.col("avg_rank_ic_1h") >= min_ic_1h) & (F.col("avg_rank_ic_5h") >= min_ic_5h)
    return per.withColumn("passed", ok).drop("_all")


def plateau_signal(rounds: DataFrame, min_gain: float = MIN_GAIN, plateau_rounds: int = 3) -> DataFrame:
    """New-best flag, plateau and success counters and the decision, from `signal_rounds`."""
    maxes = {
        "_h": "hypothesis_passed",
        "_p": "profitable_count",
        "_x": "avg_rank_ic_1h",
        "_y": "avg_rank_ic_5h",
    }
    run = scan(cut(rounds, ["run"], ["pos"]), ["run"], ["pos"], maxes=maxes)

    def firsts(col):
        return run.groupBy("run", col).agg(F.min("pos").alias("pos")).select("run", "pos")

    # rows where a count reaches a new high move the bests; rows where an IC does might
    counts = firsts("_h").unionByName(firsts("_p")).distinct().withColumn("moved", F.lit(True))
    maybe = firsts("_x").unionByName(firsts("_y")).distinct().withColumn("maybe", F.lit(True))
    rows = rounds.join(counts, ["run", "pos"], "left").join(maybe, ["run", "pos"], "left")
    asked = rows.where("moved OR maybe").withColumn("moved", F.coalesce("moved", F.lit(False)))
    flags = stream_fold(
        asked, "run", "pos", _signal_step(min_gain), ["moved", "avg_rank_ic_1h", "avg_rank_ic_5h"], "is_new_best"
    )
    marked = rounds.join(flags, ["run", "pos"], "left").withColumn(
        "is_new_best", F.coalesce("is_new_best", F.lit(False))
    )
    out = _counters(marked, F.col("is_new_best"), ~F.col("passed"))
    # the first round sets no success count even when it passes
    done = (F.col("pos") > 1) & F.col("passed")
    flat = (F.col("pos") > 1) & (F.col("plateau_count") >= plateau_rounds)
    reason = (
        F.when(F.col("pos") == 1, "first_round")
        .when(done, "all_hypothesis_true_profitable_and_ic_passed")
        .when(flat, f"hybrid_plateau_{plateau_rounds}_rounds")
        .otherwise("refine_hypothesis_profitability_or_ic")
    )
    return out.withColumns({"decision": F.when(done | flat, "end").otherwise("continue"), "reason": reason})
