"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from factorlake.operators import composite as K
from factorlake.operators import corr, ic
from factorlake.operators import library_factors as lib
from factorlake.operators import panel as P
from factorlake.operators import research as R
from factorlake.plans import load
from factorlake.plans import views as V
from factorlake.session import drop_tables, materialize

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
STEPS = (1, 2, 3, 4, 6, 9, 12)


def factors():
    """Twenty factors of mixed lookbacks."""
    return (
        [lib.momentum(k) for k in STEPS]
        + [lib.mean_reversion(k) for k in STEPS]
        + [lib.volatility(6), lib.volatility(12), lib.liquidity(6), lib.liquidity(12)]
        + [lib.case_momentum_vol(), lib.liq_momentum()]
    )


NAMES = [f.name for f in factors()]


def frame(spark):
    return V.factor_frame(spark, SF, factors())


def dates(spark):
    return V.calendar(spark, SF).count()


def composite(spark):
    wide = materialize(frame(spark))
    n = dates(spark)
    names = V.codes(spark, SF).count()
    daily = ic.daily_ic(ic.labelled(wide, NAMES, 1, n), names=names)
    weights = K.components(daily.groupBy("factor").agg(F.avg("rank_ic").alias("ic")))
    scores = P.melt(wide, NAMES).where("score IS NOT NULL")
    comp = K.composite_score(K.composite_rank(scores, names), K.with_order(weights))
    return K.composite_ic(comp, dates=n, names=names)


def single(spark):
    panel = V.factor_frame(spark, SF, [lib.momentum(3, "x")], unit="week").select(*P.KEYS, "close", "x")
    return R.rank_ic_single(materialize(panel), "x", 1, 60, V.calendar(spark, SF, "week").count())


def registered(name):
    return lambda spark: load().QUERIES[name](spark, SF)


HEADLINE = {
    "bars_monthly": lambda spark: V.bars(spark, SF),
    "factor_frame_20": frame,
    "factor_analyze_20": lambda spark: ic.factor_analyze(frame(spark), NAMES, dates=dates(spark), names=V.codes(spark, SF).count()),
    "pair_spearman_20x20": lambda spark: corr.spearman_matrix(frame(spark), NAMES),
    "composite_20": composite,
    "rank_ic_single_60": single,
    **{n: registered(n) for n in ("ic_summary", "bars_resample", "lake_compact", "trade_report", "minute_grid_ffill", "stream_bars")},
}


def main():
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="factorlake-bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    wanted = sys.argv[1:] or list(HEADLINE)
    spark.read.parquet(f"{SF}/lineitem.parquet").groupBy("l_suppkey").count().write.format("noop").mode("overwrite").save()
    times = {}
    for name in wanted:
        start = time.perf_counter()
        HEADLINE[name](spark).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        drop_tables(spark)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": SF}))
    spark.stop()


if __name__ == "__main__":
    main()
