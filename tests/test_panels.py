"""Stored panels: plans without exchange and sort, and the results of the unstored path."""

import datetime as dt
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from factorlake.functions import ts
from factorlake.operators import library_factors as lib
from factorlake.operators import panel as P
from factorlake.sources import panels as B


@pytest.fixture(scope="module")
def bars(spark):
    rng = np.random.default_rng(2)
    days = pd.date_range("2024-01-01", periods=120)
    rows = [(d, c) for c in ("a", "b", "c", "long") for d in days if c == "long" or rng.random() < 0.7]
    pdf = pd.DataFrame(rows, columns=["trade_time", "code"])
    for f in P.FIELDS:
        pdf[f] = np.round(rng.uniform(1, 9, len(pdf)), 3)
    return spark.createDataFrame(pdf)


@pytest.fixture(scope="module")
def panel(spark, bars):
    return B.store(P.densify(bars, lookback=21, segment=40), 21, buckets=4)


def moves(df):
    """Names of the operators of a plan that move or sort rows."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"\b(?:\w*Exchange|Sort)\b", plan)


def test_two_queries_on_one_stored_panel_move_and_sort_nothing(spark, panel):
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = {k: spark.conf.get(k) for k in (threshold, *B.AS_STORED)}
    spark.conf.set(threshold, "-1")
    with B.as_stored(spark):
        factors = B.compute(spark, panel, [lib.momentum(5), lib.volatility(10)], shift=1)
        assert moves(factors) == []
        values = B.store(factors.select(*B.CELL, "mom_5"), placed=panel)
        joined = B.attach(B.read(spark, panel), B.read(spark, values), ["mom_5"])
        again = joined.withColumn("s", ts.ts_mean("mom_5", 3, 1))
        assert moves(again) == []
        assert "SortMergeJoin" in again._jdf.queryExecution().executedPlan().toString()
        one = {(r.code, r.seg, r.t): r.mom_5 for r in factors.collect()}
        assert {(r.code, r.seg, r.t): r.mom_5 for r in joined.collect()} == one
    spark.conf.set(threshold, before[threshold])
    assert {k: spark.conf.get(k) for k in before} == before


def test_factors_equal_the_unstored_path(spark, bars, panel):
    factors = [lib.momentum(5), lib.volatility(10), lib.case_momentum_vol()]
    got = B.compute(spark, panel, factors[:2]).where("observed AND NOT halo").toPandas().set_index(["code", "trade_time"]).sort_index()
    want = P.compute_factors(bars, factors[:2]).toPandas().set_index(["code", "trade_time"]).sort_index()
    assert len(got) == bars.count()
    for f in ("mom_5", "vol_10"):
        np.testing.assert_allclose(got[f], want[f], rtol=1e-12)
    with pytest.raises(ValueError, match="leading rows"):
        B.compute(spark, panel, factors, shift=1)


def test_table_is_found_by_a_session_that_lost_it(spark, panel):
    before = sorted(map(tuple, B.read(spark, panel).select(*B.CELL, "close").fillna(-1).collect()))
    spark.sql(f"DROP TABLE {panel.name}")
    with B.as_stored(spark):
        again = B.read(spark, panel)
        assert sorted(map(tuple, again.select(*B.CELL, "close").fillna(-1).collect())) == before
        assert moves(again.withColumn("m", ts.ts_mean("close", 3, 1))) == []


def test_empty_panel_and_missing_columns(spark):
    none = spark.createDataFrame([], "trade_time timestamp_ntz, code string, open double, high double, low double, close double, volume double, amount double")
    table = B.store(P.densify(none), buckets=2)
    assert B.read(spark, table).withColumn("m", ts.ts_mean("close", 3, 1)).count() == 0
    with pytest.raises(ValueError, match="missing"):
        B.store(none)


def test_a_null_code_is_a_series(spark):
    rows = [(dt.datetime(2024, 1, i), c, 0, i, float(i)) for i in (1, 2, 3) for c in (None, "a")]
    cells = spark.createDataFrame(rows, "trade_time timestamp_ntz, code string, seg int, t int, x double")
    got = B.read(spark, B.store(cells, buckets=2)).withColumn("s", ts.ts_sum("x", 2, 1))
    assert {(r.code, r.t): r.s for r in got.collect()} == {(c, i): s for c in (None, "a") for i, s in ((1, 1.0), (2, 3.0), (3, 5.0))}
