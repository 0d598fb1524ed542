"""Steps that several panel queries share: what is computed once, and how large a task's share is."""

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from factorlake import session
from factorlake.functions import ranks
from factorlake.operators import corr, ic, panel, slots
from factorlake.operators.panel import KEYS
from factorlake.plans import library as L


@pytest.fixture(scope="module")
def wide(spark):
    rows = []
    for t in range(6):
        for c in range(25):
            x = (c * 7 + t * 3) % 25
            a = None if c % 6 == 5 else float("nan") if c == 3 else float(x // 2)
            rows.append((dt.datetime(2024, 1, 1 + t), f"c{c}", a, 1.0 if t == 2 else float(x), None if c == 9 else float((x * x + c) % 11)))
    return spark.createDataFrame(rows, "trade_time timestamp_ntz, code string, a double, b double, label double")


def test_daily_ics_by_date_equal_windows(wide, monkeypatch):
    by_date = {(r.factor, r.trade_time): r for r in ic.daily_ic_wide(wide, ["a", "b"], 25).collect()}
    monkeypatch.setattr(ic, "CELLS", 0)
    windows = {(r.factor, r.trade_time): r for r in ic.daily_ic_wide(wide, ["a", "b"], 25).collect()}
    assert by_date.keys() == windows.keys() and len(by_date) == 12
    for k, r in windows.items():
        for c in ("ic", "rank_ic", "names"):
            assert by_date[k][c] == (None if r[c] is None else pytest.approx(r[c], abs=1e-9))


def test_prediction_ic_reads_its_tables_once(spark):
    rows = spark.range(60, numPartitions=1).select((F.lit(dt.datetime(2024, 1, 1)) + F.make_dt_interval((F.col("id") % 3).cast("int"))).cast("timestamp_ntz").alias("trade_time"), F.col("id").cast("string").alias("code"), F.col("id").cast("double").alias("x"))
    got = ic.prediction_ic(rows.select(*KEYS, F.col("x").alias("label")), rows.select(*KEYS, (F.col("x") * 2).alias("score")), 20)
    assert "Range (" not in got._jdf.queryExecution().executedPlan().toString()
    row = got.first()
    assert (row.test_label_rows, row.joined_rows, row.daily_ic_count) == (60, 60, 3) and row.rank_ic == pytest.approx(1)


def test_rank_blocks_are_bounded(spark, wide, monkeypatch):
    monkeypatch.setattr(corr, "NUMBERS_PER_BLOCK", 10)
    cuts, cut = [], corr.ordered_blocks
    monkeypatch.setattr(corr, "ordered_blocks", lambda df, order, blocks=None: cuts.append(blocks) or cut(df, order, blocks))
    got = corr.spearman_matrix(wide, ["a", "b", "label"]).collect()
    values = wide.toPandas()
    for r in got:
        both = values[[r.left, r.right]].dropna()
        assert r.n == len(both) and r.spearman == pytest.approx(both[r.left].rank().corr(both[r.right].rank()))
    known = int(values[["a", "b", "label"]].notna().sum().sum())
    assert len(got) == 3 and cuts[0] >= known / 10


def test_only_factors_with_weights_are_ranked(spark):
    scores = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("b", 3.0), ("c", 4.0)], "factor string, score double")
    weights = spark.createDataFrame([("b", 0.5, 1), ("b", 0.5, 2), ("d", 1.0, 3)], "factor string, weight double, ord int")
    assert sorted(r.score for r in L._of(weights, scores).collect()) == [2.0, 3.0]


def test_cells_of_a_task_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(panel, "CELLS_PER_TASK", 20)
    rows = [(dt.datetime(2024, 1, 1 + t), f"c{c}", float(t * c)) for t in range(10) for c in range(30) if (t + c) % 3]
    bars = spark.createDataFrame(rows, "trade_time timestamp_ntz, code string, close double")
    dense = panel.densify(bars, fields=["close"])
    assert dense.count() == 300 and "hashpartitioning(code" in (plan := dense._jdf.queryExecution().toString()) and ", 15)" in plan


def test_ewm_of_one_segment_computes_its_frame_once(spark):
    rows = [(dt.datetime(2024, 1, 1 + t), c, float(t * t)) for t in range(9) for c in ("a", "b") if c == "a" or t in (1, 4)]
    bars = spark.createDataFrame(rows, "trade_time timestamp_ntz, code string, close double")
    dense = panel.densify(bars, fields=["close"], lookback=10)
    one, two = panel.ewm(dense, "close", "e", 0.3, dates=9), panel.ewm(dense, "close", "e", 0.3)
    key = lambda df: sorted((r.code, r.t, r.e) for r in df.collect() if r.e is not None)
    assert key(one) == key(two) and len(key(one)) == 17
    assert one._jdf.queryExecution().toString().count("Union") < two._jdf.queryExecution().toString().count("Union")


def test_many_series_share_a_batch(spark):
    rows = [(dt.datetime(2024, 1, 1 + t), f"c{c}" if c else None, float((t * 7 + c) % 5)) for t in range(10) for c in range(12) if (t * c) % 4 != 1]
    bars = spark.createDataFrame(rows, "trade_time timestamp_ntz, code string, close double")
    bars = bars.withColumns({c: F.col("close") for c in panel.FIELDS})
    seen = lambda pdf: pdf["close"].fillna(0).rolling(3, min_periods=1).sum() + 100 * len(pdf)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for c in range(12):
        close = {t: x for t, (_, code, x) in ((r[0].day - 1, r) for r in rows) if code == (f"c{c}" if c else None)}
        for t in close:
            # segments of four dates with two leading rows
            length = (4, 6, 4)[t // 4]
            want[f"c{c}" if c else None, t] = sum(close.get(i, 0.0) for i in range(max(t - 2, 0), t + 1)) + 100 * length
    try:
        for size in ("1", "5", "1000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            df = slots.ts_udf(bars, seen, "v", 2, segment=4)
            assert {(r.code, r.trade_time.day - 1): r.v for r in df.collect()} == want
            assert "FlatMapGroupsInPandas" not in df._jdf.queryExecution().toString()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_ranked_rows_are_not_shuffled_for_their_offsets(spark):
    df = spark.range(200).select((F.col("id") % 2).alias("g"), (F.col("id") % 7).cast("double").alias("x"), "id")
    ranked = ranks.pooled_ranks(df, ["g"], "x", "r")
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "LeftOuter" in plan
    want = df.toPandas().assign(r=lambda p: p.groupby("g")["x"].rank()).set_index("id")["r"].to_dict()
    assert {r.id: r.r for r in ranked.collect()} == want


def test_rows_of_equal_or_null_keys_are_cells_of_their_own(spark):
    rows = [(None if i % 3 == 0 else dt.datetime(2024, 1, 1), None if i % 4 == 0 else "c", float(i), float(i * i % 11)) for i in range(40)]
    frame = spark.createDataFrame(rows, "trade_time timestamp_ntz, code string, a double, b double")
    got = corr.spearman_matrix(frame, ["a", "b"]).first()
    values = frame.toPandas()
    assert got.n == 40 and got.spearman == pytest.approx(values["a"].rank().corr(values["b"].rank()))


def layered_rows(spark, names):
    """Dates of one up to `names` names; ties, constant sides, missing numbers and a name without a code."""
    rows = []
    for f in ("a", "b", "flat"):
        for t, n in enumerate((1, 9, 10, 11, names)):
            for c in range(n):
                x = 1.0 if f == "flat" else float((c * 37 + t) % 101 // 3) - 9.0
                x = None if c % 17 == 5 else -0.0 if c % 13 == 4 else float("nan") if f == "b" and c % 29 == 8 else x
                y = None if f == "a" and c % 11 == 3 else float((c * c + t) % 23)
                rows.append((f, dt.datetime(2024, 1, 1 + t), None if c == 7 else f"c{c}", x, y))
    return spark.createDataFrame(rows, "factor string, trade_time timestamp_ntz, code string, score double, label double")


@pytest.mark.parametrize("piece", [1, 7, 64, 1000])
def test_layers_in_pieces_equal_windows(spark, monkeypatch, piece):
    long = layered_rows(spark, 400)
    windows = {(r.factor, r.layer_name): r for r in ic.layered_ic(long, names=400).collect()}
    monkeypatch.setattr(ic, "NAMES", 3)
    monkeypatch.setattr(ic, "PIECE", piece)
    pieces = {(r.factor, r.layer_name): r for r in ic.layered_ic(long, names=400).collect()}
    assert pieces.keys() == windows.keys() and len(pieces) == 30
    assert sum(r["rows"] for r in windows.values()) > 1100
    for k, r in windows.items():
        for c in r.asDict():
            if c not in ("factor", "layer_name"):
                assert pieces[k][c] == (None if r[c] is None else pytest.approx(r[c], abs=1e-9, nan_ok=True)), (k, c)


def test_layers_in_pieces_store_their_rows_once(spark, monkeypatch):
    rows = spark.range(4000, numPartitions=2).select(
        F.concat(F.lit("f"), F.col("id") % 2).alias("factor"), F.lit(dt.datetime(2024, 1, 1)).cast("timestamp_ntz").alias("trade_time"),
        F.col("id").cast("string").alias("code"), (F.col("id") * 7 % 4001).cast("double").alias("score"), (F.col("id") * 11 % 997).cast("double").alias("label"))
    stored, keep = [], session.materialize

    def spy(df):
        table = keep(df)
        stored.append((dict(table.dtypes), table.count()))
        return table

    for module in (session, ic, ranks):
        monkeypatch.setattr(module, "materialize", spy)
    monkeypatch.setattr(ic, "NAMES", 3)
    got = ic.layered_ic(rows, names=2000)
    assert "Range (" not in got._jdf.queryExecution().executedPlan().toString()
    assert sum(r["rows"] for r in got.collect()) == 4000
    # once as they come; again only those of layers that reach over the borders of eight blocks, for themselves and two block ranks
    assert sum(n for types, n in stored if types.get("score") == "double") < 2.5 * 4000


def test_a_table_stored_alone_leaves_no_shuffle_files(spark):
    def files():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {name for i in range(found.size()) if (name := found.apply(i).getName()).startswith("shuffle_")}

    before, setting = files(), spark.conf.get(session.CLEANUP_KEY)
    df = spark.range(1000).repartition(7)
    assert session.materialize_alone(df).count() == 1000 and spark.conf.get(session.CLEANUP_KEY) == setting
    # numbers of shuffles rise, and the count made one of its own
    written = lambda: {f.split("_")[1] for f in files() - before}
    until = time.time() + 20
    while len(written()) > 1 and time.time() < until:
        time.sleep(0.2)
    assert len(written()) <= 1


def test_rows_sorted_by_a_task_for_pieces_are_bounded(spark, monkeypatch):
    seen, keep = [], session.materialize
    monkeypatch.setattr(session, "materialize", lambda df: seen.append(keep(df)) or (seen[-1].cache() if "blk" in df.columns else seen[-1]))
    monkeypatch.setattr(ic, "NAMES", 3)
    monkeypatch.setattr(ic, "BLOCK", 50)
    ic.layered_ic(layered_rows(spark, 300), names=300)
    pieces = next(df for df in seen if "blk" in df.columns)
    sizes = [r.n for r in pieces.groupBy("blk").agg(F.sum("n").alias("n")).collect()]
    pieces.unpersist()
    assert sum(sizes) == 3 * (31 + 300) and max(sizes) <= 2 * 50


def test_layers_in_pieces_of_no_rows(spark, monkeypatch):
    long = layered_rows(spark, 12)
    monkeypatch.setattr(ic, "NAMES", 3)
    assert ic.layered_ic(long.limit(0), names=12).count() == 0
    few = ic.layered_ic(long.where("trade_time < '2024-01-03'"), names=12).collect()
    assert len(few) == 30 and all(r["rows"] == 0 and r["daily_rank_ic_mean"] is None for r in few)
