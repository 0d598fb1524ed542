"""Block-wise ranks, scans, percentiles and folds against plain pandas, with hot groups and heavy ties."""

import math
import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from factorlake.functions.ranks import exact_percentiles, ordered_blocks, pooled_ranks, row_ranks
from factorlake.functions.numeric import rank_corr
from factorlake.functions.scan import asof_backward, cut, merged_paths, neighbour, numbered, path_summary, scan
from factorlake.operators import composite, corr, fold, ic, paths, research, trades
from factorlake.operators import ledger as G


def skewed(n=3000, seed=0):
    """Half of the rows in one group, a third of the values equal."""
    rng = np.random.default_rng(seed)
    value = np.where(rng.random(n) < 0.34, 5.0, np.round(rng.normal(5, 3, n), 1))
    return pd.DataFrame(
        {"id": np.arange(n), "g": np.where(rng.random(n) < 0.5, "hot", rng.integers(0, 9, n).astype(str)), "x": value}
    )


def test_pooled_ranks_with_ties_over_blocks(spark):
    pdf = skewed()
    got = pooled_ranks(spark.createDataFrame(pdf), ["g"], "x", "r").toPandas().sort_values("id")
    assert len(got) == len(pdf)
    np.testing.assert_allclose(got["r"], pdf.groupby("g")["x"].rank())


def test_pooled_ranks_without_group_and_one_value(spark):
    pdf = skewed(400)
    got = pooled_ranks(spark.createDataFrame(pdf), [], "x", "r").toPandas().sort_values("id")
    np.testing.assert_allclose(got["r"], pdf["x"].rank())
    flat = spark.createDataFrame(pdf.assign(x=1.0))
    assert pooled_ranks(flat, [], "x", "r").select("r").distinct().collect()[0][0] == 200.5


def test_masked_ranks(spark):
    pdf = skewed(900).assign(m=lambda d: d["id"] % 3 == 0)
    df = spark.createDataFrame(pdf)
    got = row_ranks(df, ["g"], "x", "r", [F.lit(True), F.col("m")]).toPandas().sort_values("id").reset_index()
    np.testing.assert_allclose(got["r"].str[0], pdf.groupby("g")["x"].rank())
    part = pdf[pdf["m"]]
    np.testing.assert_allclose(got.loc[pdf["m"], "r"].str[1], part.groupby("g")["x"].rank())


def test_ordered_blocks_keep_all_rows(spark):
    df = spark.createDataFrame(skewed())
    cut_ = ordered_blocks(df, ["g", "x", "id"])
    assert cut_.count() == 3000
    sizes = [r["count"] for r in cut_.groupBy("blk").count().collect()]
    assert max(sizes) < 1500, "a hot group is spread over blocks"


def test_percentiles(spark):
    pdf = skewed()
    qs = {"a": 0.0, "b": 0.05, "c": 0.5, "d": 0.9, "e": 1.0}
    got = exact_percentiles(spark.createDataFrame(pdf), ["g"], "x", qs).toPandas().set_index("g").sort_index()
    for name, q in qs.items():
        np.testing.assert_allclose(got[name], pdf.groupby("g")["x"].quantile(q).sort_index())


def test_scan_and_numbers(spark):
    pdf = skewed(1500)
    blocks = cut(spark.createDataFrame(pdf), ["g"], ["id"])
    got = scan(blocks, ["g"], ["id"], sums={"s": "x"}, maxes={"m": "x"}).toPandas().sort_values("id")
    np.testing.assert_allclose(got["s"], pdf.groupby("g")["x"].cumsum())
    np.testing.assert_allclose(got["m"], pdf.groupby("g")["x"].cummax())
    no = numbered(spark.createDataFrame(pdf), ["g"], ["id"]).toPandas().sort_values("id")
    assert (no["no"].to_numpy() == pdf.groupby("g").cumcount() + 1).all()


@pytest.mark.parametrize("bucket", [None, "hundreds"])
def test_neighbour(spark, bucket):
    pdf = skewed(800)
    col = None if bucket is None else F.floor(F.col("id") / 100)
    df = spark.createDataFrame(pdf)
    back = neighbour(df, ["g"], "id", col, ["x"]).toPandas().sort_values("id")
    np.testing.assert_allclose(back["x_prev"], pdf.groupby("g")["x"].shift(1))
    ahead = neighbour(df, ["g"], "id", col, ["x"], ahead=True).toPandas().sort_values("id")
    np.testing.assert_allclose(ahead["x_prev"], pdf.groupby("g")["x"].shift(-1))


def test_asof(spark):
    days = pd.date_range("2024-01-01", periods=200, freq="D")
    left = pd.DataFrame({"code": ["a", "b"] * 100, "date": days})
    right = pd.DataFrame({"code": ["a"] * 3, "date": days[[20, 90, 150]], "factor": [1.0, 2.0, 3.0]})
    got = asof_backward(spark.createDataFrame(left), spark.createDataFrame(right), ["code"], "date", ["factor"])
    want = pd.merge_asof(left, right, on="date", by="code").sort_values(["code", "date"])["factor"]
    np.testing.assert_allclose(got.toPandas().sort_values(["code", "date"])["factor"], want)


def test_rank_matrix_with_different_nulls_and_ties(spark):
    rng = np.random.default_rng(1)
    n = 2000
    pdf = pd.DataFrame({"trade_time": np.repeat(np.arange(n // 20), 20), "code": [str(i) for i in range(20)] * (n // 20)})
    pdf["a"] = rng.normal(size=n)
    pdf["b"] = pdf["a"].where(rng.random(n) < 0.7)
    pdf["c"] = np.where(rng.random(n) < 0.4, 0.0, rng.normal(size=n)) + 0 * pdf["a"]
    pdf["d"] = pdf["c"].where(rng.random(n) < 0.5)
    pdf["e"] = 3.0
    pdf["f"] = np.nan
    names = list("abcdef")
    got = corr.spearman_matrix(spark.createDataFrame(pdf), names).toPandas()
    want = pdf[names].corr(method="spearman")
    for r in got.itertuples():
        w = want.loc[r.left, r.right]
        if math.isnan(w):
            assert r.spearman is None or math.isnan(r.spearman)
        else:
            assert r.spearman == pytest.approx(w, abs=1e-12)
        assert r.n == pdf[[r.left, r.right]].dropna().shape[0]
    chosen = corr.spearman_matrix(spark.createDataFrame(pdf), names, pairs=[("a", "d"), ("b", "c")]).toPandas()
    assert set(zip(chosen["left"], chosen["right"])) == {("a", "d"), ("b", "c")}
    for r in chosen.itertuples():
        assert r.spearman == pytest.approx(want.loc[r.left, r.right], abs=1e-12)


def test_rank_matrix_of_many_classes_in_small_buckets(spark, monkeypatch):
    """Buckets of a few cells and blocks of a few ranks give the same matrix; most factors have a null mask of their own."""
    monkeypatch.setattr(corr, "NUMBERS_PER_TASK", 4000)
    rng = np.random.default_rng(5)
    n, k = 300, 24
    pdf = pd.DataFrame({"trade_time": np.arange(n) // 10, "code": [str(i % 10) for i in range(n)]})
    names = [f"f{i}" for i in range(k)]
    for i, f in enumerate(names):
        pdf[f] = np.round(rng.normal(size=n), 1)
        if i % 4:
            pdf[f] = pdf[f].where(rng.random(n) < 0.8)
    got = corr.spearman_matrix(spark.createDataFrame(pdf), names).toPandas()
    want = pdf[names].corr(method="spearman")
    assert len(got) == k * (k - 1) // 2
    for r in got.itertuples():
        assert r.spearman == pytest.approx(want.loc[r.left, r.right], abs=1e-12)
        assert r.n == pdf[[r.left, r.right]].dropna().shape[0]


@pytest.mark.parametrize("classes", [1, 500])
def test_rank_matrix_of_500_factors_stays_within_a_gigabyte(classes):
    """A whole bucket of one task, with one null mask for all factors and with a mask each."""
    k = 500
    cls = [i % classes for i in range(k)]
    need = [list(range(classes))] * k
    cells = min(corr.bucket_cells(k * classes), 2000)
    wanted = np.array([(i, j) for i in range(k) for j in range(i + 1, k)])
    per = classes * cells
    rows = {
        "code": pa.array(np.tile(np.arange(cells), k)),
        "i": pa.array(np.repeat(np.arange(k), cells), pa.int32()),
        "ranks": pa.ListArray.from_arrays(
            pa.array(np.arange(0, k * per + 1, classes), pa.int32()), pa.array(np.random.default_rng(0).permutation(k * per) % 997.0)
        ),
    }
    run = corr._pair_sums(["code"], k, need, cls, list(range(classes)), wanted, np.full((k, k), 996.0))
    tracemalloc.start()
    got = run(pa.table(rows)).to_pydict()
    peak = tracemalloc.get_traced_memory()[1] + rows["ranks"].nbytes
    tracemalloc.stop()
    assert len(got["i"]) == len(wanted) and peak < 1 << 30
    flat = np.asarray(rows["ranks"].values).reshape(k, cells, classes) - 498.5
    for p in (0, 700, len(wanted) - 1):
        i, j = wanted[p]
        x, y = flat[i, :, cls[j]], flat[j, :, cls[i]]
        assert (got["sxy"][p], got["sxx"][p], got["syy"][p]) == (x @ y, x @ x, y @ y)


def test_layer_diagnostics_equal_the_layers(spark):
    rng = np.random.default_rng(8)
    rows = [
        (f, d, str(c), None if rng.random() < 0.1 else float(c), None if rng.random() < 0.1 else 1.0)
        for f in ("wide", "thin") for d in range(20) for c in range(int(rng.integers(9, 15)) if f == "wide" else 6)
    ]
    long = spark.createDataFrame([*rows, ("null", 0, "a", None, 1.0)], "factor string, trade_time int, code string, score double, label double")
    got = {r["factor"]: r.asDict() for r in ic.layer_diagnostics(long, ["wide", "thin", "null", "absent"]).collect()}
    placed = ic.decile_layer(long.dropna(), names=100).groupBy("factor").agg(F.count("layer").alias("n"), F.count("*").alias("all")).collect()
    for r in placed:
        g = got[r["factor"]]
        assert (g["layered_rows"], g["joined_rows"], g["unlayered_rows"]) == (r["n"], r["all"], r["all"] - r["n"])
    assert 0 < got["wide"]["thin_dates"] < got["wide"]["dates"] == 20 and got["wide"]["reason"] is None
    assert got["thin"]["thin_dates"] == 20 and got["thin"]["reason"] == "no date has 10 names with score and label"
    for f in ("null", "absent"):
        assert got[f]["joined_rows"] == got[f]["dates"] == 0 and got[f]["reason"] == "no non-null score/label rows"
    assert ic.layer_diagnostics(long.limit(0)).count() == 0


def greedy(order, rho, limit):
    kept, of = [], {}
    for f in order:
        hit = next((k for k in kept if abs(rho[frozenset((f, k))]) >= limit), None)
        if hit is None:
            kept.append(f)
        else:
            of[f] = hit
    return kept, of


def test_dedup_equals_greedy_walk(spark):
    rng = np.random.default_rng(3)
    names = [f"f{i:02d}" for i in range(14)]
    rho = {frozenset((a, b)): rng.uniform(-1, 1) for i, a in enumerate(names) for b in names[i + 1 :]}
    rows = [(*sorted(k), 10, v) for k, v in rho.items()]
    pairs = spark.createDataFrame(rows, "left string, right string, n bigint, spearman double")
    ranking = spark.createDataFrame([(f, i + 1) for i, f in enumerate(names)], "factor string, pos bigint")
    got = corr.dedup_batch(ranking, pairs, 0.6).collect()
    kept, of = greedy(names, rho, 0.6)
    assert sorted(r["factor"] for r in got if r["kept"]) == kept
    assert {r["factor"]: r["dedup_of"] for r in got if not r["kept"]} == of


def brute_strategy(rows):
    best, p, s, out = None, 0, 0, []
    for x, y, z, h in rows:
        if best is None:
            best = [x, y, z]
        else:
            gain = lambda c, b: (c - b) / max(abs(b), 1e-8)
            good = [gain(x, best[0]) >= 0.05, gain(y, best[1]) >= 0.05, (best[2] - z) / max(abs(best[2]), 1e-8) >= 0.05]
            best = [c if g else b for c, b, g in zip((x, y, z), best, good)]
            p = 0 if any(good) else p + 1
            s = s + 1 if h and not any(good) else 0
        out.append((*best, p, s))
    return out


def test_fold_over_a_hot_run(spark):
    rng = np.random.default_rng(5)
    runs = ["hot"] * 600 + [f"r{i}" for i in range(20) for _ in range(12)]
    pdf = pd.DataFrame({"run": runs})
    pdf["pos"] = pdf.groupby("run").cumcount() + 1
    pdf["excess_return"] = rng.normal(size=len(pdf)) * pdf["pos"] ** 0.5
    pdf["information_ratio"] = rng.normal(size=len(pdf))
    pdf["risk_to_reward"] = rng.gamma(2, 2, len(pdf)) - 1
    pdf["hypothesis_true"] = rng.random(len(pdf)) < 0.6
    got = fold.plateau_strategy(spark.createDataFrame(pdf)).toPandas().sort_values(["run", "pos"])
    for run, part in pdf.groupby("run"):
        want = brute_strategy(part[["excess_return", "information_ratio", "risk_to_reward", "hypothesis_true"]].to_numpy().tolist())
        cols = ["best_excess_return", "best_information_ratio", "best_risk_to_reward", "plateau_count", "success_plateau_count"]
        np.testing.assert_allclose(got[got["run"] == run][cols].to_numpy(dtype=float), np.array(want, dtype=float))


def test_library_size_is_floored(spark):
    steps = [1, -1, -1, 2, -5, 1, 1, -1]
    df = spark.createDataFrame(list(enumerate(steps)), "round int, delta int")
    got = [r["library_size"] for r in G.library_size(df).orderBy("round").collect()]
    size, want = 0, []
    for d in steps:
        size = max(0, size + d)
        want.append(size)
    assert got == want


def test_loss_streak_and_total_loss(spark):
    r = [0.1, -1.0, 0.5]
    df = spark.createDataFrame(list(enumerate(r)), "d int, r double")
    got = [x["r_cum"] for x in paths.compound(df, [], ["d"], ["r"]).orderBy("d").collect()]
    assert got == pytest.approx([0.1, -1.0, -1.0])


def test_forward_return_by_numbers_equals_window(spark):
    rng = np.random.default_rng(2)
    days = pd.date_range("2020-01-01", periods=300, freq="D")
    pdf = pd.DataFrame([(c, d, rng.uniform(1, 9)) for c in "abc" for d in days if rng.random() < 0.6], columns=["code", "trade_time", "close"])
    df = spark.createDataFrame(pdf)
    a = ic.forward_return(df, 3, "r", dates=300).toPandas().sort_values(["code", "trade_time"])
    b = ic.lead_by_number(df, 3, "r").toPandas().sort_values(["code", "trade_time"])
    want = pdf.groupby("code")["close"].shift(-3) / pdf["close"] - 1
    np.testing.assert_allclose(a["r"], want)
    np.testing.assert_allclose(b["r"], want)


def test_rolling_rank_ic_with_ties(spark):
    rng = np.random.default_rng(4)
    n = 90
    pdf = pd.DataFrame({"code": "a", "trade_time": pd.date_range("2024-01-01", periods=n), "x": rng.integers(0, 5, n) * 1.0, "y": rng.normal(size=n)})
    got = research.rolling_rank_ic(spark.createDataFrame(pdf), 20, dates=n).toPandas().sort_values("trade_time")["rank_ic"]
    want = [pdf["x"][i - 20 : i].rank().corr(pdf["y"][i - 20 : i].rank()) for i in range(20, n + 1)]
    np.testing.assert_allclose(got, want)


def path_of(x):
    """total, high, low, deepest fall and longest run of losses of a path."""
    p = np.cumsum(x)
    streak = best = 0
    for v in x:
        streak = streak + 1 if v < 0 else 0
        best = max(best, streak)
    return p[-1], p.max(), p.min(), (p - np.maximum.accumulate(p)).min(), best


@pytest.mark.parametrize("blocks", [1, 2, 7, 40])
def test_path_summary_merges_over_any_cut(spark, blocks):
    """Blocks of losses only, blocks without a loss, runs over many borders."""
    rng = np.random.default_rng(blocks)
    series = {"mixed": rng.normal(size=160), "losses": -rng.random(90), "gains": rng.random(50), "long": np.r_[rng.random(30), -rng.random(100), rng.random(9)], "one": np.array([-1.0])}
    pdf = pd.DataFrame([(g, i, float(v), v >= 0) for g, x in series.items() for i, v in enumerate(x)], columns=["g", "i", "x", "stop"])
    stored = ordered_blocks(spark.createDataFrame(pdf), ["g", "i"], blocks)
    summary = path_summary(stored, ["g"], ["i"], "x", "stop", {"n": F.count("*")})
    got = {r["g"]: r for r in merged_paths(summary, ["g"], ["n"]).collect()}
    for g, x in series.items():
        row = got[g]
        np.testing.assert_allclose([row["total"], row["high"], row["low"], row["fall"], row["streak"]], path_of(x), atol=1e-9)
        assert row["n"] == len(x)
    start = merged_paths(path_summary(stored, ["g"], ["i"], "x"), ["g"], start=True).collect()
    for r in start:
        assert r["fall"] == pytest.approx(path_of(np.r_[0.0, series[r["g"]]])[3])


def test_trade_report_and_equity(spark):
    rng = np.random.default_rng(8)
    x = np.round(rng.normal(size=300), 2)
    x[40:70] = -1.0
    pdf = pd.DataFrame({"dt_open": np.arange(300) // 3, "ref": np.arange(300), "pnlcomm": x, "is_liq": (np.arange(300) % 50 == 0).astype(int)})
    df = spark.createDataFrame(pdf)
    row = trades.trade_report(df).first()
    total, high, low, fall, streak = path_of(x)
    assert (row["n_trades"], row["loss_streak"]) == (300, streak) and streak >= 30
    assert row["max_drawdown"] == pytest.approx(fall) and row["win_rate"] == pytest.approx((x > 0).mean()) and row["liq_ratio"] == pytest.approx(6 / 300)
    assert row["avg_loss"] == pytest.approx(x[x < 0].mean()) and row["profit_factor"] == pytest.approx(x[x > 0].sum() / -x[x < 0].sum())
    got = trades.equity(df, 100.0).toPandas().sort_values("ref")
    np.testing.assert_allclose(got["equity"], 100 + np.cumsum(x))
    np.testing.assert_allclose(got["peak"], np.maximum.accumulate(100 + np.cumsum(x)))
    none = trades.trade_report(df.limit(0)).first()
    assert (none["n_trades"], none["loss_streak"], none["max_drawdown"]) == (0, 0, None) and trades.loss_streak(df.limit(0)).first()[0] == 0
    nulls = spark.createDataFrame([(1, 1, None, 0), (2, 2, -1.0, 0), (3, 3, None, 1)], "dt_open int, ref int, pnlcomm double, is_liq int")
    assert trades.trade_report(nulls).first()["loss_streak"] == 1


@pytest.mark.parametrize("r", [[0.1, -0.2, 0.05, -0.4, 0.9], [-0.3, 0.1], [0.2, 0.1], [0.5, -1.0, 3.0], [-2.0]])
def test_max_drawdown_ratio(spark, r):
    w = np.cumprod(1 + np.array(r))
    if min(r) <= -1:
        w[int(np.argmax(np.array(r) <= -1)) :] = 0.0
    want = min(0.0, (w / np.maximum(1, np.maximum.accumulate(w)) - 1).min())
    df = spark.createDataFrame(list(enumerate(r)), "d int, r double")
    assert paths.max_drawdown_ratio(df, ["d"], "r").first()[0] == pytest.approx(want)


@pytest.mark.parametrize("n", [1, 2, 7, 40])
def test_sliding_spearman_equals_every_window(n):
    rng = np.random.default_rng(n)
    x, y = rng.integers(0, 4, 120) * 1.0, np.round(rng.normal(size=120), 1)
    y[30:80] = 2.0
    got = research.sliding_spearman(x, y, n, cells=300)
    want = [pd.Series(x[i - n : i]).rank().corr(pd.Series(y[i - n : i]).rank()) for i in range(n, 121)]
    np.testing.assert_allclose(got, want, atol=1e-12)
    assert len(research.sliding_spearman(x[: n - 1], y[: n - 1], n)) == 0
    assert all(v == 0 for v, w in zip(got, want) if abs(w) < 1e-14), "no relation is exactly 0"


def test_rolling_rank_ic_over_long_windows(spark):
    """A window of 1,000 rows, over chunks."""
    rng = np.random.default_rng(6)
    n, k = 2600, 1000
    pdf = pd.DataFrame({"code": "a", "trade_time": pd.date_range("2024-01-01", periods=n, freq="h"), "x": rng.normal(size=n), "y": rng.integers(0, 9, n) * 1.0})
    got = research.rolling_rank_ic(spark.createDataFrame(pdf), k, dates=None, segment=1200).toPandas().sort_values("trade_time")["rank_ic"].to_numpy()
    assert len(got) == n - k + 1
    for i in (0, 1, 777, n - k):
        part = pdf[i : i + k]
        assert got[i] == pytest.approx(part["x"].rank().corr(part["y"].rank()), abs=1e-12)


@pytest.mark.parametrize("n", [1, 3, 60])
def test_rolling_pairs_is_a_band_join(spark, n):
    pdf = pd.DataFrame([(c, i, float(i * i)) for c, size in (("a", 100), ("b", 2), (None, 7)) for i in range(1, size + 1)], columns=["code", "no", "x"])
    df = spark.createDataFrame(pdf, "code string, no long, x double")
    got = sorted(((r.code or "", r.window_no, r.no, r.x) for r in research.rolling_pairs(df, n).collect()))
    want = sorted((a.code or "", a.no, b.no, b.x) for a in pdf.itertuples() for b in pdf.itertuples() if (a.code or "") == (b.code or "") and a.no - n < b.no <= a.no)
    assert got == want


def test_rank_corr_is_exact(spark):
    rows = [("zero", 1.0, 2.0), ("zero", 2.0, 4.0), ("zero", 3.0, 1.0), ("zero", 4.0, 3.0), ("flat", 1.5, 1.0), ("flat", 1.5, 2.0), ("one", 1.0, 1.0), ("same", 1.5, 1.5), ("same", 1.5, 1.5), ("same", 3.0, 3.0)]
    df = spark.createDataFrame(rows, "g string, rx double, ry double")
    for most in (None, 10):
        got = dict(df.groupBy("g").agg(rank_corr("rx", "ry", most)).collect())
        assert got == {"zero": 0.0, "flat": None, "one": None, "same": 1.0}


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_factor_analyze_does_not_depend_on_partitions(spark, parts):
    """The same record to the last bit, however rows are dealt."""
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame([(t, str(c), 10.0 + rng.random()) for t in pd.date_range("2024-01-01", periods=25) for c in range(12)], columns=["trade_time", "code", "close"])
    pdf["f"], pdf["g"] = rng.integers(0, 4, len(pdf)) * 1.0, rng.normal(size=len(pdf))
    df = spark.createDataFrame(pdf)
    fields = ["daily_ic_mean", "rank_ic", "daily_rank_ic_mean", "rank_ic_distribution.zero_rate", "rank_ic_distribution.negative_rate", "ic_distribution.positive_rate"]
    want = sorted(ic.factor_analyze(df.repartition(5), ["f", "g"], dates=25).select("factor", *fields).collect())
    got = sorted(ic.factor_analyze(df.repartition(parts, "close"), ["f", "g"], dates=25).select("factor", *fields).collect())
    assert [tuple(r)[4:] for r in got] == [tuple(r)[4:] for r in want]
    for a, b in zip(got, want):
        assert tuple(a)[1:4] == pytest.approx(tuple(b)[1:4], abs=1e-12)
    by_hand = pdf.assign(y=pdf.groupby("code")["close"].shift(-1) / pdf["close"] - 1).dropna().groupby("trade_time").apply(lambda d: np.cov(d["f"].rank(), d["y"].rank())[0, 1])
    assert got[0][4] == pytest.approx((by_hand.abs() < 1e-12).mean())


def library_panel(spark, factors=6, seed=11):
    rng = np.random.default_rng(seed)
    rows = []
    for t in pd.date_range("2024-01-01", periods=12):
        for c in range(9):
            close = float(10 + rng.random())
            for f in range(factors):
                # some cells have one factor only
                if rng.random() < 0.8 and not (c == 8 and f != 2):
                    rows.append((f"f{f}", t.to_pydatetime(), str(c), float(rng.integers(0, 7)), close))
    return spark.createDataFrame(rows, "factor string, trade_time timestamp_ntz, code string, score double, close double")


def test_composite_change_equals_a_new_library(spark):
    """Factors come and go one after another: the sums are those of a library built from nothing, to the last bit."""
    scores = library_panel(spark)
    ranked = composite.stored_ranks(scores, 9)
    table = lambda ws: spark.createDataFrame(list(ws.items()), "factor string, weight double")
    library = {"f0": 0.031, "f1": -0.2, "f2": 0.11}
    sums = composite.composite_sums(ranked, table(library))
    for come, go in (({"f3": 0.07}, []), ({"f4": 0.3}, ["f2"]), ({"f2": 0.9, "f5": 0.013}, ["f0", "f1"]), ({}, ["f3", "f4"])):
        change = [(f, w, 1) for f, w in come.items()] + [(f, library[f], -1) for f in go]
        sums = composite.composite_change(sums, ranked, spark.createDataFrame(change, "factor string, weight double, sign int"))
        library = {f: w for f, w in library.items() if f not in go} | come
        rows = lambda df: sorted(map(str, df.select("trade_time", "code", "top", "bottom", "members", "close").collect()))
        assert rows(sums) == rows(composite.composite_sums(ranked, table(library)))
        plain = composite.composite_score(ranked, composite.with_order(table(library))).toPandas().sort_values(["trade_time", "code"])
        got = composite.composite_of(sums).toPandas().sort_values(["trade_time", "code"])
        np.testing.assert_allclose(got["score"], plain["score"], atol=1e-12)
        assert (got["close"].to_numpy() == plain["close"].to_numpy()).all() and len(got) == len(plain)


def test_judged_change_reads_the_changed_factors_only(spark):
    scores = library_panel(spark, factors=9)
    ranked = composite.stored_ranks(scores, 9)
    table = lambda ws: spark.createDataFrame(ws, "factor string, weight double")
    base = [(f"f{i}", 0.05 + i / 100) for i in range(7)]
    sums = composite.composite_sums(ranked, table(base))
    before = composite.composite_ic(composite.composite_of(sums), (), 1, 12, 9).first()["rank_ic"]
    change = [("f8", 0.4, 1), ("f3", 0.08, -1)]
    after, gate = composite.judged_change(sums, before, 7, ranked, change, dates=12, names=9)
    full = composite.marginal_gate(scores, table(base), table([("f8", 0.4)]), table([("f3", 0.0)]), dates=12, names=9).first().asDict()
    assert gate.keys() == full.keys() and gate["with_candidate_count"] == 7
    for k, v in full.items():
        assert gate[k] == (pytest.approx(v, abs=1e-12) if isinstance(v, float) else v)
    plan = ranked.where(F.col("factor").isin(["f8", "f3"]))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(factor" in plan
    empty = composite.composite_sums(ranked, table([]))
    assert composite.judged_change(empty, None, 0, ranked, [("f1", 0.2, 1)], dates=12, names=9)[1]["verdict"] == "skipped"


@pytest.fixture(scope="module")
def graded():
    """Groups of graded copies, negatives, ties, masks of several kinds, a constant, an empty and a nearly empty column."""
    rng = np.random.default_rng(11)
    n, k = 1500, 28
    pdf = pd.DataFrame({"trade_time": np.arange(n) // 10, "code": [str(i % 10) for i in range(n)]})
    base = rng.normal(size=(n, 4))
    for i in range(k):
        noise = 0 if i % 9 == 0 else 10.0 ** rng.uniform(-2, 1)
        x = (-1) ** (i % 3) * base[:, i % 4] + noise * rng.normal(size=n)
        pdf[f"f{i:02d}"] = np.round(x, 1) if i % 5 == 0 else x
        if i % 7 == 0:
            pdf[f"f{i:02d}"] = pdf[f"f{i:02d}"].where(rng.random(n) < 0.6)
    pdf["same"], pdf["none"] = 3.0, np.nan
    pdf["two"] = pdf["f01"].where(pdf.index < 2)
    return pdf


@pytest.mark.parametrize("threshold", [0.5, 0.95, 0.98, 1.0])
def test_close_pairs_equal_the_matrix(spark, graded, threshold):
    names = [c for c in graded.columns if c not in ("trade_time", "code")]
    frame = spark.createDataFrame(graded)
    found = corr.close_pairs(frame, names, threshold)
    got = {(r.left, r.right): (r.n, r.spearman) for r in found.pairs.collect()}
    want = graded[names].corr(method="spearman")
    rho = {(a, b): want.loc[a, b] for i, a in enumerate(names) for b in names[i + 1 :]}
    # pandas and the sums may fall on different sides of a coefficient that is the threshold but for rounding
    sure = {p for p, r in rho.items() if abs(r) >= threshold + 1e-12}
    assert sure <= set(got) <= {p for p, r in rho.items() if abs(r) >= threshold - 1e-12}
    for p, (n, r) in got.items():
        assert r == pytest.approx(rho[p], abs=1e-12)
        assert n == graded[list(p)].dropna().shape[0]
    assert found.asked == len(rho) and found.work < (0.9 if threshold == 0.5 else 0.35)


def test_close_pairs_of_chosen_pairs_and_small_tables(spark, graded):
    frame = spark.createDataFrame(graded)
    asked = [("f09", "f01"), ("f00", "f04"), ("f18", "f02"), ("f05", "f09")]
    got = corr.close_pairs(frame, ["f00", "f01", "f02", "f04", "f05", "f09", "f18"], 0.9, pairs=asked)
    want = graded.drop(columns=["trade_time", "code"]).corr(method="spearman")
    assert {(r.left, r.right) for r in got.pairs.collect()} == {p for p in asked if abs(want.loc[p]) >= 0.9}
    for rows in (0, 1, 2):
        few = corr.close_pairs(frame.limit(rows), ["f01", "f02", "f03"], 0.9)
        assert few.pairs.count() == (3 if rows == 2 else 0)
    assert corr.close_pairs(frame, ["f01"], 0.9).pairs.count() == 0
    assert corr.spearman_matrix(frame, ["f01"]).count() == 0


def test_pairs_without_relation_go_after_a_sixteenth_of_the_cells(spark):
    rng = np.random.default_rng(2)
    n, k = 3000, 40
    pdf = pd.DataFrame({"trade_time": np.arange(n) // 10, "code": [str(i % 10) for i in range(n)]})
    names = [f"f{i}" for i in range(k)]
    pdf = pd.concat([pdf, pd.DataFrame(rng.normal(size=(n, k)), columns=names)], axis=1)
    pdf["f7"] = pdf["f3"] ** 3
    found = corr.close_pairs(spark.createDataFrame(pdf), names, 0.98)
    assert [(r.left, r.right, round(r.spearman, 12)) for r in found.pairs.collect()] == [("f3", "f7", 1.0)]
    assert [pairs for _, pairs in found.rounds] == [k * (k - 1) // 2, 1, 1] and found.work < 0.07
