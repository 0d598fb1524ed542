"""Small panels with known results."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from factorlake.functions import text as X
from factorlake.functions import ts
from factorlake.functions.numeric import mean_over_std
from factorlake.operators import admission, composite, corr, decide, ic, reports
from factorlake.operators import ledger as G
from factorlake.operators import library_factors as lib
from factorlake.operators import panel as P
from factorlake.operators import slots as S
from factorlake.session import shared_dir
from factorlake.sources import lake as L
from factorlake.sources.store import FactorStore


def bars(spark, days, codes, close):
    rows = [(d, c, close(i, j)) for i, d in enumerate(pd.date_range("2020-01-01", periods=days)) for j, c in enumerate(codes)]
    pdf = pd.DataFrame(rows, columns=["trade_time", "code", "close"])
    for name, add in (("open", -0.1), ("high", 0.2), ("low", -0.2)):
        pdf[name] = pdf["close"] + add
    pdf["volume"], pdf["amount"] = 1000.0, pdf["close"] * 1000
    df = spark.createDataFrame(pdf)
    return df.withColumn("trade_time", F.col("trade_time").cast("timestamp_ntz"))


def close_factor(name="f"):
    return P.Factor(name, lambda: [{name: F.col("close")}])


def test_shift_by_one(spark):
    panel = bars(spark, 4, ["SH600000", "SH600004"], lambda i, j: 10.0 * (j + 1))
    got = P.compute_factors(panel, [close_factor()], shift=1).orderBy("trade_time", "code").collect()
    assert len(got) == 8
    assert [r["f"] for r in got[:4]] == [None, None, 10.0, 20.0]
    assert [r["score"] for r in got[2:4]] == [10.0, 20.0]
    with pytest.raises(ValueError):
        P.compute_factors(panel, [close_factor()], shift=-1)


def test_segments_do_not_change_factors(spark):
    rng = np.random.default_rng(0)
    noise = rng.uniform(5, 15, (70, 12))
    panel = bars(spark, 70, [f"c{j}" for j in range(12)], lambda i, j: noise[i, j])
    panel = panel.where("hash(code, trade_time) % 5 != 0")
    factors = [lib.case_momentum_vol(3, 8), lib.liq_momentum(3, 8), lib.volatility(6)]
    plain = P.compute_factors(panel, factors).orderBy("trade_time", "code").toPandas()
    cut = P.compute_factors(panel, factors, segment=23).orderBy("trade_time", "code").toPandas()
    pd.testing.assert_frame_equal(plain, cut)


def test_case_factor_equals_pandas(spark):
    rng = np.random.default_rng(7)
    noise = rng.uniform(5, 15, (60, 12))
    panel = bars(spark, 60, [f"c{j:02d}" for j in range(12)], lambda i, j: noise[i, j]).where("hash(code, trade_time) % 7 != 0")
    pdf = panel.toPandas()
    close, amount = (pdf.pivot(index="trade_time", columns="code", values=v) for v in ("close", "amount"))
    fast, slow = close.pct_change(3, fill_method=None), close.pct_change(8, fill_method=None)
    vol = close.pct_change(fill_method=None).rolling(8, min_periods=4).std()
    rank = amount.rolling(8, min_periods=4).mean().rank(axis=1, pct=True)
    want = ((fast - slow) / vol.mask(vol.abs() < 1e-12)).where(rank >= 0.2).stack()
    got = P.compute_factors(panel, [lib.case_momentum_vol(3, 8, name="f")]).dropna(subset=["f"]).toPandas()
    got = got.set_index(["trade_time", "code"])["f"].sort_index()
    want = want.reindex(got.index)
    np.testing.assert_allclose(got, want)
    seen = pdf.set_index(["trade_time", "code"]).index
    assert len(got) == ((fast - slow) / vol).where(rank >= 0.2).stack().dropna().index.intersection(seen).size


def test_ewm_equals_pandas(spark):
    rng = np.random.default_rng(8)
    values = rng.normal(size=400)
    values[rng.random(400) < 0.2] = np.nan
    panel = bars(spark, 400, ["a"], lambda i, j: values[i])
    dense = P.densify(panel, lookback=2 * ts.ewm_block(0.4), segment=150)
    got = P.ewm(dense, "close", "e", 0.4, segment=150).where("NOT halo").orderBy("t").toPandas()["e"]
    np.testing.assert_allclose(got, pd.Series(values).ewm(alpha=0.4).mean(), rtol=1e-10)


def test_ewm_over_long_gaps(spark):
    """Three values, nearly four hundred empty slots, one value, and empty slots again."""
    values = np.full(560, np.nan)
    values[[0, 1, 2, 399]] = 1.0, 2.5, 2.4, 7.0
    days = bars(spark, 560, ["a", "b"], lambda i, j: values[i] if j == 0 else 1.0)
    for segment in (220, 65_536):
        dense = P.densify(days, lookback=2 * ts.ewm_block(0.3), segment=segment)
        got = P.ewm(dense, "close", "e", 0.3, segment=segment).where("NOT halo AND code = 'a'").orderBy("t").toPandas()["e"]
        np.testing.assert_allclose(got, pd.Series(values).ewm(alpha=0.3).mean(), rtol=1e-10)


def decile_panel(spark, days=5, names=20):
    return bars(spark, days, [f"SH60{j:04d}" for j in range(names)], lambda i, j: 100 + i * (j + 1.0)).withColumn(
        "score", F.substring("code", 5, 4).cast("double")
    )


def test_decile_panel_record(spark):
    rec = ic.factor_analyze(decile_panel(spark), ["score"]).collect()[0]
    assert rec["daily_ic_count"] == 4 and rec["daily_rank_ic_mean"] == pytest.approx(1.0)
    assert rec["daily_ic_mean"] == pytest.approx(0.997044, abs=1e-6)
    assert rec["daily_ic_std"] == pytest.approx(0.003147, abs=1e-6)
    assert rec["ic"] == pytest.approx(0.952256, abs=1e-6)
    assert rec["rank_ic"] == pytest.approx(0.963624, abs=1e-6)
    assert rec["rank_icir"] is None
    assert sorted(rec["deciles"]) == sorted(f"Decile{i}" for i in range(1, 11))
    assert all(v["rows"] == 8 for v in rec["deciles"].values())


def test_few_names_have_no_layer(spark):
    long = ic.labelled(decile_panel(spark, names=4), ["score"])
    assert ic.decile_layer(long).where("layer IS NOT NULL").count() == 0


def test_wide_universe_paths_agree(spark, monkeypatch):
    long = ic.labelled(decile_panel(spark), ["score"])
    key = ["trade_time", "code"]
    a = ic.decile_layer(long).orderBy(*key).toPandas()["layer"]
    monkeypatch.setattr(ic, "NAMES", 3)
    b = ic.decile_layer(long, names=20).orderBy(*key).toPandas()["layer"]
    assert (a == b).all()
    d = ic.daily_ic(long, names=20).toPandas()
    np.testing.assert_allclose(d["rank_ic"], 1.0)


def long_scores(spark, series, close):
    days = ["2024-01-02", "2024-01-03", "2024-01-04"]
    rows = []
    for name, scores in series.items():
        for n, s in enumerate(scores):
            rows.append((name, days[n // 2], "AB"[n % 2], float(s), float(close[n])))
    df = spark.createDataFrame(rows, "factor string, trade_time string, code string, score double, close double")
    return df.withColumn("trade_time", F.col("trade_time").cast("timestamp_ntz"))


def test_two_factor_composite(spark):
    scores = long_scores(spark, {"factor-a": [1, 2, 2, 3], "factor-b": [2, 1, 4, 3]}, [10, 20, 11, 19])
    weights = spark.createDataFrame([("factor-a", 0.04), ("factor-b", 0.03)], "factor string, weight double")
    norm = {r["factor"]: r["normalized"] for r in composite.normalized_weights(weights).collect()}
    assert norm["factor-a"] == pytest.approx(0.5714286, abs=1e-7)
    comp = composite.composite_score(composite.composite_rank(scores), composite.with_order(weights))
    got = comp.orderBy("trade_time", "code").collect()
    assert [r["score"] for r in got] == pytest.approx([0.2142857, 0.2857143] * 2, abs=1e-7)
    assert [r["close"] for r in got] == [10, 20, 11, 19]


def test_gate_rejects_a_harmful_candidate(spark):
    scores = long_scores(spark, {"old": [1, 2, 2, 3, 3, 4], "new": [6, 1, 5, 2, 4, 3]}, [10, 20, 11, 25, 12, 30])
    lib_ = spark.createDataFrame([("old", 0.04)], "factor string, weight double")
    new = spark.createDataFrame([("new", 0.06)], "factor string, weight double")
    gate = composite.marginal_gate(scores, lib_, new).first()
    assert gate["delta_rank_ic"] < 0 and not gate["passed"] and gate["verdict"] == "rejected"
    empty = composite.marginal_gate(scores, lib_.limit(0), new).first()
    assert empty["passed"] and empty["verdict"] == "skipped"


@pytest.mark.parametrize(
    "start, stop, warm, want",
    [
        (None, None, None, ("2025-01-01", "2025-12-31", "2024-01-01", 366)),
        ("2025-01-01", "2026-01-31", None, ("2025-01-01", "2026-01-31", "2024-01-01", 366)),
        ("2025-07-01", "2026-06-30", "2025-01-01", ("2025-07-01", "2026-06-30", "2025-01-01", 181)),
    ],
)
def test_oos_windows(spark, start, stop, warm, want):
    d = lambda v: None if v is None else F.to_date(F.lit(v))
    cols = composite.oos_period(F.to_date(F.lit("2024-12-31")), d(start), d(stop), d(warm))
    row = spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()
    assert (str(row[0]), str(row[1]), str(row[2]), row[3]) == want


def batch(spark):
    rows, noise = [], np.random.default_rng(11).uniform(0, 3, (6, 11))
    for t, day in enumerate(pd.date_range("2024-01-02", periods=6)):
        for i in range(1, 11):
            base = t * 0.1 + i
            rows.append((day, f"S{i:03d}", 100.0 + t * i + noise[t, i], base, base * 1.001, (-1.0) ** i * i + t * 0.03, 0.0))
    pdf = pd.DataFrame(rows, columns=["trade_time", "code", "close", "base", "duplicate", "orthogonal", "failed"])
    df = spark.createDataFrame(pdf).withColumn("trade_time", F.col("trade_time").cast("timestamp_ntz"))
    return df


def test_batch_of_candidates(spark):
    names = ["base", "duplicate", "orthogonal", "failed"]
    pairs = corr.spearman_matrix(batch(spark), names)
    rho = {(r["left"], r["right"]): r["spearman"] for r in pairs.collect()}
    assert rho["base", "duplicate"] == pytest.approx(1.0)
    assert rho["base", "orthogonal"] == pytest.approx(0.159767, abs=1e-6)
    assert rho["base", "failed"] is None
    ranking = spark.createDataFrame([("base", 1), ("duplicate", 2), ("orthogonal", 3)], "factor string, pos bigint")
    got = {r["factor"]: (r["kept"], r["dedup_of"]) for r in corr.dedup_batch(ranking, pairs).collect()}
    assert got == {"base": (True, None), "duplicate": (False, "base"), "orthogonal": (True, None)}


def test_admission_walk(spark):
    """base first; its duplicate is blocked; the constant one fails the screen; the store holds the result."""
    store = FactorStore(spark, f"{shared_dir(spark)}/walk-{np.random.default_rng().integers(1 << 40)}")
    frame = batch(spark)
    rows = admission.admit_candidates(frame, ["failed", "duplicate", "base", "orthogonal"], store=store).collect()
    by = {r["factor"]: r for r in rows}
    assert [r["attempt"] for r in rows] == [1, 2, 3, 4]
    assert rows[0]["factor"] == "base" and by["base"]["status"] == "accepted"
    assert by["duplicate"]["status"] == "rejected" and by["duplicate"]["blocking"] == ["base"]
    assert by["failed"]["reason"] == "rank_ic_fast_screen_failed"
    assert by["orthogonal"]["status"] == "rejected"
    assert [r["name"] for r in store.list("accepted").collect()] == ["base"]


def brute_walk(ics, rho, verdict, gate, accepted):
    """Plain walk over the same facts."""
    library, out = list(accepted), {}
    for name in sorted(ics, key=lambda n: (-ics[n], n)):
        close = [m for m in library if abs(rho.get(frozenset((name, m)), 0)) >= 0.95]
        block = [m for m in close if not ics.get(name, 0) > accepted.get(m, ics.get(m, 0))]
        if ics[name] <= 0.01 or verdict[name] != "accepted" or block:
            out[name] = "rejected"
            continue
        out[name] = "accepted" if gate(library, close, name) else "rejected"
        if out[name] == "accepted":
            library = [m for m in library if m not in close] + [name]
    return out


def test_admission_equals_plain_walk(spark, sf):
    from factorlake.plans import cands

    names = ["case_momentum_vol", "mom_1", "rev_1", "mom_12", "rev_12", "vol_6"]
    frame = cands.frame(spark, sf).select("trade_time", "code", "close", *names)
    pdf = frame.toPandas()
    got = {r["factor"]: r for r in admission.admit_candidates(frame, names).collect()}
    ics = {n: got[n]["ic"] for n in names}
    verdict = {n: "rejected" if got[n]["failed_checks"] else "accepted" for n in names}
    rho = {frozenset((a, b)): pdf[[a, b]].dropna().rank().corr().iloc[0, 1] for i, a in enumerate(names) for b in names[i + 1 :]}

    def comp_ic(members):
        ranks = {m: pdf.groupby("trade_time")[m].rank(pct=True) - 0.5 for m in members}
        top = sum(ranks[m].fillna(0) * ics[m] for m in members)
        low = sum(ranks[m].notna() * abs(ics[m]) for m in members)
        c = pdf.assign(s=top / low.replace(0, np.nan)).dropna(subset=["s"]).sort_values(["code", "trade_time"])
        c["y"] = c.groupby("code")["close"].shift(-1) / c["close"] - 1
        c = c.dropna(subset=["y"])
        return c.groupby("trade_time").apply(lambda d: d["s"].rank().corr(d["y"].rank()), include_groups=False).mean()

    def gate(library, replaced, name):
        members = [m for m in library if ics[m] > 0.01]
        if not members:
            return True
        return comp_ic([m for m in members if m not in replaced] + [name]) - comp_ic(members) >= 0

    want = brute_walk(ics, rho, verdict, gate, {})
    assert {n: got[n]["status"] for n in names} == want


def test_review(spark):
    schema = "runs_ok boolean, coverage double, missing_rate double, ic double, icir double, ic_count int, layers int"
    rows = [(True, 0.95, 0.05, 0.03, 0.4, 20, 1), (True, 0.95, 0.05, -0.01, -0.1, 20, 1), (True, 0.95, 0.05, 0.03, 0.4, 20, 0)]
    got = decide.review(spark.createDataFrame(rows, schema), F.col("layers")).collect()
    assert [r["verdict"] for r in got] == ["accepted", "rejected", "rejected"]
    assert got[1]["failed_checks"] == ["rank_ic_ok", "icir_ok"]
    assert got[2]["failed_checks"] == ["decile_layer_ok"]


def test_direction_order(spark):
    cols = "branch string, mode string, axis string, parent string, ic double"
    adm = spark.createDataFrame([("Liquidity", "novelty", None, None, 0.06), ("Mix", "mutation", "add_interaction", "p", 0.055)], cols)
    rej = spark.createDataFrame(
        [("Momentum", "novelty", None, None, -0.01, "failed"), ("Mix", "mutation", "replace_gate", "p", 0.02, "duplicate")],
        cols + ", label string",
    )
    stats = G.direction_stats(adm, rej)
    names = spark.createDataFrame([("Liquidity",), ("Momentum",)], "branch string")
    first = G.branch_rank(stats, names, ["novelty"]).where("place = 1").first()
    assert first["branch"] == "Liquidity"
    axes = spark.createDataFrame([("replace_gate",), ("add_interaction",)], "axis string")
    assert G.axis_rank(stats, axes).where("place = 1").first()["axis"] == "add_interaction"


def test_error_reports_over_two_rounds(spark):
    line = "- error_type={}; count={}; frequency=0.5; cause=c{}; evidence=e; fix=f"
    one = "\n".join(["## Summary", "error_type=No; count=9", "## Error Frequency", line.format("MissingSaveSignal", 3, 1), line.format("NameError", 1, 1), "## End", line.format("Late", 5, 1)])
    two = "\n".join(["## error frequency", line.format("missingsavesignal", 1, 2), "* NameError: count=2; cause=c3; fix=g", "- none: x"])
    texts = spark.createDataFrame([(1, one), (2, two)], "round int, text string")
    got = reports.error_reports(texts, "round", "text").withColumn("seq", F.lit(0))
    stats = G.failure_topn(G.failure_stats(got), 10).collect()
    assert [(r["key"], r["count"], r["rounds"]) for r in stats] == [("missingsavesignal", 4, [1, 2]), ("nameerror", 3, [1, 2])]
    assert stats[1]["latest_cause"] == "c3" and stats[1]["latest_fix"] == "g"


def test_kline_import_and_compaction(spark):
    t0 = 1_700_000_000_000 // 60_000 * 60_000
    rows = [(t0 + i * 60_000, 100.0 + i, 100.5 + i, 99.5 + i, 100.2 + i, 1.0, t0 + i * 60_000 + 59_999, 2.0, 3, 0.5, 0.5) for i in range(10)]
    cols = "open_time bigint, open double, high double, low double, close double, volume double, close_time bigint, quote_volume double, num_trades bigint, taker_buy_base_vol double, taker_buy_quote_vol double"
    path = f"{shared_dir(spark)}/klines-{np.random.default_rng().integers(1 << 40)}"
    df = L.normalize(spark.createDataFrame(rows, cols), venue="v", symbol="s", interval="1m").withColumn("ingest", F.lit(1))
    L.write(df, path, 1)
    L.write(df, path, 2)
    assert L.query(L.scan(spark, path), "v", ["s"], "1m").count() == 10
    L.compact(spark, path)
    L.compact(spark, path, force=True)
    times = [r["open_time"] for r in L.scan(spark, path).collect()]
    assert sorted(times) == [t0 + i * 60_000 for i in range(10)]
    with pytest.raises(ValueError):
        L.normalize(spark.createDataFrame(rows, cols).drop("close"), venue="v", symbol="s", interval="1m")
    with pytest.raises(ValueError):
        L.resample(L.scan(spark, path), "3m")


def test_lake_query_prunes_days(spark):
    path = f"{shared_dir(spark)}/prune-{np.random.default_rng().integers(1 << 40)}"
    rows = [(i * 43_200_000, *[1.0] * 5, i * 43_200_000 + 1, 1.0, 1, 1.0, 1.0) for i in range(8)]
    cols = "open_time bigint, open double, high double, low double, close double, volume double, close_time bigint, quote_volume double, num_trades bigint, taker_buy_base_vol double, taker_buy_quote_vol double"
    bars = L.normalize(spark.createDataFrame(rows, cols), venue="v", symbol="s", interval="1m")
    with pytest.raises(ValueError, match="ingest"):
        L.write(bars, path, 1)
    L.write(bars.withColumn("ingest", F.lit(1)), path, 1)
    got = L.query(L.scan(spark, path), "v", ["s"], "1m", L.DAY_MS, 2 * L.DAY_MS, ["open_time"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    part = plan[plan.index("PartitionFilters") :]
    assert "date" in part[: part.index("PushedFilters")] and "open_time" in part[part.index("PushedFilters") :]
    assert sorted(r["open_time"] for r in got.collect()) == [2 * 43_200_000, 3 * 43_200_000, 4 * 43_200_000]


def test_store_rules(spark):
    store = FactorStore(spark, f"{shared_dir(spark)}/store-{np.random.default_rng().integers(1 << 40)}")
    row = lambda n: spark.createDataFrame([(n, 0.1)], "name string, ic double")
    store.save(row("good-1"))
    for bad in ("../x", "", "-a"):
        with pytest.raises(ValueError):
            store.save(row(bad))
    with pytest.raises(FileExistsError):
        store.save(row("good-1"))
    store.save(spark.createDataFrame([("good-1", 0.2)], "name string, ic double"), overwrite=True)
    with pytest.raises(ValueError):
        store.set_status(spark.createDataFrame([("good-1", "lost")], "name string, status string"))
    store.set_status(spark.createDataFrame([("good-1", "accepted")], "name string, status string"))
    store.add_review(spark.createDataFrame([("good-1", '{"ok": true}')], "name string, review string"))
    got = store.read("good-1").first()
    assert (got["ic"], got["status"], got["review"]) == (0.2, "accepted", '{"ok": true}')
    ghost = spark.createDataFrame([("ghost", "accepted", "{}")], "name string, status string, review string")
    for change in (store.set_status, store.add_review, store.archive):
        with pytest.raises(KeyError, match="ghost"):
            change(ghost)
    with pytest.raises(KeyError):
        store.read("ghost")
    other = FactorStore(spark, store.path)
    for writer, event in ((other, '{"n": 1}'), (store, '{"n": 2}')):
        writer.archive(spark.createDataFrame([("good-1", event)], "name string, review string"))
    got = store.read("good-1").first()
    assert got["status"] == "archived"
    assert got["review"] == '{"ok": true, "archive_history": [{"n": 1}, {"n": 2}], "latest_archive_event": {"n": 2}}'
    store.save(spark.createDataFrame([("good-1", "new")], "name string, description string"), overwrite=True)
    got = store.read("good-1").first()
    assert (got["ic"], got["status"], got["horizon"], got["source"]) == (None, "candidate", 1, "rlm")
    assert [r["review"] for r in store.archive_history().collect()] == ['{"n": 1}', '{"n": 2}']


def test_resample_reads_one_interval(spark):
    row = lambda t, n: (t, *[1.0] * 4, 1.0, t + n * 60_000 - 1, 1.0, 1, 1.0, 1.0)
    cols = "open_time bigint, open double, high double, low double, close double, volume double, close_time bigint, quote_volume double, num_trades bigint, taker_buy_base_vol double, taker_buy_quote_vol double"
    one = L.normalize(spark.createDataFrame([row(i * 60_000, 1) for i in range(60)], cols), venue="v", symbol="s", interval="1m")
    five = L.resample(one, "5m")
    assert L.resample(one.unionByName(five), "1h").first()["volume"] == 60
    assert L.resample(one.unionByName(five), "1h", "5m").first()["volume"] == 60
    for target, source in (("5m", "15m"), ("5m", "5m"), ("2h", "1m")):
        with pytest.raises(ValueError):
            L.resample(one, target, source)


def test_spread_is_relative(spark):
    tiny = spark.createDataFrame([(1e-15,), (3e-15,), (2e-15,)], "x double")
    flat = spark.createDataFrame([(0.1 + 0.2,), (0.3,)], "x double")
    ratio = lambda df: df.agg(mean_over_std(F.avg("x"), F.stddev_samp("x"))).first()[0]
    assert ratio(tiny) == pytest.approx(2.0) and ratio(flat) is None


def test_slot_registry(spark):
    reg = S.SlotRegistry(2)
    reg.assign(1, lib.momentum(1))
    with pytest.raises(ValueError):
        reg.assign(1, lib.momentum(2))
    reg.replace("signal_1", lib.momentum(2))
    assert reg.get(1).name == "mom_2"
    with pytest.raises(ValueError):
        reg.get(3)
    panel = bars(spark, 4, ["a", "b"], lambda i, j: 10.0 + i + j)
    got = reg.run(panel, vwap=2)
    assert got.columns == ["code", "trade_time", *P.FIELDS, "signal_1", "signal_2", "vwap"]
    assert got.where("signal_2 != -1").count() == 0
    reg.clear()
    assert reg.active() == {}


def test_output_rules(spark):
    panel = bars(spark, 3, ["a", "b"], lambda i, j: 10.0 + i + j)
    long = panel.select("trade_time", "code", F.col("close").alias("value"))
    assert S.normalize_output(panel, long).where("value = close").count() == 6
    with pytest.raises(ValueError):
        S.normalize_output(panel, long.withColumn("other", F.lit(1.0)).withColumnRenamed("value", "x"))
    with pytest.raises(ValueError):
        S.normalize_output(panel, long.withColumn("code", F.lit("zz")).dropDuplicates(["trade_time", "code"]))


@pytest.mark.parametrize(
    "raw, want", [("RlMomentum", "rl-momentum"), ("Abc_Def x!y", "abc--def-x-y"), ("ABC", "a-b-c"), ("--x--", "x")]
)
def test_kebab(spark, raw, want):
    assert spark.range(1).select(X.name_kebab(F.lit(raw)).alias("n")).first()["n"] == want


class FakeContext:
    def __init__(self, master, conf):
        self.master, self.conf, self.dir = master, conf, None

    def getConf(self):
        return self.conf

    def getCheckpointDir(self):
        return self.dir

    def setCheckpointDir(self, path):
        self.dir = path


class FakeSession:
    def __init__(self, master, conf):
        self.conf = {**conf}
        self.sparkContext = FakeContext(master, self.conf)


def test_shared_dir_comes_from_the_session():
    named = FakeSession("spark://host", {"spark.checkpoint.dir": "/shared/x"})
    assert shared_dir(named) == "/shared/x"
    with pytest.raises(ValueError):
        shared_dir(FakeSession("spark://host", {}))
    assert shared_dir(FakeSession("local[2]", {}))


def test_compaction_comes_to_an_end(spark):
    """Many days in several deliveries: after one pass nothing is left to do, also where a day takes several files."""
    cols = "open_time bigint, open double, high double, low double, close double, volume double, close_time bigint, quote_volume double, num_trades bigint, taker_buy_base_vol double, taker_buy_quote_vol double"
    rows = [(d * L.DAY_MS + m * 60_000, *[1.0] * 4, 1.0, 0, 1.0, 1, 1.0, 1.0) for d in range(20) for m in range(0, 1440, 30)]
    bars = L.normalize(spark.createDataFrame(rows, cols), venue="v", symbol="s", interval="1m").withColumn("ingest", F.lit(1))
    for per_file in (2_000_000, 10):
        path = f"{shared_dir(spark)}/compact-{np.random.default_rng().integers(1 << 40)}"
        for version in (1, 2, 3):
            L.write(bars, path, version)
        first = L.compact(spark, path, rows_per_file=per_file).collect()
        assert {r["status"] for r in first} == {"compacted"} and all(r["rows"] == 48 for r in first)
        assert all(r["written_files"] == 1 if per_file > 48 else 5 <= r["written_files"] <= 10 for r in first)
        assert {r["status"] for r in L.compact(spark, path, rows_per_file=per_file).collect()} == {"skip_small"}
        assert L.scan(spark, path).count() == len(rows)


def test_lake_query_is_a_hash_aggregate(spark):
    cols = ", ".join(f"{c} {'string' if c in (*L.SERIES, 'date') else 'bigint' if c in L.LONGS else 'double'}" for c in L.COLUMNS)
    lake = spark.createDataFrame([], cols + ", ingest bigint")
    plan = L.query(lake)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan
