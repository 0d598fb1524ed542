"""Keyed state of streams against all bars so far, with a restart from the checkpoint between deliveries."""

import numpy as np
import pandas as pd
import pytest

from factorlake.streaming import bars as B
from factorlake.streaming import gaps as G

STEP = {"1m": 60_000, "1h": 3_600_000}
SCHEMA = "venue string, symbol string, `interval` string, open_time bigint"


def all_gaps(bars):
    out = set()
    for (venue, symbol, interval), part in bars.dropna().groupby(["venue", "symbol", "interval"]):
        if interval in STEP:
            t = np.unique(part["open_time"].to_numpy(dtype="int64"))
            out |= {(venue, symbol, interval, a + STEP[interval], b - STEP[interval]) for a, b in zip(t, t[1:]) if b - a > STEP[interval]}
    return out


def deliveries():
    """A hot series, times off the grid, two intervals of one symbol, repeated and late bars, and rows that are left out."""
    rng = np.random.default_rng(3)
    rows = [("v", "hot", "1m", int(t) * 60_000) for t in range(900) if rng.random() < 0.8]
    rows += [("v", "odd", "1m", int(t)) for t in rng.integers(0, 40 * 60_000, 60)]
    rows += [("v", s, "1h", int(t) * 3_600_000) for s in ("hot", "x") for t in rng.integers(0, 200, 70)]
    first = pd.DataFrame(rows, columns=["venue", "symbol", "interval", "open_time"])
    part = rng.integers(0, 3, len(first))
    fill = pd.DataFrame({"venue": "v", "symbol": "hot", "interval": "1m", "open_time": np.arange(-20, 700, dtype="int64") * 60_000})
    none = pd.DataFrame([("v", "hot", "1m", None), ("v", "hot", "9q", 5), ("v", "new", "1m", 0)], columns=first.columns)
    return [first[part == 0], pd.concat([first[part == 1], none]), pd.concat([first[part == 2], first[part == 0]]), fill]


def test_gap_state_equals_gaps_of_all_bars_so_far(spark, tmp_path):
    arrivals, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    seen = pd.DataFrame()
    for no, part in enumerate(deliveries()):
        part = part.astype({"open_time": "Int64"})
        rows = [(r.venue, r.symbol, r.interval, None if pd.isna(r.open_time) else int(r.open_time)) for r in part.itertuples()]
        spark.createDataFrame(rows, SCHEMA).repartition(4).write.mode("append").parquet(arrivals)
        B.drain(G.gap_alerts(B.read_files(spark, arrivals, SCHEMA), out, check))
        seen = pd.concat([seen, part])
        got = [tuple(r) for r in G.open_gaps(spark.read.parquet(out)).collect()]
        assert len(got) == len(set(got)) and set(got) == all_gaps(seen), f"delivery {no}"
    events = spark.read.parquet(out).toPandas()
    assert (events["event"] == "closed").any()
    assert not events.duplicated(["venue", "symbol", "interval", "gap_start", "gap_end", "event"]).any()


def test_gap_alerts_leave_the_session_as_it_was(spark, tmp_path):
    before = spark.conf.get(G.PROVIDER, None)
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "in"))
    B.drain(G.gap_alerts(B.read_files(spark, str(tmp_path / "in"), SCHEMA), str(tmp_path / "out"), str(tmp_path / "check")))
    assert spark.conf.get(G.PROVIDER, None) == before


@pytest.mark.parametrize("rows", [0, 1, 500])
def test_runs_hold_all_times(rows):
    rng = np.random.default_rng(rows)
    bars = pd.DataFrame({"venue": "v", "symbol": rng.choice(list("ab"), rows), "interval": "1m", "open_time": rng.integers(0, 400, rows) * 60_000})
    got = pd.concat(G.runs(iter([bars])))
    for symbol, part in bars.groupby("symbol"):
        mine = got[got["symbol"] == symbol].sort_values("first")
        covered = np.concatenate([np.arange(a, b + 1, 60_000) for a, b in zip(mine["first"], mine["last"])])
        assert sorted(covered) == sorted(set(part["open_time"]))
