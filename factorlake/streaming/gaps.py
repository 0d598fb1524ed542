"""Gaps of bar series as keyed state: what is open now, and which late bars close."""

from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources import lake as L
from .bars import versioned_sink

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EVENTS = "venue string, symbol string, `interval` string, gap_start bigint, gap_end bigint, event string"
RUNS = "venue string, symbol string, `interval` string, first bigint, last bigint"


def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Bars to stretches of a series without a gap, so that a hot series is combined before it moves."""
    for bars in batches:
        bars = bars[bars["interval"].isin(L.INTERVAL_MS)].dropna(subset=["open_time"])
        bars = bars.sort_values([*L.SERIES, "open_time"])
        other = (bars[L.SERIES] != bars[L.SERIES].shift()).any(axis=1)
        step = bars["interval"].map(L.INTERVAL_MS)
        run = (other | (bars["open_time"].diff() > step)).cumsum()
        of = {c: (c, "first") for c in L.SERIES}
        yield bars.groupby(run).agg(**of, first=("open_time", "min"), last=("open_time", "max")).astype({"first": "int64", "last": "int64"})


class Gaps(StatefulProcessor):
    """State of a series: its first and last time, and a row per open gap (the times before and behind it).

    After every batch the open gaps are those between all bars so far. A late bar closes the gap it falls into and
    opens what is left on either side; a late bar before the first one may open a gap behind it.
    """

    def __init__(self, keep_ms: int | None = None):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ends = handle.getValueState("ends", "first bigint, last bigint")
        self.open = handle.getMapState("open", "before bigint", "behind bigint", self.keep_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        step = L.INTERVAL_MS[key[L.SERIES.index("interval")]]
        events: list[tuple] = []
        first, last = self.ends.get() if self.ends.exists() else (None, None)
        starts, behind = None, {}

        def put(a: int, b: int) -> None:
            if b - a > step:
                self.open.updateValue((a,), (b,))
                events.append((*key, a + step, b - step, "open"))
                if starts is not None:
                    insort(starts, a)
                    behind[a] = b

        stretches = sorted((int(a), int(b)) for part in rows for a, b in zip(part["first"], part["last"]))
        for a, b in stretches:
            if first is None:
                first, last = a, b
            elif a > last:
                put(last, a)
            elif b < first:
                put(b, first)
            else:
                if starts is None:
                    behind = {k[0]: v[0] for k, v in self.open.iterator()}
                    starts = sorted(behind)
                # gaps do not overlap, so only the one that begins before the stretch may reach into it
                at = max(bisect_left(starts, a) - 1, 0)
                hit = [p for p in starts[at : bisect_left(starts, b)] if behind[p] > a]
                for p in hit:
                    n = behind.pop(p)
                    del starts[bisect_left(starts, p)]
                    self.open.removeKey((p,))
                    events.append((*key, p + step, n - step, "closed"))
                    put(p, a)
                    put(b, n)
            first, last = min(first, a), max(last, b)
        if first is not None:
            self.ends.update((first, last))
        if events:
            yield pd.DataFrame(events, columns=[*L.SERIES, "gap_start", "gap_end", "event"])

    def close(self) -> None:
        pass


def gap_events(bars: DataFrame, keep_ms: int | None = None) -> DataFrame:
    """(series, gap_start, gap_end, event) of a stream of bars: `open` for a gap that is seen, `closed` for one that bars fall into.

    A closed gap is followed by `open` rows for what is left of it. Only the state of the series in a batch is touched.
    With `keep_ms` an open gap is forgotten so long after it was seen; later bars inside it then give no row.
    Bars without a time or with an unknown interval are left out.
    """
    stretches = bars.select(*L.SERIES, F.col("open_time").cast("bigint").alias("open_time")).mapInPandas(runs, RUNS)
    return stretches.groupBy(*L.SERIES).transformWithStateInPandas(
        Gaps(keep_ms), EVENTS, "Append", "ProcessingTime" if keep_ms else "None"
    )


def gap_alerts(bars: DataFrame, path: str, checkpoint: str, keep_ms: int | None = None):
    """Starts the events of a stream into a versioned sink; the state is kept by RocksDB, whatever the session's choice."""
    conf = bars.sparkSession.conf
    before = conf.get(PROVIDER, None)
    conf.set(PROVIDER, ROCKSDB)
    try:
        return versioned_sink(gap_events(bars, keep_ms), path, checkpoint, mode="append")
    finally:
        conf.set(PROVIDER, before) if before else conf.unset(PROVIDER)


def open_gaps(events: DataFrame) -> DataFrame:
    """The gaps that are open after all events: a gap that was closed never opens again with the same ends."""
    keys = [*L.SERIES, "gap_start", "gap_end"]
    return events.groupBy(*keys).agg(F.bool_or(F.col("event") == "closed").alias("closed")).where("NOT closed").select(*keys)
