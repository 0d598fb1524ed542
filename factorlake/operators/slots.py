"""Factor slots, user functions over pandas, and evaluation callables."""

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ts
from ..functions.numeric import nz
from .panel import FIELDS, KEYS, SEGMENT, Factor, attach_factor, compute_factors, densify, require

EMPTY = -1


def slot_names(columns: Sequence[str]) -> list[str]:
    """Columns called signal_<n>, by n."""
    found = [c for c in columns if c.startswith("signal_") and c[7:].isdigit()]
    return sorted(found, key=lambda c: int(c[7:]))


def fill_slots(df: DataFrame, slots: Sequence[str]) -> DataFrame:
    """Every slot present; an absent slot or missing value is -1."""
    return df.withColumns(
        {s: F.coalesce(nz(s), F.lit(float(EMPTY))) if s in df.columns else F.lit(float(EMPTY)) for s in slots}
    )


def order_columns(df: DataFrame, slots: Sequence[str]) -> DataFrame:
    """Base fields, slots, other columns, vwap last."""
    base = ["code", "trade_time", *FIELDS]
    other = [c for c in df.columns if c not in {*base, *slots, "vwap"}]
    return df.select(*base, *slots, *other, *(["vwap"] if "vwap" in df.columns else []))


class SlotRegistry:
    """A fixed number of slots, each empty or holding a factor."""

    def __init__(self, size: int = 5):
        if not isinstance(size, int) or size <= 0:
            raise ValueError("size must be a positive integer")
        self.held: dict[str, Factor | None] = {f"signal_{i}": None for i in range(1, size + 1)}

    def _name(self, slot: str | int) -> str:
        name = f"signal_{slot}" if isinstance(slot, int) else slot
        if name not in self.held:
            raise ValueError(f"no such slot: {slot}")
        return name

    def assign(self, slot: str | int, factor: Factor, overwrite: bool = False) -> None:
        name = self._name(slot)
        if not isinstance(factor, Factor):
            raise TypeError("a slot holds a Factor")
        if self.held[name] is not None and not overwrite:
            raise ValueError(f"{name} is taken")
        self.held[name] = factor

    def replace(self, slot: str | int, factor: Factor) -> None:
        self.assign(slot, factor, overwrite=True)

    def remove(self, slot: str | int) -> None:
        self.held[self._name(slot)] = None

    def get(self, slot: str | int) -> Factor | None:
        return self.held[self._name(slot)]

    def clear(self) -> None:
        self.held = dict.fromkeys(self.held)

    def active(self) -> dict[str, Factor]:
        return {s: f for s, f in self.held.items() if f is not None}

    def run(self, bars: DataFrame, vwap: int | None = 20, **lists) -> DataFrame:
        """All slots in one pass over the panel, with an optional rolling vwap.

        A factor in two slots is computed once.
        """
        active = self.active()
        wanted = {f.name: f for f in active.values()}
        factors = list(wanted.values())
        if vwap:
            factors.append(
                Factor("vwap", lambda: [{"vwap": ts.ts_vwap("close", "volume", vwap)}], vwap - 1)
            )
        frame = compute_factors(bars, factors, score="_score", **lists) if factors else bars
        slots = [F.col(f.name).alias(s) for s, f in active.items()]
        kept = frame.select(*KEYS, *FIELDS, *slots, *(["vwap"] if vwap else []))
        return order_columns(fill_slots(kept, list(self.held)), list(self.held))


def ts_udf(
    bars: DataFrame,
    fn: Callable[[pd.DataFrame], pd.Series],
    name: str,
    lookback: int,
    segment: int = SEGMENT,
    **lists,
) -> DataFrame:
    """Arbitrary pandas per code over the dense calendar, for what no Column can say.

    `fn` gets one code's rows in time order and returns a value per row.  A call
    holds one segment with its leading rows, never a longer series, so `fn` may
    look back at most `lookback` rows.
    """
    dense = densify(bars, lookback=lookback, segment=segment, **lists)
    schema = f"code string, trade_time timestamp_ntz, observed boolean, halo boolean, `{name}` double"

    def values(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pdf[["code", "trade_time", "observed", "halo"]].copy()
        cuts = [*np.flatnonzero(pdf.pop("_no") == 1), len(pdf)]
        parts = (pdf.iloc[i:j].reset_index(drop=True) for i, j in zip(cuts, cuts[1:], strict=False))
        out[name] = np.concatenate([pd.Series(fn(p), index=p.index).astype(float) for p in parts])
        return out

    def run(batches):
        held = []
        for pdf in batches:
            starts = np.flatnonzero(pdf["_no"] == 1)
            if len(starts):
                # the last series of a batch may go on in the next one
                held.append(pdf.iloc[: starts[-1]])
                if sum(map(len, held)):
                    yield values(pd.concat(held, ignore_index=True))
                held = []
                pdf = pdf.iloc[starts[-1] :]
            held.append(pdf)
        if sum(map(len, held)):
            yield values(pd.concat(held, ignore_index=True))

    # the window puts a series into one task, in time order; many short series share a batch
    got = dense.withColumn("_no", F.row_number().over(ts.series())).mapInPandas(run, schema)
    return got.where(F.col("observed") & ~F.col("halo")).select(*KEYS, nz(name).alias(name))


def cs_udf(frame: DataFrame, fn: Callable[[pd.DataFrame], pd.Series], name: str) -> DataFrame:
    """Arbitrary pandas per date over the names of that date."""
    schema = f"trade_time timestamp_ntz, code string, `{name}` double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pdf[["trade_time", "code"]].copy()
        out[name] = pd.Series(fn(pdf), index=pdf.index).astype(float)
        return out

    got = frame.groupBy("trade_time").applyInPandas(run, schema)
    return got.withColumn(name, nz(name))


def normalize_output(panel: DataFrame, output: DataFrame, value: str | None = None) -> DataFrame:
    """A factor's output, long or wide, aligned to the panel's rows.

    Long output has (trade_time, code, value); anything else with trade_time is
    wide, one column per code.  No overlap with the panel raises.
    """
    require(output, ["trade_time"])
    if "code" in output.columns:
        rest = [c for c in output.columns if c not in KEYS]
        col = value if value in rest else "score" if "score" in rest else rest[0] if len(rest) == 1 else None
        if col is None:
            raise ValueError("long output needs exactly one value column")
        long = output.select(F.col("trade_time").cast("timestamp_ntz").alias("trade_time"), F.col("code").cast("string").alias("code"), nz(col).alias("value"))
    else:
        names = [c for c in output.columns if c != "trade_time"]
        long = output.select(
            F.col("trade_time").cast("timestamp_ntz").alias("trade_time"), *[nz(c).alias(c) for c in names]
        ).unpivot(["trade_time"], names, "code", "value")
    if long.groupBy(*KEYS).count().where("count > 1").limit(1).count():
        raise ValueError("output has a (time, code) twice")
    if not long.join(panel.select(*KEYS), KEYS, "left_semi").limit(1).count():
        raise ValueError("output has no overlap with the panel")
    return attach_factor(panel, long, "value")


def evaluate_signals(panel: DataFrame, metrics: Sequence[Callable[[DataFrame, str], Sequence[Column]]]) -> DataFrame:
    """User metrics per slot: each callable gives aggregate Columns for one slot; one row per slot."""
    require(panel, [*KEYS, *FIELDS])
    slots = slot_names(panel.columns)
    if not slots:
        raise ValueError("no signal columns")
    long = panel.unpivot([*KEYS, *FIELDS], slots, "slot", "signal")
    return long.groupBy("slot").agg(*[c for m in metrics for c in m(long, "signal")])


def evaluate_strategy(
    trades: DataFrame,
    fills: DataFrame,
    trade_analysis: Callable[[DataFrame], DataFrame],
    fill_analysis: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """User analyses of both logs as rows (part, metric, value)."""
    parts = []
    for part, df in (("trades", trade_analysis(trades)), ("fills", fill_analysis(fills))):
        cols = [c for c, t in df.dtypes if t in ("double", "bigint", "int", "float")]
        rows = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot([], cols, "metric", "value")
        parts.append(rows.select(F.lit(part).alias("part"), "metric", "value"))
    return parts[0].unionByName(parts[1])
