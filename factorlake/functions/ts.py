"""Trailing time-series functions over a dense panel.

Every function is a plain Column over one shared window, so all functions used
at the same nesting level cost one exchange, one sort and one Window node.  The
window is `(code, seg)`: the panel is cut into calendar segments that carry
enough leading rows (`halo`) for the factor's lookback, so a long series is
spread over tasks and the result does not depend on the cut.
"""

import math

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from .numeric import div

SERIES = ["code", "seg"]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def series():
    return Window.partitionBy(*SERIES).orderBy("t")


def frame(n: int):
    return series().rowsBetween(-(n - 1), 0)


def _framed(agg, x, n: int, min_periods: int | None) -> Column:
    x, w = _c(x), frame(n)
    need = n if min_periods is None else min_periods
    return F.when(F.count(x).over(w) >= need, agg(x).over(w))


def ts_shift(x, k: int) -> Column:
    if k < 0:
        raise ValueError("a shift must not look ahead")
    return F.lag(_c(x), k).over(series()) if k else _c(x)


def ts_return(x, k: int = 1) -> Column:
    """x[t] / x[t-k] - 1, NULL where either side is missing.

    The dense panel holds no NaN or infinity, and factor columns are cleaned at the end.
    """
    return div(x, ts_shift(x, k)) - 1


def ts_diff(x, k: int = 1) -> Column:
    return _c(x) - ts_shift(x, k)


def ts_mean(x, n: int, min_periods: int | None = None) -> Column:
    return _framed(F.avg, x, n, min_periods)


def ts_sum(x, n: int, min_periods: int | None = None) -> Column:
    return _framed(F.sum, x, n, min_periods)


def ts_std(x, n: int, min_periods: int | None = None) -> Column:
    return _framed(F.stddev_samp, x, n, min_periods)


def ts_min(x, n: int, min_periods: int | None = None) -> Column:
    return _framed(F.min, x, n, min_periods)


def ts_max(x, n: int, min_periods: int | None = None) -> Column:
    return _framed(F.max, x, n, min_periods)


def ts_zscore(x, n: int, min_periods: int | None = None) -> Column:
    std = ts_std(x, n, min_periods)
    return F.when(std > 1e-12, (_c(x) - ts_mean(x, n, min_periods)) / std)


def ts_vwap(price, volume, n: int, min_periods: int = 1) -> Column:
    """Rolling volume-weighted price; the volume sum does not need a price."""
    return div(
        ts_sum(_c(price) * _c(volume), n, min_periods), ts_sum(volume, n, min_periods)
    )


def ewm_block(alpha: float, floor: float = 1e-16) -> int:
    """Rows after which an exponential weight is below `floor`."""
    return max(2, math.ceil(math.log(floor) / math.log(1 - alpha)))


def ts_ewm(x, alpha: float, floor: float = 1e-16) -> Column:
    """Exponentially weighted mean, adjusted form, at the slots that have a value; missing slots keep their age.

    Values scaled by (1-alpha)^-(t mod L) are summed up to now inside the block
    of L rows, and over the block before; beside a value of now, older rows weigh less
    than `floor`.  Linear in rows.  Lookback: 2 L.  A slot without a value has the
    mean of the last slot that has one, however long ago: `panel.ewm` fills it in.
    """
    x, size = _c(x), ewm_block(alpha, floor)
    blk = F.floor(F.col("t") / size)
    scale = F.when(x.isNotNull(), F.pow(F.lit(1 - alpha), -(F.col("t") % size).cast("double")))
    here = (
        Window.partitionBy(*SERIES, blk).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    )
    prior = Window.partitionBy(*SERIES).orderBy(blk).rangeBetween(-1, -1)
    fade = (1 - alpha) ** size

    def total(z):
        return F.coalesce(F.sum(z).over(here), F.lit(0.0)) + fade * F.coalesce(
            F.sum(z).over(prior), F.lit(0.0)
        )

    return F.when(x.isNotNull(), div(total(scale * x), total(scale)))


def ts_breakout(close, high, low, n: int) -> tuple[Column, Column]:
    """Close over the previous n-step high, and close under the previous n-step low, as ratios - 1."""
    before = series().rowsBetween(-n, -1)
    top = F.when(F.count(_c(high)).over(before) >= n, F.max(_c(high)).over(before))
    bottom = F.when(F.count(_c(low)).over(before) >= n, F.min(_c(low)).over(before))
    return div(close, top) - 1, div(close, bottom) - 1
