"""Null-safe arithmetic. NaN and infinities are missing values, as in a pandas reduction."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# a deviation this small beside the mean is rounding, not spread
STD_FLOOR = 1e-12


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def nz(x) -> Column:
    """NaN, +inf and -inf become NULL."""
    x = _c(x).cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def div(a, b) -> Column:
    """Division that gives NULL, not an error, for a zero divisor."""
    return F.try_divide(_c(a).cast("double"), _c(b).cast("double"))


def spread(std, mean) -> Column:
    """The deviation, NULL where it is zero but for the rounding of values of this size."""
    return F.when((_c(std) > 0) & (_c(std) >= STD_FLOOR * F.abs(_c(mean))), _c(std))


def mean_over_std(mean, std) -> Column:
    """Information ratio; NULL without a spread."""
    return _c(mean) / spread(std, mean)


def safe_corr(x, y) -> Column:
    """Pearson correlation aggregate, NULL for a constant or single-row group."""
    x, y = _c(x), _c(y)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def rank_corr(rx, ry, most: int | None = None) -> Column:
    """Correlation aggregate of the average ranks of a group's rows, 1 to their number, NULL for a constant side.

    Twice a rank is whole, and its mean is the number of rows plus one, so all sums are whole: the result does
    not depend on the order of rows, and ranks without any relation give exactly 0. Up to `most` rows 64 bits hold the sums.
    """
    x, y = (2 * _c(r) for r in (rx, ry))
    kind = "bigint" if most is not None and most <= 1_000_000 else "decimal(19,0)"
    x, y, n = x.cast(kind), y.cast(kind), F.count(x).cast(kind)
    mean = n * (n + 1) * (n + 1)
    sxy, sxx, syy = ((F.sum(a * b) - mean).cast("double") for a, b in ((x, y), (x, x), (y, y)))
    return F.when((sxx > 0) & (syy > 0), sxy / F.sqrt(sxx * syy))


def rnd(x, digits: int = 6) -> Column:
    """Rounded for output; the added zero removes a negative zero."""
    return F.round(_c(x).cast("double"), digits) + F.lit(0.0)
