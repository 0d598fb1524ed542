"""A batch of candidate factors over the monthly panel, in Spark and SQL."""

from ..operators import ic
from ..operators import library_factors as lib
from . import views as V
from .registry import out
from .series import _framed, _ret, case_sql, pct_rank_sql

STEPS = (1, 2, 3, 6, 12)
NAMES = [f"mom_{k}" for k in STEPS] + [f"rev_{k}" for k in STEPS] + ["vol_6", "liq_6", "case_momentum_vol"]


def factors():
    return (
        [lib.momentum(k) for k in STEPS]
        + [lib.mean_reversion(k) for k in STEPS]
        + [lib.volatility(6), lib.liquidity(6), lib.case_momentum_vol()]
    )


def frame(spark, sf, shift: int = 0):
    return V.factor_frame(spark, sf, factors(), shift=shift)


def dates(spark, sf) -> int:
    return V.calendar(spark, sf).count()


def names(spark, sf) -> int:
    """Codes of the panel: no date has more names."""
    return V.codes(spark, sf).count()


def long(spark, sf, horizon: int = 1):
    return ic.labelled(frame(spark, sf), NAMES, horizon, dates(spark, sf))


def frame_sql() -> str:
    """CTEs ending in `frame` (wide, observed rows) and `cells` (adds the next return as label)."""
    moms = ", ".join(f"{_ret('close', k)} AS mom_{k}" for k in STEPS)
    case = case_sql(5, 20, 10)
    return f"""{V.dense_sql()}{case},
    moms AS (SELECT code, trade_time, {moms}, {_ret('close', 1)} AS ret1, {_framed('avg', 'amount', 6, 3)} AS liq_6
      FROM dense WINDOW w AS (PARTITION BY code ORDER BY trade_time)),
    vols AS (SELECT *, {_framed('stddev_samp', 'ret1', 6, 3)} AS vol_6 FROM moms),
    frame AS (SELECT f.code, f.trade_time, f.close, {", ".join(f"mom_{k}, -mom_{k} AS rev_{k}" for k in STEPS)},
      CASE WHEN abs(vol_6) >= 1e-12 THEN vol_6 END AS vol_6, liq_6, f.score AS case_momentum_vol
      FROM factor f JOIN vols v ON f.code = v.code AND f.trade_time = v.trade_time WHERE f.observed),
    cells AS (SELECT *, lead(close, 1) OVER (PARTITION BY code ORDER BY trade_time) / nullif(close, 0) - 1 AS label FROM frame)"""


def long_sql() -> str:
    """CTEs ending in `long(factor, code, trade_time, score, label)`, rows with both."""
    parts = " UNION ALL ".join(
        f"SELECT '{n}' AS factor, code, trade_time, CAST({n} AS DOUBLE) AS score, label FROM cells" for n in NAMES
    )
    return f"""{frame_sql()}, long AS (SELECT * FROM ({parts}) WHERE score IS NOT NULL AND label IS NOT NULL)"""


def rank_sql(x, part):
    return (
        f"(rank() OVER (PARTITION BY {part} ORDER BY {x}) "
        f"+ (count(*) OVER (PARTITION BY {part}, {x}) - 1) / 2.0)"
    )


def corr_sql(x, y):
    """Correlation, NULL where DuckDB gives NaN or a side is constant."""
    return f"CASE WHEN stddev_pop({x}) > 0 AND stddev_pop({y}) > 0 THEN covar_pop({x}, {y}) / (stddev_pop({x}) * stddev_pop({y})) END"


def rank_corr_sql(rx, ry):
    """Correlation of average ranks from whole sums: twice a rank is whole, with a mean of count + 1."""
    x, y, mean = f"CAST(2 * {rx} AS HUGEINT)", f"CAST(2 * {ry} AS HUGEINT)", "CAST(count(*) AS HUGEINT) * (count(*) + 1) * (count(*) + 1)"
    sxy, sxx, syy = (f"CAST(sum({a} * {b}) - {mean} AS DOUBLE)" for a, b in ((x, y), (x, x), (y, y)))
    return f"CASE WHEN {sxx} > 0 AND {syy} > 0 THEN {sxy} / sqrt({sxx} * {syy}) END"


def daily_sql(part="factor, trade_time", source="long", name="daily") -> str:
    return f"""{name}_r AS (SELECT *, {rank_sql('score', part)} AS rx, {rank_sql('label', part)} AS ry FROM {source}),
    {name} AS (SELECT {part}, {corr_sql('score', 'label')} AS ic, {rank_corr_sql('rx', 'ry')} AS rank_ic, count(*) AS names
      FROM {name}_r GROUP BY {part})"""


def icir_sql(x):
    return f"CASE WHEN stddev_samp({x}) >= 1e-12 THEN avg({x}) / stddev_samp({x}) END"


SUMMARY = {
    "daily_ic_mean": "avg(ic)",
    "daily_ic_std": "stddev_samp(ic)",
    "daily_rank_ic_mean": "avg(rank_ic)",
    "daily_rank_ic_std": "stddev_samp(rank_ic)",
    "icir": icir_sql("rank_ic"),
    "rank_icir": icir_sql("rank_ic"),
    "pearson_icir": icir_sql("ic"),
}


def summary_sql() -> str:
    counts = "count(ic) AS daily_ic_count, count(rank_ic) AS daily_rank_ic_count"
    return ", ".join(out(e, a) for a, e in SUMMARY.items()) + ", " + counts


def distribution_sql(x, prefix="") -> str:
    cells = {
        "mean": f"avg({x})",
        "std": f"stddev_samp({x})",
        "min": f"min({x})",
        "p05": f"quantile_cont({x}, 0.05)",
        "p25": f"quantile_cont({x}, 0.25)",
        "median": f"quantile_cont({x}, 0.5)",
        "p75": f"quantile_cont({x}, 0.75)",
        "p95": f"quantile_cont({x}, 0.95)",
        "max": f"max({x})",
        "positive_rate": f"avg(CASE WHEN {x} > 0 THEN 1.0 WHEN {x} <= 0 THEN 0.0 END)",
        "negative_rate": f"avg(CASE WHEN {x} < 0 THEN 1.0 WHEN {x} >= 0 THEN 0.0 END)",
        "zero_rate": f"avg(CASE WHEN {x} = 0 THEN 1.0 WHEN {x} <> 0 THEN 0.0 END)",
    }
    return f"count({x}) AS {prefix}count, " + ", ".join(out(e, prefix + a) for a, e in cells.items())
