"""Per-code research queries."""

from pyspark.sql import functions as F

from ..functions.numeric import rnd
from ..functions.scan import numbered
from ..operators import corr, ic
from ..operators import library_factors as lib
from ..operators import panel as P
from ..operators import research as R
from ..session import materialize
from . import cands as C
from . import views as V
from .evaluation import pairs_sql, rounded
from .registry import out, query
from .series import _ret

MOM = f"""{V.dense_sql("week")}, f AS (SELECT code, trade_time, t, observed, close, volume, {_ret("close", 3)} AS x FROM dense
      WINDOW w AS (PARTITION BY code ORDER BY trade_time)),
    panel AS (SELECT * FROM f WHERE observed)"""
PAIRS = f"""{MOM}, known AS (SELECT * FROM panel WHERE x IS NOT NULL AND close IS NOT NULL),
    labelled AS (SELECT *, lead(close) OVER (PARTITION BY code ORDER BY trade_time) / nullif(close, 0) - 1 AS y FROM known),
    pairs_ AS (SELECT code, trade_time, x, y, row_number() OVER (PARTITION BY code ORDER BY trade_time) AS no FROM labelled WHERE y IS NOT NULL)"""
ROLLED = f"""{PAIRS}, joined AS (SELECT a.code, a.no, a.trade_time AS tt, b.x, b.y FROM pairs_ a JOIN pairs_ b ON a.code = b.code AND b.no > a.no - 60 AND b.no <= a.no WHERE a.no >= 60),
    rr AS (SELECT *, {C.rank_sql("x", "code, no")} AS rx, {C.rank_sql("y", "code, no")} AS ry FROM joined),
    roll AS (SELECT code, no, any_value(tt) AS trade_time, {C.rank_corr_sql("rx", "ry")} AS rank_ic FROM rr GROUP BY 1, 2)"""


def _panel(spark, sf):
    frame = V.factor_frame(spark, sf, [lib.momentum(3, "x")], unit="week")
    return frame.select(*P.KEYS, "close", "volume", "x")


def _dates(spark, sf):
    return V.calendar(spark, sf, "week").count()


def _pairs(spark, sf, dates=None):
    known = _panel(spark, sf).dropna(subset=["x", "close"])
    return ic.forward_return(known, 1, "y", dates or _dates(spark, sf)).dropna(subset=["y"])


@query("rolling_rank_ic", f"{ROLLED} SELECT code, trade_time, {out('rank_ic', 'rank_ic')} FROM roll")
def rolling_rank_ic(spark, sf):
    n = _dates(spark, sf)
    return rounded(R.rolling_rank_ic(_pairs(spark, sf, n), 60, dates=n).select("code", "trade_time", "rank_ic"))


@query("rolling_rank_ic_chunks", f"{ROLLED} SELECT code, trade_time, {out('rank_ic', 'rank_ic')} FROM roll")
def rolling_rank_ic_chunks(spark, sf):
    """The same with series cut into chunks of 100 rows."""
    got = R.rolling_rank_ic(materialize(_pairs(spark, sf)), 60, dates=None, segment=100)
    return rounded(got.select("code", "trade_time", "rank_ic"))


@query("rank_ic_single", f"""{ROLLED}, per AS (SELECT code, avg(rank_ic) AS m, stddev_samp(rank_ic) AS s, count(rank_ic) AS k FROM roll GROUP BY 1),
    fr AS (SELECT code, {C.rank_sql("x", "code")} AS rx, {C.rank_sql("y", "code")} AS ry FROM pairs_),
    full_ AS (SELECT code, {C.rank_corr_sql("rx", "ry")} AS r, count(*) AS n FROM fr GROUP BY 1)
    SELECT c.code, {out("CASE WHEN n >= 60 THEN r END", "rank_ic")}, {out("CASE WHEN k >= 2 THEN m END", "ic_mean")}, {out("CASE WHEN k >= 2 THEN s END", "ic_std")},
      {out("CASE WHEN k >= 2 AND s >= 1e-12 THEN m / s END", "icir")} FROM (SELECT DISTINCT code FROM panel) c LEFT JOIN full_ USING (code) LEFT JOIN per USING (code)""")
def rank_ic_single(spark, sf):
    panel = materialize(_panel(spark, sf))
    return rounded(R.rank_ic_single(panel, "x", 1, 60, _dates(spark, sf)))


@query("rolling_pair_join", f"""{PAIRS} SELECT a.code, a.no AS window_no, count(*) AS members, {out("sum(b.x)", "sum_x")} FROM pairs_ a JOIN pairs_ b
    ON a.code = b.code AND b.no > a.no - 60 AND b.no <= a.no GROUP BY 1, 2""")
def rolling_pair_join(spark, sf):
    """Trailing windows joined to their members, then aggregated."""
    no = numbered(_pairs(spark, sf).select("code", "trade_time", "x"), ["code"], ["trade_time"])
    got = R.rolling_pairs(no, 60).groupBy("code", "window_no")
    return rounded(got.agg(F.count("*").alias("members"), F.sum("x").alias("sum_x")))


@query("describe_signal", f"""{MOM} SELECT code, count(x) AS count, {out("avg(x)", "mean")}, {out("stddev_samp(x)", "std")}, {out("min(x)", "min")},
    {out("quantile_cont(x, 0.25)", "p25")}, {out("quantile_cont(x, 0.5)", "p50")}, {out("quantile_cont(x, 0.75)", "p75")}, {out("max(x)", "max")}
    FROM panel WHERE x IS NOT NULL GROUP BY 1""")
def describe_signal(spark, sf):
    return rounded(R.describe(materialize(_panel(spark, sf)), "x"))


@query("bar_seconds", """WITH d AS (SELECT DISTINCT event_type AS code, date_trunc('minute', ts) AS t FROM events),
    s AS (SELECT code, epoch(t) - epoch(lag(t) OVER (PARTITION BY code ORDER BY t)) AS gap FROM d)
    SELECT code, CAST(floor(quantile_cont(CAST(gap AS DOUBLE), 0.5)) AS BIGINT) AS bar_seconds FROM s WHERE gap > 0 GROUP BY 1""")
def bar_seconds(spark, sf):
    rows = V.table(spark, sf, "events").select(F.col("event_type").alias("code"), V.trunc("minute", "ts").alias("trade_time"))
    return R.bar_seconds(rows.distinct())


@query("eval_frame", f"""{MOM}, p AS (SELECT code, trade_time, x, CASE WHEN count(close) OVER q >= 4 THEN avg(close) OVER q END AS price FROM panel
      WINDOW q AS (PARTITION BY code ORDER BY trade_time ROWS BETWEEN 3 PRECEDING AND CURRENT ROW))
    SELECT code, trade_time, {out("lag(x) OVER w", "x")}, {out("lead(price, 5) OVER w / nullif(price, 0) - 1", "ret")} FROM p WINDOW w AS (PARTITION BY code ORDER BY trade_time)""")
def eval_frame(spark, sf):
    return rounded(R.eval_frame(_panel(spark, sf), ["x"], 5, smooth=4, dates=_dates(spark, sf)).select("code", "trade_time", "x", "ret"))


@query("eval_frame_daily", f"""WITH e AS (SELECT event_type AS code, ts, value, user_id::DOUBLE AS sig FROM events),
    d AS (SELECT code, date_trunc('day', ts) AS trade_time, arg_max(value, ts) AS price, arg_max(sig, ts) AS sig FROM e GROUP BY 1, 2)
    SELECT code, trade_time, lag(sig) OVER w AS sig, {out("lead(price, 2) OVER w / nullif(price, 0) - 1", "ret")} FROM d WINDOW w AS (PARTITION BY code ORDER BY trade_time)""")
def eval_frame_daily(spark, sf):
    """A horizon of two days in one-minute bars switches to daily rows."""
    ticks = V.table(spark, sf, "events").select(
        F.col("event_type").alias("code"), F.col("ts").alias("trade_time"), F.col("value").alias("close"), F.col("user_id").cast("double").alias("sig")
    )
    got = R.eval_frame(ticks, ["sig"], 2880)
    return got.select("code", "trade_time", "sig", rnd("ret").alias("ret"))


NAMES = ["mom_1", "vol_6", "liq_6"]


@query("corr_matrix_pearson", f"{C.frame_sql()}, full_ AS (SELECT * FROM frame WHERE mom_1 IS NOT NULL AND vol_6 IS NOT NULL AND liq_6 IS NOT NULL) " + " UNION ALL ".join(
    f"""SELECT '{a}' AS "left", '{b}' AS "right", {out(f"covar_pop({a}, {b}) / (stddev_pop({a}) * stddev_pop({b}))", "corr")} FROM full_""" for a in NAMES for b in NAMES))
def corr_matrix_pearson(spark, sf):
    return rounded(corr.corr_matrix_pearson(C.frame(spark, sf), NAMES))


@query("corr_matrix_spearman", f"""{C.frame_sql()}, full_ AS (SELECT * FROM frame WHERE mom_1 IS NOT NULL AND vol_6 IS NOT NULL AND liq_6 IS NOT NULL),
    {pairs_sql(NAMES, "full_")} SELECT l AS "left", r AS "right", {out("spearman", "spearman")} FROM pairs
    UNION ALL SELECT r, l, {out("spearman", "spearman")} FROM pairs UNION ALL SELECT v, v, 1.0::DOUBLE FROM (VALUES {", ".join(f"('{m}')" for m in NAMES)}) AS g(v)""")
def corr_matrix_spearman(spark, sf):
    return rounded(corr.factor_corr_matrix(C.frame(spark, sf).dropna(subset=NAMES), NAMES))


HORIZONS = (1, 3, 6)


@query("ic_curve", f"""{C.frame_sql()}, lagged AS (SELECT code, trade_time, close, {", ".join(f"lag({n}) OVER w AS {n}, " for n in ("mom_1", "vol_6"))}
      {", ".join(f"lead(close, {h}) OVER w / nullif(close, 0) - 1 AS r{h}" for h in HORIZONS)} FROM frame WINDOW w AS (PARTITION BY code ORDER BY trade_time)),
    rows_ AS ({" UNION ALL ".join(f"SELECT code, {h} AS horizon, '{n}' AS signal, {n} AS x, r{h} AS y FROM lagged WHERE mom_1 IS NOT NULL AND vol_6 IS NOT NULL AND r{h} IS NOT NULL" for h in HORIZONS for n in ("mom_1", "vol_6"))}),
    rr AS (SELECT *, {C.rank_sql("x", "code, horizon, signal")} AS rx, {C.rank_sql("y", "code, horizon, signal")} AS ry FROM rows_)
    SELECT code, CAST(horizon AS BIGINT) AS horizon, signal, {out(C.rank_corr_sql("rx", "ry"), "ic")} FROM rr GROUP BY 1, 2, 3""".replace(", ,", ",").replace(",  ,", ","))
def ic_curve(spark, sf):
    return rounded(R.ic_curve(C.frame(spark, sf).select(*P.KEYS, "close", "mom_1", "vol_6"), ["mom_1", "vol_6"], HORIZONS, C.dates(spark, sf)))


@query("bucket_test", f"""{PAIRS}, n AS (SELECT *, count(*) OVER (PARTITION BY code) AS n, row_number() OVER (PARTITION BY code ORDER BY x, trade_time) AS r FROM pairs_),
    ok AS (SELECT code FROM pairs_ GROUP BY 1 HAVING count(DISTINCT x) >= 5)
    SELECT code, greatest(1, ((r - 1) * 5 + n - 2) // (n - 1)) - 1 AS bucket, {out("avg(y)", "mean_return")}, count(*) AS n FROM n JOIN ok USING (code) GROUP BY 1, 2""")
def bucket_test(spark, sf):
    n = _dates(spark, sf)
    return rounded(R.bucket_test(_pairs(spark, sf, n), dates=n))


@query("rolling_ic", f"""{PAIRS} SELECT code, trade_time, {out("CASE WHEN count(x) OVER q >= 12 AND stddev_pop(x) OVER q > 0 AND stddev_pop(y) OVER q > 0 THEN covar_pop(x, y) OVER q / (stddev_pop(x) OVER q * stddev_pop(y) OVER q) END", "ic")}
    FROM pairs_ WINDOW q AS (PARTITION BY code ORDER BY trade_time ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)""")
def rolling_ic(spark, sf):
    n = _dates(spark, sf)
    return rounded(R.rolling_ic(_pairs(spark, sf, n), 12, dates=n).select("code", "trade_time", "ic"))


@query("hit_rate", f"""{MOM}, m AS (SELECT code, trade_time, x, CASE WHEN count(close) OVER q >= 20 THEN avg(close) OVER q END AS ma FROM panel
      WINDOW q AS (PARTITION BY code ORDER BY trade_time ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
    r AS (SELECT *, lead(ma) OVER (PARTITION BY code ORDER BY trade_time) / nullif(ma, 0) - 1 AS r FROM m)
    SELECT code, {out("avg(CASE WHEN sign(x) = sign(r) THEN 1.0 ELSE 0.0 END)", "hit_rate")}, count(*) AS n FROM r WHERE r IS NOT NULL AND x IS NOT NULL AND x <> 0 GROUP BY 1""")
def hit_rate(spark, sf):
    return rounded(R.hit_rate(_panel(spark, sf), "x", dates=_dates(spark, sf)))


