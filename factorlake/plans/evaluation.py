"""Information-coefficient, layer and rank-correlation queries."""

from pyspark.sql import functions as F

from ..functions.numeric import rnd
from ..operators import corr, ic
from ..operators import panel as P
from ..session import materialize
from . import cands as C
from . import views as V
from .registry import out, query


def rounded(df, *skip, digits=6):
    """Doubles rounded for comparison, counts as bigint."""
    cols = []
    for n, t in df.dtypes:
        if n in skip:
            cols.append(F.col(n))
        elif t == "double":
            cols.append(rnd(n, digits).alias(n))
        else:
            cols.append(F.col(n).cast("bigint").alias(n) if t == "int" else F.col(n))
    return df.select(*cols)


@query(
    "forward_return",
    f"""WITH bars AS ({V.bars_sql("week")}) SELECT code, trade_time,
      {out("lead(close, 1) OVER w / nullif(close, 0) - 1", "return_1")},
      {out("lead(close, 5) OVER w / nullif(close, 0) - 1", "return_5")}
    FROM bars WINDOW w AS (PARTITION BY code ORDER BY trade_time)""",
)
def forward_return(spark, sf):
    n = V.calendar(spark, sf, "week").count()
    df = ic.forward_return(V.bars(spark, sf, "week"), 1, "return_1", n)
    df = ic.forward_return(df, 5, "return_5", n)
    return rounded(df.select("code", "trade_time", "return_1", "return_5"))


@query(
    "forward_return_blocks",
    f"""WITH bars AS ({V.bars_sql("week")}) SELECT code, trade_time,
      {out("lead(close, 5) OVER w / nullif(close, 0) - 1", "return_5")}
    FROM bars WINDOW w AS (PARTITION BY code ORDER BY trade_time)""",
)
def forward_return_blocks(spark, sf):
    df = ic.lead_by_number(V.bars(spark, sf, "week"), 5, "return_5", block="year")
    return rounded(df.select("code", "trade_time", "return_5"))


@query("pooled_ic", f"""{C.long_sql()}, {C.daily_sql("factor")}
    SELECT factor, {out("ic", "ic")}, {out("rank_ic", "rank_ic")}, names AS "rows" FROM daily""")
def pooled_ic(spark, sf):
    wide = ic.forward_return(C.frame(spark, sf), 1, "label", C.dates(spark, sf))
    return rounded(ic.pooled_ic_wide(materialize(wide.select(*P.KEYS, *C.NAMES, "label")), C.NAMES))


@query("daily_ic", f"""{C.long_sql()}, {C.daily_sql()}
    SELECT factor, trade_time, {out("ic", "ic")}, {out("rank_ic", "rank_ic")}, names FROM daily""")
def daily_ic(spark, sf):
    return rounded(ic.daily_ic(C.long(spark, sf), names=C.names(spark, sf)))


CASE_LONG = f"""{V.dense_sql()}""" + C.case_sql(5, 20, 10) + """,
    shifted AS (SELECT *, lag(score, 1) OVER (PARTITION BY code ORDER BY trade_time) AS lagged FROM factor),
    cells AS (SELECT *, lead(close, 1) OVER (PARTITION BY code ORDER BY trade_time) / nullif(close, 0) - 1 AS label
      FROM shifted WHERE observed),
    long AS (SELECT 'case_momentum_vol' AS factor, code, trade_time, lagged AS score, label FROM cells
      WHERE lagged IS NOT NULL AND label IS NOT NULL)"""


@query("ic_summary", f"""{CASE_LONG}, {C.daily_sql()} SELECT factor, {C.summary_sql()} FROM daily GROUP BY factor""")
def ic_summary(spark, sf):
    """Bars, factor, one-step shift, forward return, daily rank IC, summary."""
    frame = V.factor_frame(spark, sf, [C.lib.case_momentum_vol()], shift=1)
    long = ic.labelled(frame, ["case_momentum_vol"], 1, C.dates(spark, sf))
    return rounded(ic.ic_summary(ic.daily_ic(long, names=C.names(spark, sf))))


@query("ic_distribution", f"""{C.long_sql()}, {C.daily_sql()}
    SELECT factor, {C.distribution_sql("rank_ic")} FROM daily GROUP BY factor""")
def ic_distribution(spark, sf):
    return rounded(ic.ic_distribution(ic.daily_ic(C.long(spark, sf), names=C.names(spark, sf))))


def layer_sql(part="factor, trade_time"):
    return f"""sized AS (SELECT *, count(*) OVER (PARTITION BY {part}) AS n,
      row_number() OVER (PARTITION BY {part} ORDER BY score DESC, code) AS r FROM long),
    layers AS (SELECT *, CASE WHEN n >= 10 THEN greatest(1, ((r - 1) * 10 + n - 2) // (n - 1)) END AS layer FROM sized)"""


@query("decile_layer", f"""{C.long_sql()}, {layer_sql()}
    SELECT factor, trade_time, code, layer FROM layers""")
def decile_layer(spark, sf):
    return rounded(ic.decile_layer(C.long(spark, sf), names=C.names(spark, sf)).select("factor", "trade_time", "code", "layer"))


LAYERED = f"""{layer_sql()}, cut AS (SELECT * FROM layers WHERE layer IS NOT NULL),
    {C.daily_sql("factor, layer, trade_time", "cut", "byday")},
    sums AS (SELECT factor, layer, {C.summary_sql()}, CAST(sum(names) AS BIGINT) AS "rows" FROM byday GROUP BY factor, layer),
    slots AS (SELECT factor, i AS layer FROM (SELECT DISTINCT factor FROM long), range(1, 11) AS g(i)),
    layered AS (SELECT s.factor, 'Decile' || s.layer AS layer_name, daily_ic_mean, daily_ic_std, daily_rank_ic_mean,
      daily_rank_ic_std, icir, rank_icir, pearson_icir, coalesce(daily_ic_count, 0) AS daily_ic_count,
      coalesce(daily_rank_ic_count, 0) AS daily_rank_ic_count, coalesce("rows", 0) AS "rows"
      FROM slots s LEFT JOIN sums ON s.factor = sums.factor AND s.layer = sums.layer)"""


@query("layered_ic", f"""{C.long_sql()}, {LAYERED} SELECT * FROM layered""")
def layered_ic(spark, sf):
    return rounded(ic.layered_ic(C.long(spark, sf), names=C.names(spark, sf)))


@query("layer_diagnostics", f"""{C.long_sql()}, thin AS (SELECT * FROM long WHERE NOT (factor = 'mom_12' AND CAST(code AS BIGINT) % 10 > 0)),
    d AS (SELECT factor, trade_time, count(*) AS n FROM thin GROUP BY ALL)
    SELECT f.factor, CAST(coalesce(sum(n), 0) AS BIGINT) AS joined_rows, CAST(coalesce(sum(n) FILTER (n >= 10), 0) AS BIGINT) AS layered_rows,
      CAST(coalesce(sum(n) FILTER (n < 10), 0) AS BIGINT) AS unlayered_rows, count(n) AS dates, count(n) FILTER (n < 10) AS thin_dates,
      CASE WHEN count(n) = 0 THEN 'no non-null score/label rows' WHEN count(*) FILTER (n >= 10) = 0 THEN 'no date has 10 names with score and label' END AS reason
    FROM (SELECT unnest({[*C.NAMES, "absent"]}) AS factor) f LEFT JOIN d USING (factor) GROUP BY f.factor""")
def layer_diagnostics(spark, sf):
    """One factor is known for a tenth of the codes only, one has no row."""
    thin = C.long(spark, sf).where("NOT (factor = 'mom_12' AND CAST(code AS BIGINT) % 10 > 0)")
    return ic.layer_diagnostics(thin, [*C.NAMES, "absent"])


@query("coverage", C.frame_sql() + " " + " UNION ALL ".join(
    f"SELECT '{n}' AS factor, {out(f'avg(CASE WHEN {n} IS NULL THEN 0.0 ELSE 1.0 END)', 'coverage')}, "
    f"{out(f'avg(CASE WHEN {n} IS NULL THEN 1.0 ELSE 0.0 END)', 'missing_rate')} FROM frame" for n in C.NAMES))
def coverage(spark, sf):
    return rounded(ic.coverage(C.frame(spark, sf), C.NAMES))


PRED = "(close - avg(close) OVER (PARTITION BY code))"


@query("prediction_ic", f"""{C.frame_sql()},
    label AS (SELECT code, trade_time, label FROM cells WHERE label IS NOT NULL),
    long AS (SELECT 'pred' AS factor, code, trade_time, label, case_momentum_vol AS score FROM cells
      WHERE label IS NOT NULL AND case_momentum_vol IS NOT NULL),
    {C.daily_sql()}, {C.daily_sql("factor", name="total")}
    SELECT (SELECT count(*) FROM label) AS test_label_rows, (SELECT count(*) FROM long) AS joined_rows,
      (SELECT count(DISTINCT score) FROM long) AS prediction_unique, (SELECT count(DISTINCT label) FROM long) AS label_unique,
      {out("avg(rank_ic)", "daily_rank_ic_mean")}, {out("stddev_samp(rank_ic)", "daily_rank_ic_std")},
      count(rank_ic) AS daily_ic_count, {out("(SELECT rank_ic FROM total)", "rank_ic")}, {out(C.icir_sql("rank_ic"), "icir")},
      CAST(NULL AS VARCHAR) AS nan_reason FROM daily""")
def prediction_ic(spark, sf):
    frame = C.frame(spark, sf)
    label = ic.forward_return(frame, 1, "label", C.dates(spark, sf)).where("label IS NOT NULL")
    pred = frame.select(*P.KEYS, F.col("case_momentum_vol").alias("score"))
    return rounded(ic.prediction_ic(label.select(*P.KEYS, "label"), pred, C.names(spark, sf)))


def pairs_sql(names, source="frame"):
    """CTEs ending in `pairs(left, right, n, spearman)` on shared rows."""
    parts = " UNION ALL ".join(
        f"SELECT '{a}' AS l, '{b}' AS r, CAST({a} AS DOUBLE) AS x, CAST({b} AS DOUBLE) AS y FROM {source} "
        f"WHERE {a} IS NOT NULL AND {b} IS NOT NULL"
        for i, a in enumerate(names)
        for b in names[i + 1 :]
    )
    return f"""both_rows AS ({parts}),
    both_ranks AS (SELECT l, r, {C.rank_sql('x', 'l, r')} AS rx, {C.rank_sql('y', 'l, r')} AS ry FROM both_rows),
    pairs AS (SELECT l, r, count(*) AS n, CASE WHEN count(*) >= 2 THEN {C.rank_corr_sql('rx', 'ry')} END AS spearman
      FROM both_ranks GROUP BY l, r)"""


@query("pair_spearman", f"""{C.frame_sql()}, {pairs_sql(C.NAMES)}
    SELECT l AS "left", r AS "right", n, {out("spearman", "spearman")} FROM pairs""")
def pair_spearman(spark, sf):
    return rounded(corr.spearman_matrix(C.frame(spark, sf), C.NAMES))


MATRIX = ["mom_1", "mom_6", "vol_6", "liq_6", "case_momentum_vol"]


@query("factor_corr_matrix", f"""{C.frame_sql()}, {pairs_sql(MATRIX)}
    SELECT l AS "left", r AS "right", {out("spearman", "spearman")} FROM pairs
    UNION ALL SELECT r, l, {out("spearman", "spearman")} FROM pairs
    UNION ALL SELECT v, v, 1.0::DOUBLE FROM (VALUES {", ".join(f"('{m}')" for m in MATRIX)}) AS g(v)""")
def factor_corr_matrix(spark, sf):
    return rounded(corr.factor_corr_matrix(C.frame(spark, sf), MATRIX))


@query("pair_join", f"""{C.frame_sql()} SELECT trade_time, code, {out("mom_1", "left_score")}, {out("mom_6", "right_score")}
    FROM frame WHERE mom_1 IS NOT NULL AND mom_6 IS NOT NULL""")
def pair_join(spark, sf):
    frame = C.frame(spark, sf)
    left = frame.select(*P.KEYS, F.col("mom_1").alias("score"))
    right = frame.select(*P.KEYS, F.col("mom_6").alias("score"))
    return rounded(corr.pair_join(left, right))


@query("pred_label_join", f"""{C.frame_sql()} SELECT trade_time, code, {out("label", "label")}, {out("vol_6", "pred")}
    FROM cells WHERE label IS NOT NULL AND vol_6 IS NOT NULL""")
def pred_label_join(spark, sf):
    frame = C.frame(spark, sf)
    label = ic.forward_return(frame, 1, "label", C.dates(spark, sf)).select(*P.KEYS, "label")
    pred = frame.select(*P.KEYS, F.col("vol_6").alias("pred"))
    return rounded(label.join(pred, P.KEYS, "left").dropna(subset=["label", "pred"]))


@query("frame_summary", f"""{C.frame_sql()} SELECT count(*) AS "rows", count(DISTINCT code) AS instruments, min(trade_time) AS start, max(trade_time) AS "end" FROM frame""")
def frame_summary(spark, sf):
    return ic.frame_summary(C.frame(spark, sf))


@query("layers_in_blocks", f"""{C.long_sql()}, {LAYERED} SELECT factor, layer_name, daily_rank_ic_mean, "rows" FROM layered""")
def layers_in_blocks(spark, sf):
    """The way for dates with more names than a task may hold."""
    got = ic.layered_ic(C.long(spark, sf), names=ic.NAMES + 1)
    return rounded(got.select("factor", "layer_name", "daily_rank_ic_mean", "rows"))


@query("factor_analyze", f"""{C.long_sql()}, {C.daily_sql()}, {C.daily_sql("factor", name="total")}, {LAYERED},
    cov AS ({" UNION ALL ".join(f"SELECT '{n}' AS factor, avg(CASE WHEN {n} IS NULL THEN 0.0 ELSE 1.0 END) AS coverage FROM frame" for n in C.NAMES)}),
    byfactor AS (SELECT factor, {C.summary_sql()}, {C.distribution_sql("ic", "ic_")}, {C.distribution_sql("rank_ic", "rank_ic_")}
      FROM daily GROUP BY factor)
    SELECT byfactor.*, {out("total.ic", "ic")}, {out("total.rank_ic", "rank_ic")}, total.names AS joined_rows,
      {out("coverage", "coverage")}, {out("1 - coverage", "missing_rate")},
      (SELECT CAST(sum("rows") AS BIGINT) FROM layered WHERE layered.factor = byfactor.factor) AS layered_rows,
      {", ".join(f"l{i}.daily_rank_ic_mean AS decile{i}_rank_ic, l{i}.rows AS decile{i}_rows" for i in (1, 5, 10))}
    FROM byfactor JOIN total USING (factor) JOIN cov USING (factor)
    {" ".join(f"JOIN layered l{i} ON l{i}.factor = byfactor.factor AND l{i}.layer_name = 'Decile{i}'" for i in (1, 5, 10))}""")
def factor_analyze(spark, sf):
    rec = ic.factor_analyze(C.frame(spark, sf), C.NAMES, dates=C.dates(spark, sf), names=C.names(spark, sf))
    flat = [c for c in rec.columns if c not in ("ic_distribution", "rank_ic_distribution", "deciles")]
    cols = [F.col(c) for c in flat]
    for p in ("ic", "rank_ic"):
        cols += [
            F.col(f"{p}_distribution.{n}").alias(f"{p}_{n}")
            for n in rec.schema[f"{p}_distribution"].dataType.names
        ]
    for i in (1, 5, 10):
        layer = F.col("deciles")[f"Decile{i}"]
        cols += [
            layer["daily_rank_ic_mean"].alias(f"decile{i}_rank_ic"),
            layer["rows"].alias(f"decile{i}_rows"),
        ]
    return rounded(rec.select(*cols))
