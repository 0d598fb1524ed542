"""Screens, reviews, duplicates, composite, gate, out-of-sample and store queries."""

import uuid

from pyspark.sql import functions as F

from ..functions.scan import numbered
from ..operators import admission, corr, decide, ic
from ..operators import composite as K
from ..operators import panel as P
from ..session import materialize, shared_dir
from ..sources import store as S
from . import cands as C
from . import views as V
from .evaluation import pairs_sql, rounded
from .registry import out, query

FINITE = "CASE WHEN isfinite({0}) THEN {0} END"


def _paths_sql():
    val = lambda p: FINITE.format(f"try_cast(json_extract_string(doc, '$.{p}') AS DOUBLE)")
    return {p: val(p) for p in decide.IC_METRICS}


@query("json_metric_extract", f"""WITH d AS ({V.METRIC_DOCS_SQL}) SELECT event_id,
    {", ".join(f"{e} AS {p.replace('.', '_')}" for p, e in _paths_sql().items())} FROM d""")
def json_metric_extract(spark, sf):
    df = V.metric_docs(spark, sf)
    return df.select("event_id", *[decide.json_metric("doc", p).alias(p.replace(".", "_")) for p in decide.IC_METRICS])


@query("metric_choose", f"""WITH d AS ({V.METRIC_DOCS_SQL}),
    v AS (SELECT event_id, {", ".join(f"{e} AS v{i}" for i, e in enumerate(_paths_sql().values()))} FROM d)
    SELECT event_id, coalesce(v0, v1, v2, v3, v4) AS ic, CASE
      {" ".join(f"WHEN v{i} IS NOT NULL THEN '{p}'" for i, p in enumerate(decide.IC_METRICS))} ELSE '' END AS ic_name FROM v""")
def metric_choose(spark, sf):
    df = V.metric_docs(spark, sf)
    value, name = decide.choose_metric({p: decide.json_metric("doc", p) for p in decide.IC_METRICS})
    return df.select("event_id", value.alias("ic"), name.alias("ic_name"))


@query("fast_screen", f"""WITH l AS ({V.LEDGER_SQL}) SELECT candidate_index, ic FROM l WHERE ic > 0.01""")
def fast_screen(spark, sf):
    return V.ledger(spark, sf).where(decide.passes_screen(F.col("ic"))).select("candidate_index", "ic")


@query("ic_sign_status", f"""WITH l AS ({V.LEDGER_SQL}) SELECT candidate_index, CASE WHEN ic IS NULL THEN 'MissingIC'
    WHEN ic < 0 THEN 'NegativeRankICRequiresReverse' WHEN ic = 0 THEN 'NonPositiveIC' WHEN ic <= 0.01 THEN 'LowRankIC'
    ELSE 'ok' END AS status FROM l""")
def ic_sign_status(spark, sf):
    return V.ledger(spark, sf).select("candidate_index", decide.ic_status(F.col("ic")).alias("status"))


@query("review_metrics", f"""WITH l AS ({V.LEDGER_SQL}), m AS (SELECT candidate_index, error_type IS NULL AS runs_ok,
      1 - k / 300.0 AS coverage, k / 300.0 AS missing_rate, ic, ic * 3 AS icir, k AS ic_count, k % 4 AS layers FROM l),
    c AS (SELECT candidate_index, runs_ok AS c1, coverage >= 0.8 AS c2, missing_rate <= 0.2 AS c3,
      coalesce(ic > 0, false) AS c4, coalesce(icir > 0, false) AS c5, ic_count > 0 AS c6, layers > 0 AS c7 FROM m),
    f AS (SELECT candidate_index, list_filter([CASE WHEN NOT c1 THEN 'runs_without_error' END, CASE WHEN NOT c2 THEN 'coverage_ok' END,
      CASE WHEN NOT c3 THEN 'missing_rate_ok' END, CASE WHEN NOT c4 THEN 'rank_ic_ok' END, CASE WHEN NOT c5 THEN 'icir_ok' END,
      CASE WHEN NOT c6 THEN 'sample_count_ok' END, CASE WHEN NOT c7 THEN 'decile_layer_ok' END], lambda x: x IS NOT NULL) AS failed FROM c)
    SELECT candidate_index, array_to_string(failed, ',') AS failed_checks,
      CASE WHEN len(failed) = 0 THEN 'accepted' ELSE 'rejected' END AS verdict FROM f""")
def review_metrics(spark, sf):
    m = V.ledger(spark, sf).select(
        "candidate_index",
        F.col("error_type").isNull().alias("runs_ok"),
        (1 - F.col("k") / 300).alias("coverage"),
        (F.col("k") / 300).alias("missing_rate"),
        "ic",
        (F.col("ic") * 3).alias("icir"),
        F.col("k").alias("ic_count"),
        (F.col("k") % 4).alias("layers"),
    )
    return decide.review(m, F.col("layers")).select(
        "candidate_index", F.array_join("failed_checks", ",").alias("failed_checks"), "verdict"
    )


BEST_SQL = f"""WITH l AS ({V.LEDGER_SQL}), b AS (SELECT round, arg_max(candidate_index, (ic, -candidate_index)) AS best
      FROM l WHERE ok GROUP BY round),
    labelled AS (SELECT l.* EXCLUDE (label), CASE WHEN NOT ok THEN 'failed' WHEN candidate_index = best THEN 'best'
      ELSE 'average' END AS label FROM l LEFT JOIN b USING (round))"""


@query("label_candidates", f"{BEST_SQL} SELECT candidate_index, CAST(round AS BIGINT) AS round, label FROM labelled")
def label_candidates(spark, sf):
    return rounded(decide.label_candidates(V.ledger(spark, sf)).select("candidate_index", "round", "label"))


REASONS = f"""WITH l AS ({V.LEDGER_SQL}) SELECT candidate_index, CASE label WHEN 'duplicate' THEN 'duplicate'
    WHEN 'average' THEN 'factor_not_good' ELSE CASE WHEN error_type IS NOT NULL THEN 'error' ELSE 'factor_not_good' END END AS reason,
    CASE label WHEN 'duplicate' THEN 'duplicate of Cand' || (candidate_index - 1) || '; correlation=' || printf('%.6f', 0.98 + k / 10000.0)
      WHEN 'average' THEN 'valid factor, but weaker than the round best' ELSE
      CASE WHEN error_type IS NOT NULL THEN error_type || ': ' || error ELSE 'rank IC <= 0.01' END END AS detail FROM l"""


@query("failure_reason", REASONS)
def failure_reason(spark, sf):
    df = V.ledger(spark, sf)
    c = F.col
    dup = c("label") == "duplicate"
    of = F.when(dup, F.concat(F.lit("Cand"), c("candidate_index") - 1))
    rho = F.when(dup, 0.98 + c("k") / 10000)
    return df.select(
        "candidate_index",
        decide.failure_reason(c("label"), c("error_type"), c("error"), c("ic"), c("ok")).alias("reason"),
        decide.failure_detail(c("label"), c("error_type"), c("error"), c("ic"), of, rho).alias("detail"),
    )


@query("failure_detail", f"SELECT reason, count(*) AS n, max(detail) AS sample FROM ({REASONS}) GROUP BY reason")
def failure_detail(spark, sf):
    return failure_reason(spark, sf).groupBy("reason").agg(F.count("*").alias("n"), F.max("detail").alias("sample"))


@query("candidate_rank", f"""WITH l AS ({V.LEDGER_SQL}) SELECT CAST(round AS BIGINT) AS round, candidate_index, ic,
    row_number() OVER (PARTITION BY round ORDER BY ic DESC, candidate_index) AS no FROM l WHERE ok""")
def candidate_rank(spark, sf):
    usable = V.ledger(spark, sf).where("ok").select("round", "candidate_index", "ic")
    return rounded(numbered(usable, ["round"], [F.desc("ic"), F.asc("candidate_index")]), "ic")


def metrics_sql():
    return f"""{C.long_sql()}, {C.daily_sql()}, metrics AS (SELECT factor, avg(rank_ic) AS ic FROM daily GROUP BY factor)"""


def _wide(spark, sf):
    """Materialised factor frame and the daily rank IC of each factor."""
    frame = materialize(C.frame(spark, sf))
    wide = ic.forward_return(frame, 1, "label", C.dates(spark, sf))
    daily = ic.daily_ic_wide(wide, C.NAMES, C.names(spark, sf))
    return frame, daily.groupBy("factor").agg(F.avg("rank_ic").alias("ic"))


RANKING = """ranking AS (SELECT factor, ic, row_number() OVER (ORDER BY ic DESC, factor) AS pos FROM metrics WHERE ic IS NOT NULL),
    sym AS (SELECT l, r, spearman FROM pairs UNION ALL SELECT r, l, spearman FROM pairs)"""


@query("batch_dedup", f"""{metrics_sql()}, {pairs_sql(C.NAMES)}, {RANKING},
    walk(pos, kept) AS (SELECT CAST(1 AS BIGINT), [factor] FROM ranking WHERE pos = 1
      UNION ALL SELECT w.pos + 1, CASE WHEN EXISTS (SELECT 1 FROM sym s WHERE s.l = n.factor AND list_contains(w.kept, s.r)
        AND abs(s.spearman) >= 0.98) THEN w.kept ELSE list_append(w.kept, n.factor) END
      FROM walk w JOIN ranking n ON n.pos = w.pos + 1),
    final AS (SELECT kept FROM walk ORDER BY pos DESC LIMIT 1),
    hit AS (SELECT r.factor, arg_min(s.r, b.pos) AS dedup_of, arg_min(s.spearman, b.pos) AS spearman
      FROM ranking r CROSS JOIN final f JOIN sym s ON s.l = r.factor AND abs(s.spearman) >= 0.98 AND list_contains(f.kept, s.r)
      JOIN ranking b ON b.factor = s.r AND b.pos < r.pos WHERE NOT list_contains(f.kept, r.factor) GROUP BY 1)
    SELECT r.factor, r.pos, list_contains(f.kept, r.factor) AS kept, h.dedup_of, {out("h.spearman", "spearman")}
    FROM ranking r CROSS JOIN final f LEFT JOIN hit h ON h.factor = r.factor""")
def batch_dedup(spark, sf):
    frame, metrics = _wide(spark, sf)
    ranking = numbered(metrics.where("ic IS NOT NULL"), [], [F.desc("ic"), F.asc("factor")], "pos")
    close = corr.close_pairs(frame, C.NAMES, corr.BATCH_DUPLICATE, stored=True).pairs
    return rounded(corr.dedup_batch(ranking.select("factor", "pos"), close))


LIB = ["mom_1", "mom_3", "rev_6", "vol_6", "liq_6"]
CAND = [n for n in C.NAMES if n not in LIB]


def _lists(names):
    return ", ".join(f"'{n}'" for n in names)


MATCHES = f"""matches AS (SELECT s.l AS candidate, s.r AS factor, s.spearman, abs(s.spearman) AS abs_spearman, m.ic AS existing_ic,
      row_number() OVER (PARTITION BY s.l ORDER BY round(abs(s.spearman), 9) DESC, s.r) AS nearness, abs(s.spearman) >= 0.95 AS high
    FROM sym s JOIN metrics m ON m.factor = s.r
    WHERE s.l IN ({_lists(CAND)}) AND s.r IN ({_lists(LIB)}) AND s.spearman IS NOT NULL)"""


def _matches(spark, sf, near: bool = False):
    """Candidates, and their correlations with the library: all of them, or those past the threshold."""
    frame, metrics = _wide(spark, sf)
    metrics = materialize(metrics)
    asked = [(c, f) for c in CAND for f in LIB]
    if near:
        pairs = corr.close_pairs(frame, C.NAMES, corr.LIBRARY_DUPLICATE, pairs=asked, stored=True).pairs
    else:
        pairs = corr.spearman_matrix(frame, C.NAMES, pairs=asked, stored=True)
    cand = metrics.where(F.col("factor").isin(CAND))
    return cand, corr.library_corr(pairs, cand, metrics.where(F.col("factor").isin(LIB)))


@query("library_corr", f"""{metrics_sql()}, {pairs_sql(C.NAMES)}, {RANKING}, {MATCHES}
    SELECT candidate, factor, {out("spearman", "spearman")}, {out("abs_spearman", "abs_spearman")},
    {out("existing_ic", "existing_ic")}, nearness, high FROM matches""")
def library_corr(spark, sf):
    return rounded(_matches(spark, sf)[1])


@query("replace_or_block", f"""{metrics_sql()}, {pairs_sql(C.NAMES)}, {RANKING}, {MATCHES},
    per AS (SELECT m.candidate, count(*) FILTER (WHERE c.ic > m.existing_ic) AS replaceable,
      count(*) FILTER (WHERE NOT (c.ic > m.existing_ic)) AS blocking
      FROM matches m JOIN metrics c ON c.factor = m.candidate WHERE high GROUP BY 1)
    SELECT c.factor AS candidate, {out("c.ic", "candidate_ic")}, coalesce(replaceable, 0) AS replaceable,
      coalesce(blocking, 0) AS blocking, CASE WHEN blocking > 0 THEN 'rejected' WHEN replaceable > 0 THEN 'replacement_candidate'
      ELSE 'accepted' END AS verdict FROM metrics c LEFT JOIN per ON per.candidate = c.factor WHERE c.factor IN ({_lists(CAND)})""")
def replace_or_block(spark, sf):
    cand, matches = _matches(spark, sf, near=True)
    return rounded(corr.replace_or_block(cand, matches))


# composite

CELLS = " UNION ALL ".join(
    f"SELECT '{n}' AS factor, code, trade_time, CAST({n} AS DOUBLE) AS score, close FROM frame WHERE {n} IS NOT NULL"
    for n in C.NAMES
)
RANK_SQL = C.pct_rank_sql("score", "factor, trade_time") + " - 0.5"


def composite_sql(weights="weights", part=""):
    """CTEs ranked and composite(part, trade_time, code, score, close) for a table of weights with ord."""
    p = f"{part}, " if part else ""
    return f"""scores AS ({CELLS}), ranked AS (SELECT *, {RANK_SQL} AS rank FROM scores),
    composite AS (SELECT {p}trade_time, code, sum(weight * rank) / nullif(sum(abs(weight)), 0) AS score, arg_min(close, ord) AS close
      FROM ranked JOIN {weights} USING (factor) GROUP BY {p}trade_time, code HAVING sum(abs(weight)) > 0)"""


WEIGHTS = "weights AS (SELECT factor, ic AS weight, row_number() OVER (ORDER BY factor) AS ord FROM metrics WHERE ic > 0.01)"


def _scores(frame):
    return P.melt(frame, C.NAMES).where("score IS NOT NULL")


def _of(weights, scores):
    """Scores of the factors that have a weight: ranks are taken inside a factor, so the others' never meet them."""
    return scores.join(F.broadcast(weights.select("factor").distinct()), "factor", "left_semi")


@query("composite_rank", f"""{C.frame_sql()}, scores AS ({CELLS})
    SELECT factor, code, trade_time, {out(RANK_SQL, "rank")} FROM scores""")
def composite_rank(spark, sf):
    ranked = K.composite_rank(_scores(C.frame(spark, sf)), C.names(spark, sf))
    return rounded(ranked.select("factor", "code", "trade_time", "rank"))


def _components(spark, sf):
    frame, metrics = _wide(spark, sf)
    return frame, K.components(metrics)


@query("composite_weights", f"""{metrics_sql()}, {WEIGHTS}
    SELECT factor, {out("weight", "weight")}, {out("weight / sum(abs(weight)) OVER ()", "normalized")} FROM weights""")
def composite_weights(spark, sf):
    return rounded(K.normalized_weights(materialize(_components(spark, sf)[1])))


@query("composite_score", f"""{metrics_sql()}, {WEIGHTS}, {composite_sql()}
    SELECT trade_time, code, {out("score", "score")} FROM composite""")
def composite_score(spark, sf):
    frame, weights = _components(spark, sf)
    weights = materialize(K.with_order(weights))
    comp = K.composite_score(K.composite_rank(_of(weights, _scores(frame)), C.names(spark, sf)), weights)
    return rounded(comp.select("trade_time", "code", "score"))


@query("composite_build", f"""{metrics_sql()}, {WEIGHTS}, {composite_sql()},
    labelled AS (SELECT *, lead(close, 1) OVER (PARTITION BY code ORDER BY trade_time) / nullif(close, 0) - 1 AS label FROM composite),
    rows_ AS (SELECT * FROM labelled WHERE label IS NOT NULL), {C.daily_sql("trade_time", "rows_", "cday")}
    SELECT {out("avg(rank_ic)", "rank_ic")}, count(rank_ic) AS days, (SELECT count(*) FROM composite) AS score_rows,
      (SELECT count(*) FROM weights) AS component_count FROM cday""")
def composite_build(spark, sf):
    frame, weights = _components(spark, sf)
    weights = materialize(weights)
    comp = K.composite_score(K.composite_rank(_of(weights, _scores(frame)), C.names(spark, sf)), K.with_order(weights))
    comp = materialize(comp)
    ics = K.composite_ic(comp, dates=C.dates(spark, sf), names=C.names(spark, sf)).withColumn("k", F.lit(1))
    sizes = comp.agg(F.count("*").alias("score_rows")).withColumn("k", F.lit(1))
    count = weights.agg(F.count("*").alias("component_count")).withColumn("k", F.lit(1))
    return rounded(ics.join(sizes, "k").join(count, "k").drop("k"))


@query("attach_close", f"""{metrics_sql()}, {WEIGHTS}, {composite_sql()} SELECT trade_time, code, close FROM composite""")
def attach_close(spark, sf):
    frame, weights = _components(spark, sf)
    comp = K.composite_score(K.composite_rank(_scores(frame), C.names(spark, sf)), K.with_order(weights))
    return comp.select("trade_time", "code", "close")


@query("components_align", f"""{C.frame_sql()}, scores AS ({CELLS})
    SELECT trade_time, code, count(*) AS present, {out("max(score) FILTER (WHERE factor = 'mom_1')", "mom_1")},
    {out("max(score) FILTER (WHERE factor = 'vol_6')", "vol_6")} FROM scores GROUP BY 1, 2""")
def components_align(spark, sf):
    """Full outer alignment of all series as one long union and one aggregation."""
    scores = _scores(C.frame(spark, sf))
    return rounded(
        scores.groupBy(*P.KEYS).agg(
            F.count("*").alias("present"),
            *[F.max(F.when(F.col("factor") == n, F.col("score"))).alias(n) for n in ("mom_1", "vol_6")],
        )
    )


GATE = f"""{metrics_sql()}, good AS (SELECT factor, ic AS weight, row_number() OVER (ORDER BY ic DESC, factor) AS pos
      FROM metrics WHERE ic > 0.01),
    sets AS (SELECT 'baseline' AS scenario, factor, weight FROM good WHERE pos NOT IN (1)
      UNION ALL SELECT 'with_candidate', factor, weight FROM good WHERE pos <> 2),
    weights AS (SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY factor) AS ord FROM sets), {composite_sql(part="scenario")},
    labelled AS (SELECT *, lead(close, 1) OVER (PARTITION BY scenario, code ORDER BY trade_time) / nullif(close, 0) - 1 AS label FROM composite),
    rows_ AS (SELECT * FROM labelled WHERE label IS NOT NULL), {C.daily_sql("scenario, trade_time", "rows_", "cday")},
    ics AS (SELECT scenario, avg(rank_ic) AS v FROM cday GROUP BY 1),
    d AS (SELECT max(v) FILTER (WHERE scenario = 'baseline') AS b, max(v) FILTER (WHERE scenario <> 'baseline') AS w FROM ics)"""


@query("marginal_gate", f"""{GATE} SELECT {out("b", "baseline_rank_ic")}, {out("w", "with_candidate_rank_ic")},
    {out("w - b", "delta_rank_ic")}, w - b >= 0 AS passed, (SELECT count(*) FROM sets WHERE scenario = 'baseline') AS baseline_count,
    (SELECT count(*) FROM sets WHERE scenario <> 'baseline') AS with_candidate_count,
    CASE WHEN w - b >= 0 THEN 'accepted' ELSE 'rejected' END AS verdict,
    CASE WHEN w - b >= 0 THEN 'candidate improves or preserves composite rank IC'
      ELSE 'candidate reduces composite rank IC' END AS reason FROM d""")
def marginal_gate(spark, sf):
    """The best factor as candidate, replacing the second best of the library."""
    frame, weights = _components(spark, sf)
    ranked = materialize(numbered(weights, [], [F.desc("weight"), F.asc("factor")], "pos"))
    gate = K.marginal_gate(
        _scores(frame),
        ranked.where("pos > 1"),
        ranked.where("pos = 1"),
        ranked.where("pos = 2").select("factor"),
        dates=C.dates(spark, sf),
        names=C.names(spark, sf),
    )
    return rounded(gate)


@query("component_replace", f"""{metrics_sql()}, good AS (SELECT factor, ic AS weight, row_number() OVER (ORDER BY ic DESC, factor) AS pos
    FROM metrics WHERE ic > 0.01) SELECT factor, {out("weight", "weight")} FROM good WHERE pos <> 2""")
def component_replace(spark, sf):
    _, weights = _components(spark, sf)
    ranked = materialize(numbered(weights, [], [F.desc("weight"), F.asc("factor")], "pos"))
    lib = ranked.where("pos > 1").select("factor", "weight")
    new = ranked.where("pos = 1").select("factor", "weight")
    return rounded(K.replace_components(lib, ranked.where("pos = 2").select("factor"), new))


@query("admit_candidates")
def admit_candidates(spark, sf):
    names = ["case_momentum_vol", "mom_1", "rev_1", "rev_3", "rev_12", "mom_12", "vol_6", "liq_6"]
    return rounded(admission.admit_candidates(C.frame(spark, sf), names, dates=C.dates(spark, sf)))


OOS = ("1999-01-01", "2000-01-01", "2000-12-31")


def _oos_bars_sql():
    return V.dense_sql().replace(
        "GROUP BY 1, 2", f"GROUP BY 1, 2 HAVING date_trunc('month', min(l_shipdate)) BETWEEN '{OOS[0]}' AND '{OOS[2]}'", 1
    )


@query("oos_composite", f"""{_oos_bars_sql()},
    step AS (SELECT *, {C._ret("close", 3)} AS mom_3, {C._ret("close", 1)} AS ret1, {C._framed("avg", "amount", 6, 3)} AS liq_6
      FROM dense WINDOW w AS (PARTITION BY code ORDER BY trade_time)),
    scores AS (SELECT 'liq_6' AS factor, code, trade_time, liq_6 AS score FROM step WHERE observed AND liq_6 IS NOT NULL AND trade_time >= '{OOS[1]}'
      UNION ALL SELECT 'mom_3', code, trade_time, mom_3 FROM step WHERE observed AND mom_3 IS NOT NULL AND trade_time >= '{OOS[1]}'),
    ranked AS (SELECT *, {RANK_SQL} AS rank, CASE factor WHEN 'liq_6' THEN 0.04 ELSE 0.02 END AS weight FROM scores)
    SELECT trade_time, code, {out("sum(weight * rank) / sum(abs(weight))", "score")} FROM ranked GROUP BY 1, 2""")
def oos_composite(spark, sf):
    """Accepted factors recomputed from the warm-up start, trimmed, rebuilt."""
    warm, start, stop = OOS
    lib = C.lib
    ranged = lambda df: df.where(
        F.col("trade_time").between(F.lit(warm).cast("timestamp_ntz"), F.lit(stop).cast("timestamp_ntz"))
    )
    frame = P.compute_factors(
        ranged(V.bars(spark, sf)),
        [lib.liquidity(6), lib.momentum(3)],
        times=ranged(V.calendar(spark, sf)),
        codes=ranged(V.bars(spark, sf)).select("code").distinct(),
    )
    scores = P.melt(K.oos_trim(frame, start), ["liq_6", "mom_3"])
    weights = spark.createDataFrame([("liq_6", 0.04, 1), ("mom_3", 0.02, 2)], "factor string, weight double, ord int")
    comp = K.composite_score(K.composite_rank(scores, C.names(spark, sf)), weights)
    return rounded(comp.select("trade_time", "code", "score"))


@query("oos_period", """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS in_sample_end, CAST(o_orderdate AS DATE) + 1 AS start,
    CAST((CAST(o_orderdate AS DATE) + 1) + INTERVAL 12 MONTH AS DATE) - 1 AS stop,
    CAST((CAST(o_orderdate AS DATE) + 1) - INTERVAL 12 MONTH AS DATE) AS warmup,
    date_diff('day', CAST((CAST(o_orderdate AS DATE) + 1) - INTERVAL 12 MONTH AS DATE), CAST(o_orderdate AS DATE) + 1) AS warmup_days
    FROM orders""")
def oos_period(spark, sf):
    end = F.to_date("o_orderdate")
    start, stop, warm, days = K.oos_period(end)
    return V.table(spark, sf, "orders").select(
        "o_orderkey",
        end.alias("in_sample_end"),
        start.alias("start"),
        stop.alias("stop"),
        warm.alias("warmup"),
        days.cast("bigint").alias("warmup_days"),
    )


@query("oos_window", """WITH c AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, CAST(o_orderkey % 60 AS INTEGER) AS k FROM orders),
    g AS (SELECT *, CASE WHEN k % 4 = 1 THEN d + (10 + k) END AS start_in, CASE WHEN k % 4 < 2 THEN d + (k - 20) END AS stop_in,
      CASE WHEN k % 3 = 0 THEN d + (k - 30) END AS warm_in FROM c),
    s AS (SELECT *, coalesce(start_in, d + 1) AS start FROM g),
    w AS (SELECT *, coalesce(stop_in, CAST(start + INTERVAL 12 MONTH AS DATE) - 1) AS stop, coalesce(warm_in, CAST(start - INTERVAL 12 MONTH AS DATE)) AS warmup FROM s)
    SELECT o_orderkey, d AS in_sample_end, start, stop, warmup, date_diff('day', warmup, start) AS warmup_days,
      CASE WHEN start_in IS NULL THEN 'default' ELSE 'configured' END AS start_source, CASE WHEN stop_in IS NULL THEN 'default' ELSE 'configured' END AS stop_source,
      CASE WHEN warm_in IS NULL THEN 'default' ELSE 'configured' END AS warmup_source,
      CASE WHEN start > stop THEN 'start is after the end' WHEN warmup > start THEN 'warm-up begins after the start' END AS problem FROM w""")
def oos_window(spark, sf):
    """Windows of which some dates are given, some of them in the wrong order."""
    end, k = F.to_date("o_orderdate"), (F.col("o_orderkey") % 60).cast("int")
    given = (F.when(k % 4 == 1, F.date_add(end, 10 + k)), F.when(k % 4 < 2, F.date_add(end, k - 20)), F.when(k % 3 == 0, F.date_add(end, k - 30)))
    return V.table(spark, sf, "orders").select("o_orderkey", *[c.alias(n) for n, c in K.oos_window(end, *given).items()])


@query("oos_trim", f"""{V.dense_sql("week")}, f AS (SELECT code, trade_time, {C._ret("close", 5)} AS mom_5 FROM dense WHERE true
    WINDOW w AS (PARTITION BY code ORDER BY trade_time))
    SELECT code, trade_time, {out("mom_5", "mom_5")} FROM f WHERE trade_time >= '2000-01-01'""")
def oos_trim(spark, sf):
    frame = V.factor_frame(spark, sf, [C.lib.momentum(5)], unit="week", dense_rows=True)
    return rounded(K.oos_trim(frame, "2000-01-01").select("code", "trade_time", "mom_5"))


@query("train_valid_test_split", f"""WITH bars AS ({V.bars_sql()}), s AS (SELECT code, trade_time, close, CAST(trade_time AS DATE) AS d FROM bars),
    e AS (SELECT DATE '1996-01-01' AS a, DATE '2000-12-31' AS b, date_diff('day', DATE '1996-01-01', DATE '2000-12-31') + 1 AS n),
    c AS (SELECT a, b, a + CAST(floor(n * 0.6) AS INTEGER) AS x, a + CAST(floor(n * 0.8) AS INTEGER) AS y FROM e)
    SELECT code, trade_time, close, 'train' AS segment FROM s, c WHERE d BETWEEN a AND x
    UNION ALL SELECT code, trade_time, close, 'valid' FROM s, c WHERE d BETWEEN x AND y
    UNION ALL SELECT code, trade_time, close, 'test' FROM s, c WHERE d BETWEEN y AND b""")
def train_valid_test_split(spark, sf):
    cut = K.train_valid_test(V.bars(spark, sf), "1996-01-01", "2000-12-31")
    return cut.select("code", "trade_time", "close", "segment")


# factor store

EVENTS = """events_ AS (SELECT 'f' || l_partkey AS name, (l_shipdate, l_orderkey, l_linenumber, l_suppkey) AS seq,
    CASE l_returnflag WHEN 'A' THEN 'accepted' WHEN 'R' THEN 'rejected' ELSE 'candidate' END AS status, l_discount AS ic,
    CASE WHEN l_linestatus = 'F' THEN '{"quantity": ' || CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) || '}' END AS review FROM lineitem)"""


def _events(spark, sf):
    flag = F.col("l_returnflag")
    status = F.when(flag == "A", "accepted").when(flag == "R", "rejected").otherwise("candidate")
    review = F.concat(F.lit('{"quantity": '), F.col("l_quantity").cast("int").cast("string"), F.lit("}"))
    return V.table(spark, sf, "lineitem").select(
        F.concat(F.lit("f"), F.col("l_partkey")).alias("name"),
        "l_shipdate",
        "l_orderkey",
        "l_linenumber",
        "l_suppkey",
        status.alias("status"),
        F.col("l_discount").alias("ic"),
        F.when(F.col("l_linestatus") == "F", review).alias("review"),
    )


SEQ = ["l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey"]


@query("factor_store_status", f"WITH {EVENTS} SELECT name, arg_max(status, seq) AS status FROM events_ GROUP BY name")
def factor_store_status(spark, sf):
    return S.latest(_events(spark, sf), "name", SEQ, ["status"])


@query("factor_store_review", f"""WITH {EVENTS} SELECT name, arg_max(review, seq) FILTER (WHERE review IS NOT NULL) AS review
    FROM events_ GROUP BY name""")
def factor_store_review(spark, sf):
    return S.latest(_events(spark, sf), "name", SEQ, ["review"])


@query("archive_event", f"""WITH {EVENTS}, c AS (SELECT name, arg_max(status, seq) AS status, arg_max(ic, seq) AS ic FROM events_ GROUP BY name)
    SELECT name, CASE WHEN status = 'accepted' AND ic < 0.03 THEN CASE WHEN ic < 0.01 THEN 'candidate' ELSE 'archived' END ELSE status END AS status,
    CASE WHEN status = 'accepted' AND ic < 0.03 THEN CASE WHEN ic < 0.02
      THEN '{{"verdict": "kept", "archive_history": [{{"reason": "replaced"}}, {{"reason": "again"}}], "latest_archive_event": {{"reason": "again"}}}}'
      ELSE '{{"archive_history": [{{"reason": "replaced"}}], "latest_archive_event": {{"reason": "replaced"}}}}' END END AS review FROM c""")
def archive_event(spark, sf):
    """Accepted factors with a low IC archived, some with a review and twice, some saved anew afterwards."""
    store = _store(spark)
    saved = materialize(S.latest(_events(spark, sf), "name", SEQ, ["status", "ic"]))
    store.save(saved)
    low = saved.where("status = 'accepted' AND ic < 0.03").select("name", "ic")
    event = lambda reason: F.lit(f'{{"reason": "{reason}"}}').alias("review")
    store.add_review(low.where("ic < 0.02").select("name", F.lit('{"verdict": "kept"}').alias("review")))
    store.archive(low.select("name", event("replaced")))
    store.archive(low.where("ic < 0.02").select("name", event("again")))
    store.save(low.where("ic < 0.01"), overwrite=True)
    return store.current().select("name", "status", "review")


def _store(spark):
    return S.FactorStore(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")


@query("factor_store_save", """SELECT 'f' || p_partkey AS name, p_type AS description, 'candidate' AS status,
    CAST(1 AS BIGINT) AS horizon, 'rlm' AS source, p_retailprice / 10000 AS ic FROM part""")
def factor_store_save(spark, sf):
    store = _store(spark)
    part = V.table(spark, sf, "part")
    store.save(
        part.select(
            F.concat(F.lit("f"), F.col("p_partkey")).alias("name"),
            F.lit("old text").alias("description"),
            F.col("p_size").alias("horizon"),
            F.lit("t").alias("source"),
        )
    )
    store.save(
        part.select(
            F.concat(F.lit("f"), F.col("p_partkey")).alias("name"),
            F.col("p_type").alias("description"),
            (F.col("p_retailprice") / 10000).alias("ic"),
        ),
        overwrite=True,
    )
    return store.current().select("name", "description", "status", F.col("horizon").cast("bigint").alias("horizon"), "source", "ic")


@query("factor_store_list", f"""WITH {EVENTS}, c AS (SELECT name, arg_max(status, seq) AS status, arg_max(ic, seq) AS ic FROM events_ GROUP BY name)
    SELECT name, status, ic FROM c WHERE status = 'accepted' ORDER BY name""")
def factor_store_list(spark, sf):
    store = _store(spark)
    store.save(S.latest(_events(spark, sf), "name", SEQ, ["status", "ic"]))
    return store.list("accepted").select("name", "status", "ic")


@query("factor_store_read", f"""WITH {EVENTS} SELECT name, arg_max(status, seq) AS status, arg_max(ic, seq) AS ic FROM events_
    WHERE name = 'f7' GROUP BY name""")
def factor_store_read(spark, sf):
    store = _store(spark)
    store.save(S.latest(_events(spark, sf), "name", SEQ, ["status", "ic"]))
    return store.read("f7").select("name", "status", "ic")


