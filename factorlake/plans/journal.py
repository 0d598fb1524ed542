"""Ledger, report-text and fold queries."""

import uuid

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.numeric import rnd
from ..functions.scan import numbered
from ..operators import fold
from ..operators import ledger as G
from ..operators import reports as Rp
from ..session import materialize, shared_dir
from ..sources import history as S
from . import views as V
from .evaluation import rounded
from .registry import out, query

LW = f"WITH RECURSIVE l AS ({V.LEDGER_SQL})"
EV = ", ".join(G.EVENT_COLUMNS)
ADM = f"adm AS (SELECT {EV} FROM l WHERE accepted)"
REJ = f"""rej AS (SELECT {EV}, label, coalesce(error, '') AS reason, error_type FROM l WHERE label IN ('failed', 'duplicate')
    UNION ALL SELECT {EV}, 'library_rejected', 'library review failed', 'FactorLibraryRejected' FROM l
    WHERE NOT accepted AND label NOT IN ('failed', 'duplicate'))"""


@query("admission_events", f"{LW}, {ADM} SELECT * FROM adm")
def admission_events(spark, sf):
    return G.admission_events(V.ledger(spark, sf))


@query("rejection_events", f"{LW}, {REJ} SELECT * FROM rej")
def rejection_events(spark, sf):
    return G.rejection_events(V.ledger(spark, sf))


@query("admission_rate", f"""{LW}, r AS (SELECT round, count(*) FILTER (WHERE accepted) AS admitted, count(*) FILTER (WHERE NOT accepted) AS rejected FROM l GROUP BY 1),
    s AS (SELECT *, admitted / (admitted + rejected) AS rate FROM r)
    SELECT CAST(round AS BIGINT) AS round, admitted, rejected, {out("rate", "rate")},
      {out("avg(rate) OVER (ORDER BY round ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)", "recent_rate")} FROM s""")
def admission_rate(spark, sf):
    return rounded(G.admission_rate(V.ledger(spark, sf)))


@query("library_size", f"""{LW}, d AS (SELECT candidate_index, row_number() OVER (ORDER BY candidate_index) AS pos,
      CASE WHEN accepted THEN 1 WHEN k % 3 = 0 THEN -1 ELSE 0 END AS delta FROM l),
    p AS (SELECT *, sum(delta) OVER (ORDER BY pos) AS s FROM d)
    SELECT candidate_index, CAST(s - least(0, min(s) OVER (ORDER BY pos ROWS UNBOUNDED PRECEDING)) AS BIGINT) AS library_size FROM p""")
def library_size(spark, sf):
    """One step per candidate: +1 for an accepted one, -1 for an archived one."""
    delta = F.when(F.col("accepted"), 1).when(F.col("k") % 3 == 0, -1).otherwise(0)
    steps = V.ledger(spark, sf).select("candidate_index", delta.alias("delta"))
    return G.library_size(steps, ["candidate_index"]).select("candidate_index", "library_size")


def _key(kind, key, need="true"):
    return f"""SELECT '{kind}' AS kind, {key} AS key, win, label, ic FROM moves WHERE {need}"""


STATS = f"""{LW}, {ADM}, {REJ}, moves AS (SELECT branch, mode, axis, parent, ic, true AS win, 'accepted' AS label FROM adm
      UNION ALL SELECT branch, mode, axis, parent, ic, false, label FROM rej),
    keyed AS ({" UNION ALL ".join([_key("branch", "branch"), _key("mode", "mode"), _key("mode_branch", "mode || '|' || branch"),
      _key("axis", "axis", "axis IS NOT NULL"), _key("mode_axis", "mode || '|' || axis", "axis IS NOT NULL"),
      _key("parent", "parent", "parent IS NOT NULL")])}),
    stats AS (SELECT kind, key, count(*) AS attempts, count(*) FILTER (WHERE win) AS successes,
      count(*) FILTER (WHERE NOT win AND label = 'duplicate') AS duplicates, count(*) FILTER (WHERE NOT win AND label <> 'duplicate') AS failures,
      coalesce(sum(ic), 0) AS ic_sum, count(ic) AS ic_count FROM keyed GROUP BY 1, 2)"""  # fmt: skip


def score_sql(a="stats"):
    c = lambda n: f"coalesce({a}.{n}, 0)"
    mean = f"coalesce({a}.ic_sum / nullif({a}.ic_count, 0), 0)"
    return f"""(({c("successes")} + 1) / ({c("attempts")} + 5.0) + 0.25 * sqrt(ln((SELECT sum(attempts) FROM stats) + 1) / ({c("attempts")} + 1.0))
      + 2 * greatest(0, least({mean}, 0.1)) - 0.15 * coalesce({a}.duplicates / nullif({a}.attempts, 0), 0)
      - 0.10 * coalesce({a}.failures / nullif({a}.attempts, 0), 0))"""


def _stats(spark, sf):
    df = V.ledger(spark, sf)
    return G.direction_stats(G.admission_events(df), G.rejection_events(df))


@query("direction_stats", f"""{STATS} SELECT kind, key, attempts, successes, duplicates, failures, {out("ic_sum", "ic_sum")}, ic_count FROM stats""")
def direction_stats(spark, sf):
    return rounded(_stats(spark, sf))


@query("direction_score", f"{STATS} SELECT kind, key, {out(score_sql(), 'score')} FROM stats")
def direction_score(spark, sf):
    return rounded(G.direction_score(materialize(_stats(spark, sf))).select("kind", "key", "score"))


MODES = ("novelty", "mutation", "replacement")


@query("branch_rank", f"""{STATS}, choices AS (SELECT branch, unnest(['novelty', 'mutation', 'replacement']) AS mode FROM (SELECT DISTINCT branch FROM l)),
    s AS (SELECT c.mode, c.branch, {score_sql("a")} + 0.4 * {score_sql("b")} + 0.2 * {score_sql("m")} AS score FROM choices c
      LEFT JOIN stats a ON a.kind = 'mode_branch' AND a.key = c.mode || '|' || c.branch
      LEFT JOIN stats b ON b.kind = 'branch' AND b.key = c.branch LEFT JOIN stats m ON m.kind = 'mode' AND m.key = c.mode)
    SELECT mode, branch, {out("score", "score")}, row_number() OVER (PARTITION BY mode ORDER BY score DESC, branch) AS place FROM s""")
def branch_rank(spark, sf):
    """The third mode is in no record: its keys score with zeros."""
    stats = materialize(_stats(spark, sf))
    return rounded(G.branch_rank(stats, V.ledger(spark, sf).select("branch").distinct(), MODES))


@query("axis_rank", f"""{STATS}, s AS (SELECT c.axis, {score_sql("a")} + 0.3 * {score_sql("b")} AS score
      FROM (SELECT DISTINCT axis FROM l WHERE axis IS NOT NULL UNION SELECT 'unseen') c
      LEFT JOIN stats a ON a.kind = 'axis' AND a.key = c.axis LEFT JOIN stats b ON b.kind = 'mode_axis' AND b.key = 'mutation|' || c.axis)
    SELECT axis, {out("score", "score")}, row_number() OVER (ORDER BY score DESC, axis) AS place FROM s""")
def axis_rank(spark, sf):
    seen = V.ledger(spark, sf).where("axis IS NOT NULL").select("axis")
    axes = seen.unionByName(seen.limit(1).select(F.lit("unseen").alias("axis"))).distinct()
    return rounded(G.axis_rank(materialize(_stats(spark, sf)), axes))


@query("parent_rank", f"""{STATS}, p AS (SELECT parent, max(ic) AS ic FROM l WHERE accepted AND parent IS NOT NULL GROUP BY 1),
    s AS (SELECT p.parent, {score_sql("a")} + 2 * greatest(0, least(p.ic, 0.1)) AS score FROM p
      LEFT JOIN stats a ON a.kind = 'parent' AND a.key = p.parent)
    SELECT parent, {out("score", "score")}, row_number() OVER (ORDER BY round(score, 9) DESC, parent) AS place FROM s""")
def parent_rank(spark, sf):
    df = V.ledger(spark, sf)
    parents = df.where("accepted AND parent IS NOT NULL").groupBy("parent").agg(F.max("ic").alias("ic"))
    return rounded(G.parent_rank(materialize(_stats(spark, sf)), parents))


# failures from report texts

REPORT_LINES = (
    "# Round {round}",
    "## Search Metadata",
    "- Keywords: {branch}, {mode}; {branch} ,  Mom",
    "- Data Fields: close",
    "Next Action: test {branch}: again",
    "no pair here",
    "##  Error Frequency ##",
    "- error_type={mode}Error; count={k}; frequency=0.5; cause=missing {branch}; evidence=line {k}; fix=add it",
    "* KeyError: item {k} not found",
    "",
    "- keyerror: second time, count=2; fix=look it up",
    "- none: nothing",
    "## error frequency",
    "- ValueError: cause=right behind; evidence=run {k}",
    "## Recommended Directions (P_succ)",
    "- Hypothesis: {branch} momentum",
    "  selection-reason: works for {mode}",
    "  plain note {k}",
    "  and more",
    "- plain idea {k}",
    "- odd key: text of {mode}",
    "  Example: {branch}: {k}",
    "## Forbidden Directions (P_fail)",
    "stray note",
    "* {mode} of {branch}",
    "  rejection_reason: too {mode}",
    "## Search Metadata",
    "- Keywords: too late",
    "## Recommended Directions (P_succ)",
    "stray again",
    "example: opens a record {k}",
    "- Hypothesis: {branch} MOMENTUM",
    "  mutation guidance: slower {mode}",
    "construction rule: by {branch}",
    "## Forbidden Directions (P_fail)",
    "* no {branch}",
    "reason: too {mode}",
    "## Next Round Hypotheses",
    "- H1: combine {branch} with volume",
    "2. reverse {mode}",
    "* hypothesis 3) Combine {branch} with VOLUME",
    "## Next Round Hypotheses ##",
    "- 4: from the section behind",
    "## End",
    "- error_type=Late; count=99",
    "## Error Frequency",
    "- error_type=Later; count=99",
    "## Next Round Hypotheses",
    "- another section, not read",
)


def _pieces(line):
    parts, rest = [], line
    while "{" in rest:
        head, rest = rest.split("{", 1)
        name, rest = rest.split("}", 1)
        parts += [("text", head), ("col", name)]
    return [p for p in parts + [("text", rest)] if p[1]]


def report_texts(spark, sf):
    """One report text per candidate."""
    lines = [
        F.concat(*[F.lit(v) if kind == "text" else F.col(v).cast("string") for kind, v in _pieces(line)])
        if line
        else F.lit("")
        for line in REPORT_LINES
    ]
    return V.ledger(spark, sf).select("candidate_index", "round", "k", F.concat_ws("\n", *lines).alias("text"))


def _line_sql(line):
    return " || ".join(f"'{v}'" if kind == "text" else f"CAST({v} AS VARCHAR)" for kind, v in _pieces(line)) or "''"


LINES = f"""{LW}, docs AS (SELECT candidate_index, round, [{", ".join(_line_sql(x) for x in REPORT_LINES)}] AS ls FROM l),
    raw AS (SELECT candidate_index, round, unnest(ls) AS raw, generate_subscripts(ls, 1) AS pos FROM docs),
    marked AS (SELECT *, trim(raw) AS line, CASE WHEN raw LIKE '## %' THEN lower(trim(raw, '# ')) END AS head FROM raw),
    lines AS (SELECT *, last_value(head IGNORE NULLS) OVER (PARTITION BY candidate_index ORDER BY pos
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sec FROM marked),
    heads AS (SELECT candidate_index, pos, head, lag(head) OVER (PARTITION BY candidate_index ORDER BY pos) AS before FROM marked WHERE head IS NOT NULL),
    runs AS (SELECT candidate_index, pos AS start, head, row_number() OVER (PARTITION BY candidate_index, head ORDER BY pos) AS run,
      lead(pos, 1, 1000000) OVER (PARTITION BY candidate_index ORDER BY pos) AS stop FROM heads WHERE before IS DISTINCT FROM head),
    body AS (SELECT l.candidate_index, round, pos, sec, run, (SELECT max(h.pos) FROM heads h WHERE h.candidate_index = l.candidate_index AND h.pos < l.pos) AS part,
      line, trim(ltrim(line, '-* ')) AS entry FROM lines l JOIN runs r ON r.candidate_index = l.candidate_index AND l.pos > start AND l.pos < stop
      WHERE l.head IS NULL AND line <> '')"""


def _grab(name):
    """What stands behind `name=` up to the next semicolon, by positions in the text."""
    low = f"strpos(lower(entry), '{name}=')"
    return f"CASE WHEN {low} > 0 THEN trim(split_part(substr(entry, {low} + {len(name) + 1}), ';', 1), ' ,;') ELSE '' END"


ERRORS = f"""{LINES}, e AS (SELECT candidate_index, round, pos, entry, CASE WHEN entry LIKE '%error_type=%' THEN trim(regexp_extract(entry, 'error_type=([^,;]+)', 1))
      ELSE trim(split_part(entry, ':', 1)) END AS error_type, entry LIKE '%error_type=%' AS explicit FROM body WHERE sec = 'error frequency' AND run = 1),
    f AS (SELECT *, coalesce(try_cast({_grab("count")} AS BIGINT), 1) AS n, try_cast({_grab("frequency")} AS DOUBLE) AS frequency,
      CASE WHEN {_grab("cause")} <> '' THEN {_grab("cause")} WHEN explicit THEN entry ELSE trim(substr(entry, strpos(entry, ':') + 1)) END AS cause,
      {_grab("evidence")} AS evidence, {_grab("fix")} AS fix FROM e WHERE lower(error_type) <> 'none'),
    errors AS (SELECT candidate_index, arg_min(error_type, pos) AS error_type, CAST(sum(n) AS BIGINT) AS count, first(frequency ORDER BY pos) AS frequency,
      coalesce(arg_min(cause, pos) FILTER (WHERE cause <> ''), '') AS cause, coalesce(arg_min(evidence, pos) FILTER (WHERE evidence <> ''), '') AS evidence,
      coalesce(arg_min(fix, pos) FILTER (WHERE fix <> ''), '') AS fix, any_value(round) AS round FROM f GROUP BY candidate_index, lower(error_type))"""


@query("error_report_extract", f"{ERRORS} SELECT * EXCLUDE (round) FROM errors")
def error_report_extract(spark, sf):
    return Rp.error_reports(report_texts(spark, sf), "candidate_index", "text")


FAILURES = f"""{ERRORS}, failures AS (SELECT lower(error_type) AS key, arg_max(error_type, (round, candidate_index)) AS error_type,
    CAST(sum(greatest(1, count)) AS BIGINT) AS count, list_sort(list_distinct(list(round))) AS rounds, max(round) AS latest_round,
    arg_max(cause, (round, candidate_index)) AS latest_cause, arg_max(evidence, (round, candidate_index)) AS latest_evidence,
    arg_max(fix, (round, candidate_index)) AS latest_fix FROM errors GROUP BY 1)"""


def _failures(spark, sf):
    texts = report_texts(spark, sf)
    got = Rp.error_reports(texts, "candidate_index", "text")
    reports = got.join(texts.select("candidate_index", "round"), "candidate_index")
    return G.failure_stats(reports.withColumn("seq", F.col("candidate_index")))


@query("failure_stats", f"{FAILURES} SELECT * REPLACE (array_to_string(rounds, ',') AS rounds) FROM failures")
def failure_stats(spark, sf):
    df = _failures(spark, sf)
    return df.withColumn("rounds", F.array_join(F.col("rounds").cast("array<string>"), ","))


@query("failure_topn", f"{FAILURES} SELECT error_type, count, latest_round FROM failures ORDER BY count DESC, latest_round DESC, error_type LIMIT 2")
def failure_topn(spark, sf):
    return G.failure_topn(_failures(spark, sf), 2).select("error_type", "count", "latest_round")


@query("search_metadata_extract", f"""{LINES}, kv AS (SELECT candidate_index, pos, replace(lower(trim(split_part(entry, ':', 1))), ' ', '_') AS name,
      trim(substr(entry, strpos(entry, ':') + 1)) AS value FROM body WHERE sec = 'search metadata' AND run = 1 AND entry LIKE '%:%'),
    items AS (SELECT candidate_index, name, i, trim(unnest(parts)) AS v, generate_subscripts(parts, 1) AS ix FROM
      (SELECT candidate_index, name, 1 AS i, CASE WHEN name IN ('keywords', 'data_fields') THEN regexp_split_to_array(value, '[,;]+') ELSE [value] END AS parts FROM kv)),
    uniq AS (SELECT candidate_index, name, lower(v) AS lv, arg_min(v, ix) AS v, min(ix) AS ix FROM items WHERE v <> '' GROUP BY 1, 2, 3)
    SELECT candidate_index, name, string_agg(v, '|' ORDER BY ix) AS value FROM uniq GROUP BY 1, 2""")
def search_metadata_extract(spark, sf):
    df = Rp.search_metadata(report_texts(spark, sf), "candidate_index", "text")
    return df.select("candidate_index", "name", F.array_join("values", "|").alias("value"))


@query("hypothesis_list_extract", f"""{LINES}, h AS (SELECT candidate_index, pos,
      trim(CASE WHEN entry SIMILAR TO '[0-9].*' OR entry SIMILAR TO '(H|h|hypothesis) ?[0-9].*'
      THEN substr(entry, strpos(translate(entry, '.)-', ':::'), ':') + 1) ELSE entry END) AS text FROM body WHERE sec = 'next round hypotheses' AND run = 1),
    u AS (SELECT candidate_index, arg_min(text, pos) AS text, min(pos) AS pos FROM h WHERE text <> '' GROUP BY candidate_index, lower(text))
    SELECT candidate_index, text, row_number() OVER (PARTITION BY candidate_index ORDER BY pos) AS place FROM u""")
def hypothesis_list_extract(spark, sf):
    return rounded(Rp.hypothesis_list(report_texts(spark, sf), "candidate_index", "text"))


KNOWN = ", ".join(f"'{k}'" for k in Rp.RECORD_KEYS)


DIRECTIONS = f"""{LINES}, d AS (SELECT candidate_index, CASE sec WHEN 'recommended directions (p_succ)' THEN 'recommended' ELSE 'forbidden' END AS section, part, pos,
      line LIKE '- %' OR line LIKE '* %' AS bullet, CASE WHEN line LIKE '- %' OR line LIKE '* %' THEN trim(substr(line, 3)) ELSE line END AS e
      FROM body WHERE sec IN ('recommended directions (p_succ)', 'forbidden directions (p_fail)')),
    t AS (SELECT *, e LIKE '%:%' AS pair, replace(replace(lower(trim(split_part(e, ':', 1))), ' ', '_'), '-', '_') AS nm, trim(substr(e, strpos(e, ':') + 1)) AS val FROM d),
    w AS (SELECT *, bullet AND (NOT pair OR nm NOT IN ({KNOWN})) AS whole FROM t),
    o AS (SELECT *, CASE WHEN whole THEN 'hypothesis' WHEN pair THEN nm ELSE 'notes' END AS name, CASE WHEN whole OR NOT pair THEN e ELSE val END AS value,
      whole OR (pair AND nm = 'hypothesis') AS opens, NOT whole AND NOT pair AS note FROM w),
    p AS (SELECT *, (SELECT min(z.pos) FROM o z WHERE z.candidate_index = o.candidate_index AND z.part = o.part AND NOT z.note) AS begins FROM o),
    n AS (SELECT *, CAST(sum((opens OR pos = begins)::INT) OVER q AS INTEGER) AS record FROM p WHERE pos >= begins
      WINDOW q AS (PARTITION BY candidate_index, section ORDER BY pos ROWS UNBOUNDED PRECEDING)),
    records AS (SELECT candidate_index, section, record, name, CASE WHEN name = 'notes' THEN string_agg(value, ' ' ORDER BY pos) ELSE arg_max(value, pos) END AS value
      FROM n GROUP BY candidate_index, section, record, name)"""


@query("direction_report_extract", f"{DIRECTIONS} SELECT * FROM records")
def direction_report_extract(spark, sf):
    return Rp.direction_reports(report_texts(spark, sf), "candidate_index", "text")


@query("direction_metadata", f"""{DIRECTIONS}, lists(section, list, name, choice) AS (VALUES
      {", ".join(f"('{s}', '{name}', '{k}', {i})" for (s, name), keys in Rp.DIRECTION_LISTS.items() for i, k in enumerate(keys))}),
    offers AS (SELECT candidate_index, list, record, choice, value FROM records JOIN lists USING (section, name)),
    chosen AS (SELECT candidate_index, list, record, arg_min(value, choice) AS value FROM offers GROUP BY 1, 2, 3),
    once AS (SELECT candidate_index, list, lower(value) AS low, arg_min(value, record) AS value, min(record) AS record FROM chosen GROUP BY 1, 2, 3)
    SELECT candidate_index, list AS name, string_agg(value, '|' ORDER BY record) AS values FROM once GROUP BY 1, 2""")
def direction_metadata(spark, sf):
    records = Rp.direction_reports(report_texts(spark, sf), "candidate_index", "text")
    got = Rp.direction_metadata(records, "candidate_index")
    return got.withColumn("values", F.array_join("values", "|"))


@query("card_section_extract", f"""{LW} SELECT candidate_index, 'type: ' || branch || chr(10) || 'hypothesis:' || chr(10) || '  hp1: ' || mode || ' rises' || chr(10)
    || '  hp2: k is ' || k || chr(10) || 'factor: f' || k AS summary, 'hypothesis:' || chr(10) || '  hp1: ' || mode || ' rises' || chr(10) || '  hp2: k is ' || k AS hypothesis FROM l""")
def card_section_extract(spark, sf):
    k = F.col("k").cast("string")
    lines = [
        F.lit("# Card"), F.lit("## Summary"), F.concat(F.lit("type: "), "branch"), F.lit("hypothesis:  "),
        F.concat(F.lit("  hp1: "), "mode", F.lit(" rises  ")), F.concat(F.lit("  hp2: k is "), k),
        F.concat(F.lit("factor: f"), k), F.lit(""), F.lit("## Other"), F.lit("hypothesis: none"),
    ]
    docs = V.ledger(spark, sf).select("candidate_index", F.concat_ws("\n", *lines).alias("text"))
    got = Rp.card_sections(docs, "candidate_index", "text")
    return got.withColumn("summary", F.regexp_replace("summary", r"(?m)[ \t]+$", ""))


@query("code_block_extract", """SELECT conv_id, turn, 0 AS block, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS code FROM conversations
    UNION ALL SELECT conv_id, turn, 1, 'x = ' || turn FROM conversations""")
def code_block_extract(spark, sf):
    """Conversation texts put into fences, between fences of another language."""
    flat = F.trim(F.regexp_replace("text", r"\s+", " "))
    text = F.concat(
        F.lit("see\n```repl  \n"), flat, F.lit("\n```\n```sql\nselect 1\n```\nand\n```repl\nx = "), F.col("turn"), F.lit("\n```\nend")
    )
    docs = V.table(spark, sf, "conversations").select(F.struct("conv_id", "turn").alias("id"), text.alias("text"))
    return Rp.code_blocks(docs, "id", "text", "repl").select("id.conv_id", "id.turn", "block", "code")


def _shortened(expr, limit):
    """A text on one line, with a note where it is too long."""
    flat = f"trim(regexp_replace({expr}, '\\s+', ' ', 'g'))"
    return f"CASE WHEN length({flat}) <= {limit} THEN {flat} ELSE rtrim(substr({flat}, 1, {limit - 15})) || ' ... [truncated]' END"


@query("trajectory_flatten", f"""WITH c AS (SELECT conv_id, turn, role, text, CASE WHEN length(text) <= 4000 THEN text ELSE rtrim(substr(text, 1, 3982), E' \\n\\t') || chr(10) || '... [truncated]' END AS code FROM conversations)
    SELECT conv_id, turn, turn AS iteration, 0 AS block_index, code, role AS stdout, '' AS error, '' AS final_answer FROM c
    UNION ALL SELECT conv_id, turn, turn, 1, 'y = 1', '', {_shortened("'bad ' || role || ' ' || repeat(text, 3)", 300)}, {_shortened("repeat(text, 5)", 500)} FROM c
    UNION ALL SELECT conv_id, turn, 1, 0, 'z', '', '', '' FROM c WHERE role = 'user'""")
def trajectory_flatten(spark, sf):
    """JSON trajectories made from conversation turns; some keep the iterations under metadata."""
    none = F.lit(None).cast("string")
    block = lambda code, stdout, error, final=none: F.struct(
        code.alias("code"), stdout.alias("stdout"), error.alias("error"), final.alias("final_answer")
    )
    first = F.struct(
        F.col("turn").alias("iteration"),
        F.array(
            block(F.col("text"), F.col("role"), none),
            block(F.lit("y = 1"), none, F.concat(F.lit("bad  "), "role", F.lit(" "), F.repeat("text", F.lit(3))), F.repeat("text", F.lit(5))),
        ).alias("code_blocks"),
    )
    second = F.struct(
        F.lit(None).cast("bigint").alias("iteration"), F.array(block(F.lit("z"), none, none)).alias("code_blocks")
    )
    under = F.to_json(F.struct(F.struct(F.array(first, second).alias("iterations")).alias("metadata")))
    flat = F.to_json(F.struct(F.array(first).alias("iterations")))
    docs = V.table(spark, sf, "conversations").select(
        F.struct("conv_id", "turn").alias("id"), F.when(F.col("role") == "user", under).otherwise(flat).alias("doc")
    )
    got = Rp.trajectories(docs, "id", "doc")
    return got.select("id.conv_id", "id.turn", "iteration", "block_index", "code", "stdout", "error", "final_answer")


# patterns and insights


def patterns(spark, sf):
    k = F.col("k")
    return V.ledger(spark, sf).select(
        F.col("candidate_index").alias("seq"),
        F.concat_ws("_", "branch", "mode").alias("name"),
        (k % 4).cast("bigint").alias("count"),
        F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("text "), k)).alias("text"),
        (k / 100).alias("confidence"),
        F.when(k % 2 == 0, F.concat(F.lit("ex"), k % 30)).alias("example"),
    )


PATTERNS = f"""{LW}, p AS (SELECT candidate_index AS seq, branch || '_' || mode AS name, k % 4 AS count, CASE WHEN k % 3 = 0 THEN '' ELSE 'text ' || k END AS text,
    k / 100.0 AS confidence, CASE WHEN k % 2 = 0 THEN 'ex' || (k % 30) END AS example FROM l)"""


@query("pattern_merge", f"""{PATTERNS} SELECT name, CAST(sum(count) AS BIGINT) AS count, arg_max(text, seq) FILTER (WHERE text <> '') AS text,
    CAST(max(confidence) AS DOUBLE) AS confidence, count(DISTINCT example) AS examples FROM p GROUP BY 1""")
def pattern_merge(spark, sf):
    return G.pattern_merge(patterns(spark, sf))


@query("pattern_examples", f"{PATTERNS} SELECT name, example, min(seq) AS first_seq FROM p WHERE example IS NOT NULL GROUP BY 1, 2")
def pattern_examples(spark, sf):
    return G.pattern_examples(patterns(spark, sf))


@query("insight_merge", f"""{LW}, i AS (SELECT candidate_index AS seq, mode AS phase, branch || ' ' || (k % 10) AS insight, coalesce(error, 'fine ' || k) AS evidence FROM l)
    SELECT phase, insight, min(seq) AS seq, arg_min(evidence, seq) AS evidence FROM i GROUP BY 1, 2""")
def insight_merge(spark, sf):
    k = F.col("k")
    rows = V.ledger(spark, sf).select(
        F.col("candidate_index").alias("seq"),
        F.col("mode").alias("phase"),
        F.concat("branch", F.lit(" "), k % 10).alias("insight"),
        F.coalesce("error", F.concat(F.lit("fine "), k)).alias("evidence"),
    )
    return G.insight_merge(rows)


CLASS = "CASE k % 4 WHEN 0 THEN 'High' WHEN 1 THEN 'Medium' WHEN 2 THEN 'Low' ELSE 'Other' END"
RELEVANCE = f"""{LW}, r AS (SELECT candidate_index, module AS name, (CASE k % 4 WHEN 0 THEN 2.0 WHEN 2 THEN 0.5 ELSE 1.0 END)
    * (CASE WHEN k > 0 THEN 1 + ln(1 + k) ELSE 1 END) * (CASE WHEN k / 100.0 >= 0.7 THEN 0.2 WHEN k / 100.0 >= 0.5 THEN 0.6 ELSE 1 END) AS score FROM l)"""


def _relevance(spark, sf):
    k = F.col("k")
    kind = F.when(k % 4 == 0, "High").when(k % 4 == 1, "Medium").when(k % 4 == 2, "Low").otherwise("Other")
    score = G.success_relevance(kind, k, k / 100)
    return V.ledger(spark, sf).select("candidate_index", F.col("module").alias("name"), score.alias("score"))


@query("pattern_relevance", f"{RELEVANCE} SELECT candidate_index, {out('score', 'score')} FROM r")
def pattern_relevance(spark, sf):
    return rounded(_relevance(spark, sf).select("candidate_index", "score"))


@query("pattern_topn", f"{RELEVANCE} SELECT name, {out('score', 'score')} FROM (SELECT * FROM r ORDER BY round(score, 9) DESC, name LIMIT 10)")
def pattern_topn(spark, sf):
    return rounded(G.pattern_topn(_relevance(spark, sf), 10).select("name", "score"))


@query("forbidden_relevance", f"""{LW}, {REJ}, last AS (SELECT * FROM rej ORDER BY round DESC, candidate_index DESC LIMIT 40),
    words AS (SELECT DISTINCT w FROM (SELECT unnest(string_split(lower(reason), ' ')) AS w, 4 AS m FROM last UNION ALL SELECT lower(coalesce(error_type, '')), 0 FROM last) WHERE length(w) > m),
    d AS (SELECT candidate_index, lower(coalesce(error, module) || ' ' || coalesce(error_type, 'fine')) AS text, k / 100.0 AS corr, k FROM l)
    SELECT candidate_index, {out("(1 + corr) * (CASE WHEN k > 0 THEN 1 + ln(1 + k) ELSE 1 END) * CASE WHEN EXISTS (SELECT 1 FROM words WHERE contains(d.text, w)) THEN 1.5 ELSE 1 END", "score")} FROM d""")
def forbidden_relevance(spark, sf):
    df = V.ledger(spark, sf)
    text = F.concat_ws(" ", F.coalesce("error", "module"), F.coalesce("error_type", F.lit("fine")))
    directions = df.select("candidate_index", text.alias("text"), (F.col("k") / 100).alias("correlation"), F.col("k").alias("count"))
    got = G.forbidden_relevance(directions, G.rejection_events(df), 40, ["round", "candidate_index"])
    return rounded(got.select("candidate_index", "score"))


@query("dominant_branch", f"""{LW}, n AS (SELECT round, branch, count(*) AS n FROM l WHERE label IN ('failed', 'duplicate') GROUP BY 1, 2)
    SELECT round, branch, n FROM n QUALIFY row_number() OVER (PARTITION BY round ORDER BY n DESC, branch) = 1""")
def dominant_branch(spark, sf):
    return G.dominant_branch(V.ledger(spark, sf))


@query("keep_recent", f"{LW} SELECT branch, candidate_index FROM l QUALIFY row_number() OVER (PARTITION BY branch ORDER BY candidate_index DESC) <= 20")
def keep_recent(spark, sf):
    return G.keep_recent(V.ledger(spark, sf).select("branch", "candidate_index"), "branch", ["candidate_index"], 20)


@query("round_best", f"""{LW}, b AS (SELECT round, max(ic) FILTER (WHERE ok) AS best_ic FROM l GROUP BY 1),
    p AS (SELECT *, max(best_ic) OVER (ORDER BY round ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_best_ic FROM b)
    SELECT CAST(round AS BIGINT) AS round, {out("best_ic", "best_ic")}, {out("previous_best_ic", "previous_best_ic")},
      best_ic IS NOT NULL AND (previous_best_ic IS NULL OR best_ic > previous_best_ic) AS improved, {out("best_ic - previous_best_ic", "delta")} FROM p""")
def round_best(spark, sf):
    return rounded(G.round_best(V.ledger(spark, sf)))


@query("best_factor", f"{LW} SELECT arg_max(module, (ic, -candidate_index)) AS module, max(ic) AS ic FROM l WHERE accepted")
def best_factor(spark, sf):
    return G.best_factor(V.ledger(spark, sf))


@query("accepted_topn", f"""{LW}, a AS (SELECT candidate_index, ic, count(*) OVER () AS total FROM l WHERE accepted)
    SELECT *, total > 25 AS truncated FROM a ORDER BY ic DESC, candidate_index LIMIT 25""")
def accepted_topn(spark, sf):
    return G.accepted_topn(V.ledger(spark, sf), 25).select("candidate_index", "ic", "total", "truncated")


@query("rel_improve", f"""{LW}, p AS (SELECT candidate_index, ic, lag(ic) OVER (PARTITION BY round, branch ORDER BY candidate_index) AS best FROM l WHERE ic IS NOT NULL)
    SELECT candidate_index, {out("(ic - best) / greatest(abs(best), 1e-8)", "higher", 5)}, {out("(best - ic) / greatest(abs(best), 1e-8)", "lower", 5)} FROM p WHERE best IS NOT NULL""")
def rel_improve(spark, sf):
    """Each candidate against the one before it in its round and branch."""
    df = V.ledger(spark, sf).where("ic IS NOT NULL").select("round", "branch", "candidate_index", "ic")
    no = numbered(df, ["round", "branch"], ["candidate_index"])
    prev = no.select("round", "branch", (F.col("no") + 1).alias("no"), F.col("ic").alias("best"))
    both = no.join(prev, ["round", "branch", "no"])
    return both.select(
        "candidate_index",
        rnd(G.rel_improve(F.col("ic"), F.col("best")), 5).alias("higher"),
        rnd(G.rel_improve(F.col("ic"), F.col("best"), lower=True), 5).alias("lower"),
    )


@query("flatten_metrics", f"""{LW} SELECT candidate_index, 'scores' AS "group", 'ic' AS metric, ic AS value FROM l
    UNION ALL SELECT candidate_index, 'scores', 'k', CAST(k AS DOUBLE) FROM l UNION ALL SELECT candidate_index, 'flags', 'ok', CASE WHEN ok THEN 1.0 ELSE 0.0 END FROM l""")
def flatten_metrics(spark, sf):
    scores = F.create_map(F.lit("ic"), F.col("ic"), F.lit("k"), F.col("k").cast("double"))
    flags = F.create_map(F.lit("ok"), F.col("ok").cast("double"))
    nested = F.create_map(F.lit("scores"), scores, F.lit("flags"), flags)
    return G.flatten_metrics(V.ledger(spark, sf).select("candidate_index", nested.alias("m")), "candidate_index", "m")


@query("seed_unique", f"""{LW}, n AS (SELECT candidate_index AS seq, CASE WHEN k % 2 = 0 THEN upper(branch) ELSE branch END || ' idea ' || (k % 50) AS text FROM l),
    e AS (SELECT DISTINCT lower(branch || ' idea ' || (k % 50)) AS t FROM l WHERE k % 50 < 10)
    SELECT min(seq) AS seq, arg_min(text, seq) AS text FROM n WHERE lower(text) NOT IN (SELECT t FROM e) GROUP BY lower(text)""")
def seed_unique(spark, sf):
    k = F.col("k")
    df = V.ledger(spark, sf)
    idea = F.concat(F.lit(" idea "), k % 50)
    new = df.select(
        F.col("candidate_index").alias("seq"),
        F.concat(F.when(k % 2 == 0, F.upper("branch")).otherwise(F.col("branch")), idea).alias("text"),
    )
    have = df.where(k % 50 < 10).select(F.concat("branch", idea).alias("text"))
    return G.seed_unique(have, new)


@query("merge_unique", """WITH w AS (SELECT lang, doc_id AS seq, string_split(text, ' ') AS ws FROM documents),
    r AS (SELECT lang, seq, generate_subscripts(ws, 1) - 1 AS pos, trim(unnest(ws)) AS value FROM w)
    SELECT lang, arg_min(value, (seq, pos)) AS value, min((seq, pos))[1] AS seq, CAST(min((seq, pos))[2] AS INTEGER) AS pos
    FROM r WHERE value <> '' GROUP BY lang, lower(value)""")
def merge_unique(spark, sf):
    """First spelling of every word per language, over whole texts."""
    docs = V.table(spark, sf, "documents").select("lang", F.col("doc_id").alias("seq"), F.split("text", " ").alias("words"))
    return G.merge_unique(docs, "lang", "words")


# names and texts


@query("name_kebab", """SELECT p_partkey, lower(trim(regexp_replace(replace(trim(regexp_replace(replace(replace(p_name, ' ', 'X_'), 'a', 'A'), '([A-Z])', '-\\1', 'g'), '-'), '_', '-'),
    '[^A-Za-z0-9_.-]+', '-', 'g'), '-')) AS name FROM part""")
def name_kebab(spark, sf):
    """Part names turned into mixed-case module names."""
    raw = F.regexp_replace(F.regexp_replace("p_name", " ", "X_"), "a", "A")
    return V.table(spark, sf, "part").select("p_partkey", X.name_kebab(raw).alias("name"))


@query("name_valid", """SELECT p_partkey, regexp_matches(p_brand, '^[A-Za-z0-9][A-Za-z0-9_.-]*$') AS brand_ok,
    regexp_matches(replace(p_name, ' ', '-'), '^[A-Za-z0-9][A-Za-z0-9_.-]*$') AS name_ok FROM part""")
def name_valid(spark, sf):
    return V.table(spark, sf, "part").select(
        "p_partkey",
        X.name_valid("p_brand").alias("brand_ok"),
        X.name_valid(F.regexp_replace("p_name", " ", "-")).alias("name_ok"),
    )


@query("safe_token", """WITH t AS (SELECT doc_id, trim(regexp_replace(lower(text), '[^0-9A-Za-z]+', '_', 'g'), '_') AS t FROM documents)
    SELECT doc_id, CASE WHEN t = '' THEN 'pattern' ELSE rtrim(substr(t, 1, 64), '_') END AS token FROM t""")
def safe_token(spark, sf):
    return V.table(spark, sf, "documents").select("doc_id", X.safe_token("text").alias("token"))


@query("text_compact", """WITH t AS (SELECT doc_id, trim(regexp_replace(text, '[\\s\\pZ]+', ' ', 'g')) AS t FROM documents)
    SELECT doc_id, CASE WHEN length(t) <= 1200 THEN t ELSE rtrim(substr(t, 1, 1164)) || ' ... [truncated]' END AS text FROM t""")
def text_compact(spark, sf):
    return V.table(spark, sf, "documents").select("doc_id", X.compact("text").alias("text"))


@query("tags_array", """WITH t AS (SELECT p_partkey, list_concat(string_split(p_name, ' '), [lower(p_type)]) AS tags FROM part)
    SELECT p_partkey, unnest(tags) AS tag, len(tags) AS n, list_contains(tags, 'red') AS red FROM t""")
def tags_array(spark, sf):
    tags = F.concat(F.split("p_name", " "), F.array(F.lower("p_type")))
    df = V.table(spark, sf, "part").select("p_partkey", tags.alias("tags"))
    return df.select(
        "p_partkey",
        F.explode("tags").alias("tag"),
        F.size("tags").cast("bigint").alias("n"),
        F.array_contains("tags", "red").alias("red"),
    )


# folds


def strategy_rounds(spark, sf):
    """A run per user, a round per event."""
    rows = V.table(spark, sf, "events").select("user_id", "event_id", "value", F.get_json_object("props", "$.k").cast("int").alias("k"))
    no = numbered(rows, ["user_id"], ["event_id"], "pos")
    k = F.col("k")
    return no.select(
        F.col("user_id").cast("string").alias("run"),
        "pos",
        F.col("value").alias("excess_return"),
        (k * 1.5).alias("information_ratio"),
        (1 + k % 37).cast("double").alias("risk_to_reward"),
        (k % 3 != 0).alias("hypothesis_true"),
    )


GAIN = "(({0}) - ({1})) / greatest(abs({1}), 1e-8) >= 0.05"


@query("plateau_fold_strategy", f"""WITH RECURSIVE e AS (SELECT CAST(user_id AS VARCHAR) AS run, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS pos, value AS x,
      CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
    r AS (SELECT run, pos, x, k * 1.5::DOUBLE AS y, CAST(1 + k % 37 AS DOUBLE) AS z, k % 3 <> 0 AS h FROM e),
    f AS (SELECT run, pos, x AS bx, y AS by_, z AS bz, CAST(0 AS BIGINT) AS p, CAST(0 AS BIGINT) AS s FROM r WHERE pos = 1
      UNION ALL SELECT r.run, r.pos, CASE WHEN {GAIN.format("r.x", "f.bx")} THEN r.x ELSE bx END, CASE WHEN {GAIN.format("r.y", "f.by_")} THEN r.y ELSE by_ END,
        CASE WHEN (f.bz - r.z) / greatest(abs(f.bz), 1e-8) >= 0.05 THEN r.z ELSE bz END,
        CASE WHEN {GAIN.format("r.x", "f.bx")} OR {GAIN.format("r.y", "f.by_")} OR (f.bz - r.z) / greatest(abs(f.bz), 1e-8) >= 0.05 THEN 0 ELSE p + 1 END,
        CASE WHEN h AND NOT ({GAIN.format("r.x", "f.bx")} OR {GAIN.format("r.y", "f.by_")} OR (f.bz - r.z) / greatest(abs(f.bz), 1e-8) >= 0.05) THEN s + 1 ELSE 0 END
      FROM f JOIN r ON r.run = f.run AND r.pos = f.pos + 1)
    SELECT run, pos, bx AS best_excess_return, by_ AS best_information_ratio, bz AS best_risk_to_reward, p AS plateau_count, s AS success_plateau_count,
      CASE WHEN pos > 1 AND (p >= 3 OR s >= 2) THEN 'end' ELSE 'continue' END AS decision,
      CASE WHEN pos = 1 THEN 'first_round' WHEN p >= 3 THEN 'strategy_plateau_3_rounds' WHEN s >= 2 THEN 'hypothesis_true_and_strategy_plateau'
        ELSE 'still_improving_or_not_yet_plateau' END AS reason FROM f""")
def plateau_fold_strategy(spark, sf):
    got = fold.plateau_strategy(materialize(strategy_rounds(spark, sf)))
    return got.select(
        "run", "pos", "best_excess_return", "best_information_ratio", "best_risk_to_reward",
        "plateau_count", "success_plateau_count", "decision", "reason",
    )


def tested_signals(spark, sf):
    """A run per event type, a round per hour, a tested signal per event."""
    k = F.get_json_object("props", "$.k").cast("int")
    rows = V.table(spark, sf, "events").select(
        F.col("event_type").alias("run"),
        F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"),
        (k % 5 != 0).alias("hypothesis_true"),
        (k % 7 != 0).alias("profitable"),
        F.floor("value").alias("rank_ic_1h"),
        k.cast("double").alias("rank_ic_5h"),
    )
    hours = numbered(rows.select("run", "hour").distinct(), ["run"], ["hour"], "pos")
    return rows.join(hours, ["run", "hour"]).drop("hour")


@query("plateau_fold_signal", f"""WITH RECURSIVE e AS (SELECT event_type AS run, date_trunc('hour', ts) AS hour, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, floor(value) AS v FROM events),
    q AS (SELECT run, hour, count(*) FILTER (WHERE k % 5 <> 0) AS hp, count(*) FILTER (WHERE k % 7 <> 0) AS pc, avg(v) AS x, avg(CAST(k AS DOUBLE)) AS y,
      bool_and(k % 5 <> 0 AND k % 7 <> 0) AS every FROM e GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY hour) AS pos, every AND x >= 20 AND y >= 20 AS passed FROM q),
    f AS (SELECT run, pos, hp AS bh, pc AS bp, x AS bx, y AS bz, CAST(0 AS BIGINT) AS p, CAST(0 AS BIGINT) AS s, true AS best FROM r WHERE pos = 1
      UNION ALL SELECT run, pos, CASE WHEN nb THEN greatest(bh, hp) ELSE bh END, CASE WHEN nb THEN greatest(bp, pc) ELSE bp END,
        CASE WHEN nb THEN greatest(bx, x) ELSE bx END, CASE WHEN nb THEN greatest(bz, y) ELSE bz END, CASE WHEN nb THEN 0 ELSE p + 1 END,
        CASE WHEN passed THEN s + 1 ELSE 0 END, nb
      FROM (SELECT r.*, f.bh, f.bp, f.bx, f.bz, f.p, f.s, r.hp > f.bh OR r.pc > f.bp OR {GAIN.format("r.x", "f.bx")} OR {GAIN.format("r.y", "f.bz")} AS nb
        FROM f JOIN r ON r.run = f.run AND r.pos = f.pos + 1))
    SELECT f.run, f.pos, best AS is_new_best, p AS plateau_count, s AS success_plateau_count,
      CASE WHEN f.pos > 1 AND (passed OR p >= 3) THEN 'end' ELSE 'continue' END AS decision,
      CASE WHEN f.pos = 1 THEN 'first_round' WHEN passed THEN 'all_hypothesis_true_profitable_and_ic_passed' WHEN p >= 3 THEN 'hybrid_plateau_3_rounds'
        ELSE 'refine_hypothesis_profitability_or_ic' END AS reason FROM f JOIN r ON f.run = r.run AND f.pos = r.pos""")
def plateau_fold_signal(spark, sf):
    rounds = materialize(fold.signal_rounds(tested_signals(spark, sf), 20.0, 20.0))
    got = fold.plateau_signal(rounds)
    return got.select("run", "pos", "is_new_best", "plateau_count", "success_plateau_count", "decision", "reason")


# portfolio history


def history(spark, sf):
    """One record per round from the ledger."""
    return (
        V.ledger(spark, sf)
        .groupBy("round")
        .agg(
            F.avg("ic").alias("composite_rank_ic"),
            F.count("*").alias("score_rows"),
            F.max(F.when(F.col("ok"), F.col("ic"))).alias("round_best_rank_ic"),
            F.concat_ws(",", F.min(F.when(F.col("accepted"), F.col("module"))), F.max(F.when(F.col("k") == 7, F.col("module")))).alias("admitted_factors"),
        )
    )


HISTORY = f"""{LW}, history AS (SELECT round, avg(ic) AS composite_rank_ic, count(*) AS score_rows, max(ic) FILTER (WHERE ok) AS round_best_rank_ic,
    concat_ws(',', min(module) FILTER (WHERE accepted), max(module) FILTER (WHERE k = 7)) AS admitted_factors FROM l GROUP BY 1)"""
HISTORY_COLUMNS = f"""{out("composite_rank_ic", "composite_rank_ic")}, score_rows, {out("round_best_rank_ic", "round_best_rank_ic")}, admitted_factors"""


def _path(spark, kind):
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


@query("history_upsert", f"""{HISTORY}, fresh AS (SELECT round, 0.5::DOUBLE AS composite_rank_ic, score_rows + 1 AS score_rows, round_best_rank_ic, 'x' AS admitted_factors FROM history WHERE round >= 25),
    merged AS (SELECT * FROM history WHERE round < 25 UNION ALL SELECT * FROM fresh) SELECT CAST(round AS BIGINT) AS round, {HISTORY_COLUMNS} FROM merged""")
def history_upsert(spark, sf):
    """Rounds from 25 on replaced by new records, written as JSON and CSV, read back from JSON."""
    old = history(spark, sf)
    new = old.where("round >= 25").withColumns(
        {"composite_rank_ic": F.lit(0.5), "score_rows": F.col("score_rows") + 1, "admitted_factors": F.lit("x")}
    )
    path = _path(spark, "history")
    S.write_history(S.upsert(old, new), path)
    return rounded(S.read_history(spark, path).select("round", "composite_rank_ic", "score_rows", "round_best_rank_ic", "admitted_factors"))


@query("history_scan", f"""{HISTORY} SELECT CAST(round AS BIGINT) AS round, {out("CASE WHEN round % 4 = 0 THEN NULL ELSE composite_rank_ic END", "composite_rank_ic")},
    score_rows, {out("round_best_rank_ic", "round_best_rank_ic")}, admitted_factors FROM history""")
def history_scan(spark, sf):
    """Text records: broken numbers become NULL, records without a round go, best ICs come from the summaries."""
    h = history(spark, sf)
    broken = F.when(F.col("round") % 4 == 0, "broken").otherwise(F.col("composite_rank_ic").cast("string"))
    text = h.withColumns(
        {
            "round": F.col("round").cast("string"),
            "composite_rank_ic": broken,
            "score_rows": F.col("score_rows").cast("string"),
            "round_best_rank_ic": F.when(F.col("round") % 3 == 0, None).otherwise(F.col("round_best_rank_ic").cast("string")),
        }
    )
    bad = text.withColumn("round", F.concat(F.lit("round "), "round"))
    path = _path(spark, "history")
    S.write_history(text.unionByName(bad), path)
    summaries = h.select("round", "round_best_rank_ic")
    got = S.clean_history(S.read_history(spark, path), summaries)
    return rounded(got.select("round", "composite_rank_ic", "score_rows", "round_best_rank_ic", "admitted_factors"))


@query("history_delta", f"""{HISTORY} SELECT CAST(round AS BIGINT) AS round, {out("composite_rank_ic - lag(composite_rank_ic) OVER (ORDER BY round)", "composite_rank_ic_change")},
    CAST(len(list_filter(string_split(admitted_factors, ','), lambda x: trim(x) <> '')) AS BIGINT) AS accepted_factor_count FROM history""")
def history_delta(spark, sf):
    return rounded(S.deltas(history(spark, sf)).select("round", "composite_rank_ic_change", "accepted_factor_count"))


@query("round_record", f"""{HISTORY} SELECT CAST(round AS BIGINT) AS round, 'built' AS status, CAST(NULL AS BIGINT) AS component_count, score_rows,
    {out("composite_rank_ic", "composite_rank_ic")}, 'rank_ic' AS composite_rank_ic_name, {out("round_best_rank_ic", "round_best_rank_ic")},
    'm' || round AS round_best_module, round % 2 = 0 AS round_best_improved, 'done' AS composite_analysis_status, 'a.json' AS composite_analysis_json,
    CASE WHEN admitted_factors = '' THEN 'rejected' ELSE 'accepted' END AS admission_status, 'only' || round AS admitted_factor,
    CASE WHEN admitted_factors = '' THEN 'only' || round ELSE admitted_factors END AS admitted_factors, 'c.csv' AS composite_factor_csv, 'w.json' AS weights_json,
    CAST(NULL AS VARCHAR) AS portfolio_json, {out("composite_rank_ic * 2", "cumulative_return")}, {out("composite_rank_ic", "cumulative_return_after_cost")},
    0.5::DOUBLE AS cumulative_benchmark_return, {out("composite_rank_ic - 0.5", "cumulative_excess_return_after_cost")}, CAST(NULL AS DOUBLE) AS latest_return_after_cost,
    CAST(50 AS BIGINT) AS topk, CAST(5 AS BIGINT) AS n_drop, score_rows AS prediction_rows, '2024-01-01' AS prediction_start, '2024-02-01' AS prediction_end,
    CASE WHEN round % 5 = 0 THEN 'ValueError' END AS error_type, CASE WHEN round % 5 = 0 THEN 'bad round ' || round END AS error FROM history""")
def round_record(spark, sf):
    """A nested round result flattened to the history row; some parts are not there."""
    h, word = history(spark, sf), lambda text: F.concat(F.lit(text), F.col("round").cast("string"))
    ic, bad = F.col("composite_rank_ic"), F.col("round") % 5 == 0
    inner = F.struct(
        (ic * 2).alias("cumulative_return"), ic.alias("cumulative_return_after_cost"), F.lit(0.5).alias("cumulative_benchmark_return"),
        (ic - 0.5).alias("cumulative_excess_return_after_cost"), F.lit(50).cast("bigint").alias("topk"), F.lit(5).cast("bigint").alias("n_drop"),
        F.col("score_rows").alias("prediction_rows"), F.lit("2024-01-01").alias("prediction_start"), F.lit("2024-02-01").alias("prediction_end"),
    )
    nested = h.select(
        "round",
        F.struct(
            F.lit("built").alias("status"), "score_rows", "composite_rank_ic", F.lit("rank_ic").alias("composite_rank_ic_name"),
            F.struct(F.lit("done").alias("status")).alias("composite_analysis"), F.lit("a.json").alias("composite_analysis_json"),
            F.lit("c.csv").alias("composite_factor_csv"), F.lit("w.json").alias("weights_json"), inner.alias("portfolio"),
            F.when(bad, "ValueError").alias("error_type"), F.when(bad, word("bad round ")).alias("error"),
        ).alias("portfolio"),
        F.struct(
            F.when(F.col("admitted_factors") == "", "rejected").otherwise("accepted").alias("status"),
            word("only").alias("factor_name"),
            F.transform(F.split("admitted_factors", ","), lambda v: F.struct(v.alias("factor_name"))).alias("accepted_candidates"),
        ).alias("admission"),
        F.struct(F.col("round_best_rank_ic").alias("best_ic"), word("m").alias("best_module"), (F.col("round") % 2 == 0).alias("improved")).alias("round_ic"),
    )
    got = S.round_record(nested)
    typed = {"component_count": "bigint", "portfolio_json": "string", "latest_return_after_cost": "double"}
    return rounded(got.withColumns({c: F.col(c).cast(t) for c, t in typed.items()}))


CURVES = """curves AS (SELECT CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) + 1 AS INTEGER) AS round, date_trunc('hour', ts) AS datetime,
    (avg(value) - 50) / 1000 AS strategy_return_after_cost, (min(value) - 50) / 1000 AS benchmark_return FROM events GROUP BY 1, 2)"""


def curves(spark, sf):
    v = F.col("value")
    return (
        V.table(spark, sf, "events")
        .groupBy(
            (F.datediff(F.to_date("ts"), F.lit("2024-01-01")) + 1).alias("round"),
            F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("datetime"),
        )
        .agg(((F.avg(v) - 50) / 1000).alias("strategy_return_after_cost"), ((F.min(v) - 50) / 1000).alias("benchmark_return"))
    )


@query("round_curves_scan", f"""WITH {CURVES} SELECT round, datetime, {out("strategy_return_after_cost", "strategy_return_after_cost")},
    {out("benchmark_return", "benchmark_return")} FROM curves""")
def round_curves_scan(spark, sf):
    """One CSV folder per round, with a line that has no date."""
    path = _path(spark, "curves")
    S.write_curves(curves(spark, sf), path)
    got = S.read_curves(spark, path)
    return got.select(
        "round", "datetime", *[rnd(c).alias(c) for c in ("strategy_return_after_cost", "benchmark_return")]
    )


@query("union_rounds", f"""{HISTORY}, {CURVES} SELECT round, {out("composite_rank_ic", "composite_rank_ic")}, NULL::TIMESTAMP AS datetime, NULL::DOUBLE AS benchmark_return FROM history
    UNION ALL SELECT round, NULL, datetime, {out("benchmark_return", "benchmark_return")} FROM curves""")
def union_rounds(spark, sf):
    left = history(spark, sf).select("round", rnd("composite_rank_ic").alias("composite_rank_ic"))
    right = curves(spark, sf).select("round", "datetime", rnd("benchmark_return").alias("benchmark_return"))
    return left.unionByName(right, allowMissingColumns=True)
