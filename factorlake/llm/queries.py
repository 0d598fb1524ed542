"""Queries over the driver tables: each applies one operator to its whole table."""

import public_tokenizers
from pyspark.sql import functions as F

from . import bpe, html, language, linededup, lm, negatives, packing, phrases, quality, simhash, toxicity, vectors, warc
from .common import held, table
from .registry import ORACLES, QUERIES, query

__all__ = ["ORACLES", "QUERIES"]

_BLANK = "chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"
_UPPER, _LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"


@query(
    "op3_line_dedup",
    f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT r, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM docs),
keyed AS (SELECT *, translate(trim(line, {_BLANK}), {_UPPER}, {_LOWER}) AS k FROM lines),
often AS (SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
flags AS (SELECT r, doc_id, line, i, keeper IS NOT NULL AND keeper <> doc_id AS gone FROM keyed LEFT JOIN often USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM flags GROUP BY r, doc_id""",
)
def op3_line_dedup(spark, sf):
    done = linededup.drop_repeated(table(spark, sf, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query(
    "op8_warc_segments",
    """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
k AS (SELECT payload_digest, max(page_id) AS keeper FROM p WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN keeper <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN keeper <> page_id THEN keeper END AS refers_to
FROM p LEFT JOIN k USING (payload_digest)""",
)
def op8_warc_segments(spark, sf):
    back = warc.round_trip(table(spark, sf, "pages"))
    number = lambda c: F.when(F.col(c) != "", F.col(c)).cast("long")
    return back.select(
        number("page").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to")
    )


@query("op9_bpe_codec")
def op9_bpe_codec(spark, sf):
    path = public_tokenizers.path("byte_bpe_50k.json")
    coded = bpe.encode(table(spark, sf, "documents"), path, decoded=True)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op1_toxicity_cnn")
def op1_toxicity_cnn(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    net = toxicity.fit(docs, labels, where=~held(1, 3))
    done = toxicity.scored(docs.select("doc_id", "text"), net)
    predicted = (F.col("score") >= toxicity.THRESHOLD).cast("int")
    return done.select("doc_id", held(1, 3).alias("held_out"), "score", predicted.alias("predicted"))


@query("op2_simhash_anchors")
def op2_simhash_anchors(spark, sf):
    groups = simhash.near_groups(table(spark, sf, "documents"))
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return groups.select(F.col("id").alias("doc_id"), hexed.alias("fingerprint"), F.col("component").alias("component_id"))


@query("op4_html_main_text")
def op4_html_main_text(spark, sf):
    pages = table(spark, sf, "pages")
    done = html.extracted(pages.select("page_id", "url", "html"), html.fit(pages))
    return done.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query(
    "op5_vector_pivots",
    """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
    AND len([x for x in embedding if x <> 0]) > 0),
pairs AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v AS a JOIN v AS b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
          WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT reach.a, pairs.b FROM reach JOIN pairs ON reach.b = pairs.a),
roots AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
counts AS (SELECT a, count(*) AS n_links FROM pairs GROUP BY a)
SELECT e.vec_id, coalesce(n_links, 0) AS n_links, coalesce(component_id, e.vec_id) AS component_id,
       e.vec_id = coalesce(component_id, e.vec_id) AS kept
FROM embeddings AS e LEFT JOIN roots ON roots.a = e.vec_id LEFT JOIN counts ON counts.a = e.vec_id""",
)
def op5_vector_pivots(spark, sf):
    done = vectors.near_vectors(table(spark, sf, "embeddings"))
    kept = F.col("id") == F.col("component")
    return done.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), kept.alias("kept"))


@query("op6_bm25_packing")
def op6_bm25_packing(spark, sf):
    return packing.pack(table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op7_line_field")
def op7_line_field(spark, sf):
    docs = quality.judged(table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "labels"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share")
    return docs.select("doc_id", *[F.col("verdict")[c].alias(c) for c in names])


@query("op10_backoff_automaton")
def op10_backoff_automaton(spark, sf):
    docs = table(spark, sf, "documents")
    out = lm.log_probabilities(docs, ~held(1, 5))
    return out.select(F.col("id").alias("doc_id"), held(1, 5, "id").alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query(
    "op11_phrase_rollup",
    f"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), {_UPPER}, {_LOWER}) AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
t AS (SELECT lang, ws, unnest(generate_series(1, len(ws))) AS i FROM w),
n AS (SELECT lang, count(*) AS n FROM t GROUP BY lang),
f AS (SELECT lang, g, count(*) AS f FROM (
        SELECT lang, unnest([ws[i:i + k] FOR k IN range(4) IF i + k <= len(ws)]) AS g FROM t) GROUP BY lang, g HAVING count(*) >= 30),
cut AS (SELECT lang, g, f AS a, unnest(range(1, len(g))) AS k FROM f WHERE len(g) > 1),
scored AS (SELECT cut.lang, cut.g, a, k, l.f AS l, r.f AS r, (2000000::HUGEINT * a) // (l.f + r.f) AS score
           FROM cut JOIN f AS l ON l.lang = cut.lang AND l.g = cut.g[1:k] JOIN f AS r ON r.lang = cut.lang AND r.g = cut.g[k + 1:]),
low AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
heads AS (SELECT lang, f, g, unnest(range(1, len(g))) AS i FROM f WHERE len(g) > 2),
spans AS (SELECT lang, f, g, i, unnest(range(i + 1, len(g) + 1)) AS j FROM heads),
inside AS (SELECT lang, f, g[i:j] AS g FROM spans WHERE j - i + 1 < len(g)),
kept AS (SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, score FROM low
         WHERE NOT EXISTS (SELECT 1 FROM inside WHERE inside.lang = low.lang AND inside.g = low.g AND 100::HUGEINT * inside.f >= 80::HUGEINT * low.a)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n.n, score::BIGINT AS score FROM ranked JOIN n USING (lang) WHERE rank <= 2000""",
)
def op11_phrase_rollup(spark, sf):
    return phrases.collocations(table(spark, sf, "documents"))


@query("op12_hyper_language")
def op12_hyper_language(spark, sf):
    docs = table(spark, sf, "documents")
    model = language.fit(docs, where=~held(2, 4))
    done = language.predicted(docs.select("doc_id", "text"), model)
    return done.select("doc_id", held(2, 4).alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"))


@query(
    "op13_anchor_lists",
    """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  [floor(256 * x::DOUBLE) FOR x IN embedding] AS q
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
      FROM v AS a JOIN v AS b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (SELECT p.*, id AS negative_id, score AS negative_score,
             row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::INTEGER AS rank
      FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5""",
)
def op13_anchor_lists(spark, sf):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(table(spark, sf, "embeddings"), F.col("id") % 100 == 0, label=label)
