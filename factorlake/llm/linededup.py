"""Repeated lines, found by levelled sorted runs of line hashes.

Documents are taken in batches by falling id. A batch's line keys are
anti-joined with the runs: keys that no run knows are new, and since every
later batch has smaller ids, the largest id that holds such a key in this batch
is the largest of all, its keeper. The batch then adds its own run: a row per
key with its keeper (null if an earlier run has it) and how many documents of the
batch hold it. Runs are sorted by hash; when `FAN_IN` runs stand on a level they
are compacted into one of the next level. After the last batch all runs are
compacted, which gives the documents per key and the keeper.

A key in a third of all documents costs one row per map task: counts are added
up before every shuffle. The join that finds the lines to drop is an inner join
on the hash, which adaptive execution splits where one hash is hot.

Defined results: a null or empty text is one empty line. Rows of one id count as
one document; each loses its lines unless the id is the keeper. A null id holds
lines like any other document but is never a keeper while another id holds the line.
"""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import fold, fresh

MIN_CHARS = 40
MIN_DOCS = 5
BATCHES = 4
FAN_IN = 2
#: White space cut off both ends of a line. Fixed by the definition of a key.
BLANKS = " \t\n\x0b\x0c\r"


def line_key(line):
    return fold(F.trim(line, F.lit(BLANKS)))


def lines_of(text):
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_hash(key):
    """128 bits: enough that two different lines never meet."""
    return F.substring(F.unhex(F.sha2(key, 256)), 1, 16)


def hashed_lines(df: DataFrame, min_chars: int) -> DataFrame:
    """(id, row, at, h) of the lines of (id, row, body) that are long enough; `row` tells rows of one id apart."""
    lines = df.select("id", "row", F.posexplode(lines_of(F.col("body"))).alias("at", "line"))
    keyed = lines.select("id", "row", "at", line_key(F.col("line")).alias("k")).where(F.length("k") >= min_chars)
    return keyed.select("id", "row", "at", line_hash(F.col("k")).alias("h"))


def compact(runs: list[DataFrame]) -> DataFrame:
    """One sorted run from several: documents added up, the keeper of the run that has it."""
    joined = reduce(DataFrame.unionByName, runs)
    return materialize(
        joined.groupBy("h").agg(F.sum("docs").alias("docs"), F.max("keeper").alias("keeper")).sortWithinPartitions("h")
    )


def batch_run(batch: DataFrame, runs: list[DataFrame]) -> DataFrame:
    """The batch's own run; keepers only for hashes that no earlier run holds."""
    own = batch.groupBy("h").agg(F.sum("docs").alias("docs"), F.max("keeper").alias("keeper"))
    if not runs:
        return materialize(own.sortWithinPartitions("h"))
    own = materialize(own)
    known = reduce(DataFrame.unionByName, [r.select("h") for r in runs])
    new = own.join(known, "h", "left_anti")
    old = own.join(known.distinct() if len(runs) > 1 else known, "h", "left_semi")
    marked = new.unionByName(old.withColumn("keeper", F.lit(None).cast(own.schema["keeper"].dataType)))
    return materialize(marked.sortWithinPartitions("h"))


def line_runs(lines: DataFrame, batches: int = BATCHES) -> DataFrame:
    """(h, docs, keeper) over all lines, gathered batch by batch."""
    held = lines.groupBy("h", "id").agg(F.lit(1).cast("long").alias("docs")).withColumnRenamed("id", "keeper")
    shares = [i / batches for i in range(1, batches)]
    cuts = lines.agg(F.percentile_approx("id", shares, 200).alias("cuts")).first()["cuts"]
    cuts = sorted(set(cuts or []), reverse=True)
    # by falling id; a null id comes last
    bounds = list(zip([None, *cuts], [*cuts, None], strict=True))
    levels: list[list[DataFrame]] = [[]]
    for upper, lower in bounds:
        below = F.lit(True) if upper is None else F.col("keeper") < upper
        part = held.where(F.col("keeper").isNull() | below if lower is None else below & (F.col("keeper") >= lower))
        levels[0].append(batch_run(part, [r for level in levels for r in level]))
        for i in range(len(levels)):
            if len(levels[i]) >= FAN_IN:
                if i + 1 == len(levels):
                    levels.append([])
                levels[i + 1].append(compact(levels[i]))
                levels[i] = []
    runs = [r for level in levels for r in level]
    return runs[0] if len(runs) == 1 else compact(runs)


def drop_repeated(
    df: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES
) -> DataFrame:
    """All columns with the cleaned text, then n_lines (before dropping) and n_dropped."""
    body = F.coalesce(F.col(text), F.lit(""))
    # rows of one id are told apart by their text: equal rows get equal results
    docs = df.select(F.struct(*[F.col(c) for c in df.columns]).alias("doc"), F.col(key).alias("id"), F.xxhash64(body).alias("row"))
    flat = df.select(F.col(key).alias("id"), F.xxhash64(body).alias("row"), body.alias("body"))
    lines = materialize(hashed_lines(flat, min_chars))
    often = materialize(line_runs(lines, batches).where(F.col("docs") >= min_docs).select("h", "keeper"))
    gone = lines.join(often, "h").where(~F.col("id").eqNullSafe(F.col("keeper")))
    gone = gone.groupBy("id", "row").agg(F.collect_set("at").alias("gone"))
    gone = gone.select(F.col("id").alias("gone_id"), F.col("row").alias("gone_row"), "gone")
    joined = docs.join(gone, F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("row") == F.col("gone_row")), "left")
    full = joined.withColumn("lines", lines_of(F.col("doc")[text])).withColumn("gone", F.coalesce("gone", F.array().cast("array<int>")))
    # a set difference of places, so that a text costs its lines and not lines x dropped lines
    places = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    kept = F.array_join(F.transform(places, lambda i: F.get(F.col("lines"), i)), "\n")
    return full.select(
        *[(kept if c == text else F.col("doc")[c]).alias(c) for c in df.columns],
        F.size("lines").cast("long").alias(fresh(df, "n_lines")),
        F.size("gone").cast("long").alias(fresh(df, "n_dropped")),
    )
