"""The factor library as an append-only event table.

A record is what the last `save` of its name says, with defaults for what it leaves out;
a later status change and the last review are put on top, and archive events are
appended to the review. Events are ordered by clock, writer and row, so two writers
never share a place in the order and nothing is read to append.
"""

import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..functions.text import NAME

# Legal states, and what a record has where a save says nothing.
STATUSES = ("candidate", "accepted", "rejected", "archived")
DEFAULTS = {"status": "candidate", "source": "rlm", "universe": "", "horizon": 1, "factor_shift": 1}
SCHEMA = """name string, at bigint, writer string, row bigint, kind string, description string, status string, source string,
 signal_class string, universe string, horizon int, factor_shift int, tags array<string>,
 ic double, metrics string, review string"""
FIELDS = ("description", "source", "signal_class", "universe", "horizon", "factor_shift", "tags", "ic", "metrics")
ORDER = ["at", "writer", "row"]


def latest(events: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """Last non-null value of each column per key, combined before the shuffle."""
    seq = F.struct(*order)
    return events.groupBy(key).agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), seq)).alias(c) for c in columns]
    )


class FactorStore:
    """Save, list, read, change status of and review factor records under one folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.writer = spark, path, uuid.uuid4().hex

    def events(self) -> DataFrame:
        try:
            return self.spark.read.schema(SCHEMA).parquet(self.path)
        except AnalysisException:
            return self.spark.createDataFrame([], SCHEMA)

    def _append(self, df: DataFrame, kind: str) -> None:
        cols = {n.split()[0]: n.split()[1] for n in SCHEMA.replace("\n", " ").split(", ")}
        full = df.withColumns({
            "at": F.lit(time.time_ns() // 1000), "writer": F.lit(self.writer), "row": F.monotonically_increasing_id(), "kind": F.lit(kind),
        })
        full = full.select(*[(F.col(c) if c in full.columns else F.lit(None)).cast(t).alias(c) for c, t in cols.items()])
        full.write.mode("append").parquet(self.path)

    def _require(self, names: DataFrame) -> None:
        """Unknown names raise."""
        unknown = names.select("name").join(self.events().where("kind = 'save'").select("name"), "name", "left_anti").limit(1).collect()
        if unknown:
            raise KeyError(f"factor not found: {unknown[0]['name']}")

    def save(self, records: DataFrame, overwrite: bool = False) -> None:
        """Append new versions; illegal names, doubled names and, without overwrite, known names raise."""
        bad = records.where(~F.coalesce(F.col("name").rlike(NAME), F.lit(False)))
        if bad.limit(1).count():
            raise ValueError(f"illegal factor name: {bad.first()['name']}")
        if records.groupBy("name").count().where("count > 1").limit(1).count():
            raise ValueError("a name occurs twice in one save")
        if not overwrite:
            known = records.join(self.events().select("name").distinct(), "name", "left_semi")
            if known.limit(1).count():
                raise FileExistsError(known.first()["name"])
        records = records.withColumns({c: F.lit(v) for c, v in DEFAULTS.items() if c not in records.columns})
        if "tags" not in records.columns:
            records = records.withColumn("tags", F.array().cast("array<string>"))
        self._check_status(records)
        self._append(records, "save")

    def _check_status(self, df: DataFrame) -> None:
        if df.where(~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False))).limit(1).count():
            raise ValueError(f"status must be one of {STATUSES}")

    def set_status(self, updates: DataFrame) -> None:
        """`updates` has (name, status)."""
        self._check_status(updates)
        self._require(updates)
        self._append(updates.select("name", "status"), "status")

    def add_review(self, updates: DataFrame) -> None:
        """`updates` has (name, review) with the review as JSON text; it replaces an earlier one."""
        self._require(updates)
        self._append(updates.select("name", "review"), "review")

    def archive(self, updates: DataFrame) -> None:
        """Status archived, and the event appended to the review's history; `updates` has (name, review) with the event as JSON text."""
        self._require(updates)
        self._append(updates.select("name", "review", F.lit("archived").alias("status")), "archive")

    def current(self) -> DataFrame:
        return records(self.events())

    def list(self, status: str | None = None) -> DataFrame:
        df = self.current()
        return (df if status is None else df.where(F.col("status") == status)).orderBy("name")

    def read(self, name: str) -> DataFrame:
        df = records(self.events().where(F.col("name") == name))
        if df.limit(1).count() == 0:
            raise KeyError(f"factor not found: {name}")
        return df

    def archive_history(self) -> DataFrame:
        """All archive events in their order."""
        return self.events().where("kind = 'archive'").select("name", *ORDER, "review").orderBy("name", *ORDER)


def records(events: DataFrame) -> DataFrame:
    """(name, fields, status, review) of each name: its last save, later status changes, its review with archive events.

    A name has few events, so those of one name are gathered.
    """
    seq, kind = F.struct(*ORDER), F.col("kind")
    of = lambda value, *kinds: F.max_by(value, F.when(kind.isin(*kinds), seq))
    marks = F.sort_array(F.collect_list(F.when(kind.isin("archive", "review"), F.struct(*ORDER, "kind", "review"))))
    one = events.groupBy("name").agg(
        *[of(c, "save").alias(c) for c in FIELDS],
        F.max(F.when(kind == "save", seq)).alias("saved"),
        of("status", "save").alias("first_status"),
        F.max(F.when(kind.isin("status", "archive"), seq)).alias("changed"),
        of("status", "status", "archive").alias("new_status"),
        marks.alias("marks"),
    )
    status = F.when(F.col("changed") > F.col("saved"), F.col("new_status")).otherwise(F.col("first_status"))
    return one.where("saved IS NOT NULL").select("name", *FIELDS, status.alias("status"), review_text(F.col("marks")).alias("review"))


def review_text(marks: Column) -> Column:
    """The last review with the archive events that came after it, as JSON text; NULL without either."""
    reviews = F.filter(marks, lambda m: m["kind"] == "review")
    last = F.try_element_at(reviews, F.lit(-1))
    later = F.filter(marks, lambda m: (m["kind"] == "archive") & (F.size(reviews).eqNullSafe(F.lit(0)) | (F.struct(*[m[c] for c in ORDER]) > F.struct(*[last[c] for c in ORDER]))))
    events = F.transform(later, lambda m: m["review"])
    inner = F.regexp_replace(F.coalesce(last["review"], F.lit("{}")), r"(?s)^\s*\{\s*|\s*\}\s*$", "")
    history = F.concat(
        F.lit("{"), inner, F.when(F.length(inner) > 0, F.lit(", ")).otherwise(F.lit("")),
        F.lit('"archive_history": ['), F.array_join(events, ", "), F.lit('], "latest_archive_event": '), F.try_element_at(events, F.lit(-1)), F.lit("}"),
    )
    return F.when(F.size(events) > 0, history).otherwise(last["review"])
