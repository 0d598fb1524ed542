"""Bounded samples of labelled documents, which the classifiers are fitted on."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


GRAIN = 1 << 30


def sampled(df: DataFrame, keys: list[str], most: int) -> DataFrame:
    """At most `most` rows, nearly the first ones by the hash of their keys.

    Where there are many more, a bound on the hash leaves little more than wanted, so that all
    tasks together send that few rows and not `most` each.
    """
    n, mark = df.count(), F.pmod(F.xxhash64(*keys), F.lit(GRAIN))
    if n > 2 * most:
        df = df.where(mark < int(GRAIN * (1.2 * most + 100) / n))
    return df.orderBy(mark, *keys).limit(most)


def labelled(docs: DataFrame, labels: DataFrame, column: str, per_class: int, where=None, columns=("text",)) -> list:
    """Rows (label, *columns) of at most `per_class` ids of either label, the first ones in hash order.

    Ids without a label of 0 or 1, or null, are left out; an id with both counts as 1.
    """
    marks = labels.where(F.col("doc_id").isNotNull() & F.col(column).isin(0, 1)).groupBy("doc_id").agg(F.max(column).alias("label"))
    if where is not None:
        marks = marks.where(where)
    chosen: dict = {}
    for label in (0, 1):
        rows = sampled(marks.where(F.col("label") == label), ["doc_id"], per_class).collect()
        chosen |= {r["doc_id"]: label for r in rows}
    if not chosen:
        return []
    found = docs.where(F.col("doc_id").isin(list(chosen))).select("doc_id", *columns).collect()
    seen = {r["doc_id"]: r for r in sorted(found, key=str, reverse=True)}
    return [(chosen[i], *[seen[i][c] for c in columns]) for i in sorted(seen)]
