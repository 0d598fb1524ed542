"""Report texts and tokens: each text is read once, in tasks that do not depend on the input's splits."""

import time

from pyspark.sql import functions as F

from factorlake.functions import text as X
from factorlake.operators import reports as Rp
from factorlake.plans import journal as J

TEXT = """# Round
## Error Frequency
- error_type=KeyError; count=2; count=9; cause=; evidence=line 1; fix=add it
- keyerror: second
* none: nothing
## Recommended Directions (P_succ)
- Hypothesis: one
  reason: works
## Forbidden Directions (P_fail)
* two
"""


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def texts(spark, n=40):
    return spark.range(n, numPartitions=1).select("id", F.concat(F.lit(TEXT), F.lit("- three "), "id").alias("text"))


def test_error_section_is_searched_once_behind_one_shuffle(spark):
    got = Rp.error_reports(texts(spark), "id", "text")
    assert plan(got).count("Exchange hashpartitioning") == 1
    assert plan(got).count("error frequency") == 2  # one pattern, which names its heading twice
    rows = got.orderBy("id").collect()
    assert len(rows) == 40
    got = rows[0].asDict()
    assert (got["error_type"], got["count"], got["evidence"], got["fix"]) == ("KeyError", 3, "line 1", "add it")


def test_failures_keep_their_tasks(spark, sf):
    assert plan(J._failures(spark, sf)).count("Exchange hashpartitioning(candidate_index") == 1


def test_directions_are_shuffled_once(spark):
    records = Rp.direction_reports(texts(spark), "id", "text")
    got = Rp.direction_metadata(records, "id")
    assert plan(got).count("Exchange hashpartitioning") == 1
    lists = {r["name"]: r["values"] for r in got.where("id = 7").collect()}
    assert lists == {"recommended_hypotheses": ["one"], "forbidden_hypotheses": ["two", "three 7"]}


def test_texts_of_a_task_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(Rp, "TEXTS_PER_TASK", 2)
    assert Rp.by_key(texts(spark, 64), "id").rdd.getNumPartitions() == 32


def test_token_of_long_texts(spark):
    odd = [" aKİ b", "_-_", "", None, "x" * 63 + "  y", "x" * 64 + "y", "é" * 200 + "z", "a" + " " * 150_000 + "b", ("ab " * 60)]
    begun = time.time()
    got = [r.t for r in spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "i int, t string").select("i", X.safe_token("t").alias("t")).orderBy("i").collect()]
    assert got == ["aki_b", "pattern", "pattern", "pattern", "x" * 63, "x" * 64, "z", "a_b", ("ab_" * 21 + "a")]
    assert time.time() - begun < 10
