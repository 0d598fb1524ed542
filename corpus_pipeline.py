"""The corpus pipeline: five stages over `documents`, each written and read again before the next.

Every stage but the last returns the columns of the documents it got. A decision acts on all rows:
what quality or toxicity rejects is gone, repeated lines are cut out of the texts, of
near-duplicates one document stays, and what is left is packed into sequences.
"""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorlake.llm import linededup, packing, quality, simhash, toxicity
from factorlake.llm.common import fresh, table
from factorlake.session import materialize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what passes the base rules and is content by most of its words."""
    name = fresh(docs, "verdict")
    judged = quality.judged(docs, table(spark, sf_dir, "labels"), name=name)
    return judged.where(F.col(name)["kept"]).select(*docs.columns)


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what the classifier, trained on the labelled documents, scores below its threshold."""
    name = fresh(docs, "score")
    scored = toxicity.scored(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")), name=name)
    return scored.where(F.col(name) < toxicity.THRESHOLD).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated lines out of the texts; n_chars follows the text."""
    done = linededup.drop_repeated(docs)
    return done.select(*[F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else c for c in docs.columns])


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group whose SimHash fingerprints link, the one with the smallest id."""
    return simhash.first_of_groups(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 4096 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("toxicity", toxicity_filter),
    ("line_dedup", line_dedup),
    ("simhash_dedup", simhash_dedup),
    ("packing", pack),
]

#: Learned models and packing have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each result stored before the next stage."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
