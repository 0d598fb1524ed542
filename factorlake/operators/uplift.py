"""Do factors add to base features?  Two boosted-tree models on the same segments."""

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .composite import train_valid_test
from .ic import prediction_ic
from .panel import KEYS


def feature_frame(label: DataFrame, *features: DataFrame) -> DataFrame:
    """Feature tables and the label on (time, code); only rows with a label stay."""
    out = label.where("label IS NOT NULL")
    for f in features:
        out = out.join(f, KEYS, "left")
    return out


def augmented_uplift(
    frame: DataFrame, base: Sequence[str], factors: Sequence[str], start: str, end: str, trees: int = 10, depth: int = 4
) -> DataFrame:
    """Rank IC, daily rank IC and ICIR on the test segment with and without the factors.

    `frame` has (trade_time, code, label, base..., factors...).
    """
    cut = materialize(train_valid_test(frame.where("label IS NOT NULL"), start, end))
    train, test = cut.where("segment = 'train'"), cut.where("segment = 'test'")
    rows = []
    for name, cols in (("baseline", list(base)), ("augmented", [*base, *factors])):
        pack = VectorAssembler(inputCols=cols, outputCol="features")
        fill = lambda df, cols=cols: pack.transform(df.fillna(0.0, cols))
        model = GBTRegressor(labelCol="label", maxIter=trees, maxDepth=depth, seed=7, cacheNodeIds=False)
        pred = model.fit(fill(train)).transform(fill(test)).select(*KEYS, F.col("prediction").alias("score"))
        rows.append(prediction_ic(test.select(*KEYS, "label"), materialize(pred)).withColumn("model", F.lit(name)))
    both = rows[0].unionByName(rows[1])
    return both.select("model", "rank_ic", "daily_rank_ic_mean", "icir", "joined_rows", "nan_reason")
