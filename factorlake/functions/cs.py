"""Cross-section functions: windows over the names of one date."""

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from .ranks import avg_rank, pct_rank

CROSS = ["t", "seg"]


def cs_rank(x) -> Column:
    return avg_rank(x, CROSS)


def cs_pct_rank(x) -> Column:
    return pct_rank(x, CROSS)


def cs_demean(x) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    return x - F.avg(x).over(Window.partitionBy(*CROSS))
