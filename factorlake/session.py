"""Session helpers: where intermediate tables go, and how large a broadcast may be."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables written by this process; `drop_tables` removes them.
WRITTEN: list[str] = []
CHECKPOINT_KEY = "spark.checkpoint.dir"
BROADCAST_ROWS_KEY = "factorlake.broadcast.rows"
DEFAULT_BROADCAST_ROWS = 500_000
CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only for a local session without it."""
    sc = spark.sparkContext
    path = spark.conf.get(CHECKPOINT_KEY, None) or sc.getConf().get(CHECKPOINT_KEY)
    path = path or sc.getCheckpointDir()
    if path is None:
        if not sc.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_KEY} to a folder every executor can reach")
        path = tempfile.mkdtemp(prefix="factorlake-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


def materialize(df: DataFrame) -> DataFrame:
    """Write a table into the shared folder and read it back.

    Cuts lineage like a reliable checkpoint, survives the loss of executors, and
    stays columnar, so a later step reads only the columns it needs.
    """
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    WRITTEN.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize_alone(df: DataFrame) -> DataFrame:
    """`materialize` that leaves only the table on disk: shuffle files of the write go at its end, not when the driver next collects garbage."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP_KEY, None)
    conf.set(CLEANUP_KEY, "true")
    try:
        return materialize(df)
    finally:
        conf.unset(CLEANUP_KEY) if before is None else conf.set(CLEANUP_KEY, before)


def drop_table(df: DataFrame) -> None:
    """Deletes the stored table that `materialize` gave, once nothing reads it any more."""
    names = {p.rsplit("/", 2)[1] for p in df.inputFiles()}
    conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for path in [p for p in WRITTEN if p.rsplit("/", 1)[1] in names]:
        at = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)
        WRITTEN.remove(path)


def drop_tables(spark: SparkSession) -> int:
    """Deletes the intermediate tables of this process, at the end of a run; results read from them must be stored before."""
    jvm, count = spark.sparkContext._jvm, 0
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    while WRITTEN:
        path = jvm.org.apache.hadoop.fs.Path(WRITTEN.pop())
        count += path.getFileSystem(conf).delete(path, True)
    return count


def broadcast_rows(spark: SparkSession) -> int:
    return int(spark.conf.get(BROADCAST_ROWS_KEY, str(DEFAULT_BROADCAST_ROWS)))


def small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast hint only where the known row count is under the bound."""
    return F.broadcast(df) if rows <= broadcast_rows(df.sparkSession) else df
