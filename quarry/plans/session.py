"""Session helpers: the shared checkpoint folder and cutting lineage."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints that the cluster names; one of our own only where it names none and all runs in one process."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("on a cluster spark.checkpoint.dir has to name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quarry-"))
    return jsc.getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared folder and cut the lineage, so that lost executors cost no recomputation."""
    spark = df.sparkSession
    folder = shared_dir(spark)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """A table that is read in fewer pieces than the cluster has cores (one small file, one row group) is dealt out to all of them; one of more pieces
    is left as it is, so that large tables aren't shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


#: Rows of a few numbers that a task sorts or aggregates at most, where shuffles are dealt by ``pieces``.
TASK_ROWS = 1_000_000


def pieces(spark: SparkSession, rows: int) -> int:
    """Partitions for a shuffle of so many rows: the session's number, or more of them if a task would get more than TASK_ROWS."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))
