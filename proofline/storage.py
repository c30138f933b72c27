"""Tables that must stay as they are while several jobs read them, written to the folder that all executors share; and rows dealt out to tasks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a task where a row takes long, and the most tasks that rows are dealt out to.
TASK_ROWS, MOST_TASKS = 8_000, 2_000


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only a session whose tasks run in this process may leave it unset: it gets a local one."""
    found = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="proofline-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def place(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read back: what depends on partitioning (numbers by place) is fixed, lost executors only cost a re-read."""
    path = place(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, rows: int = TASK_ROWS) -> DataFrame:
    """df's rows dealt out evenly, some `rows` a task. Files are split by bytes, and not within a row group: without this, one task reads a million short rows, however long each takes.

    The condition always holds. As it isn't deterministic, no later filter is evaluated before the rows are dealt out, in that one task.
    """
    n = min(-(-df.count() // rows), MOST_TASKS)
    return df.repartition(n).where(F.spark_partition_id() >= 0) if n > df.rdd.getNumPartitions() else df
