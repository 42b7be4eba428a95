"""Loading of the Parquet tables that queries work on, and folders that all executors share."""

import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a data folder; column pruning and filters reach the scan."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; where that is unset, below the warehouse of a local session. Clusters must name the folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints"
    return f"{base.rstrip('/')}/scriptorium-{uuid.uuid4().hex}"


#: Rows of a task in frames that are dealt by their number.
TASK_ROWS = 500_000


def parts_for(spark: SparkSession, rows: int) -> int:
    """How many partitions so many rows are dealt to, so that what a task holds doesn't grow with the table."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))


def stored(df: DataFrame) -> DataFrame:
    """Write a frame once below the shared folder and read it back, so that no later step computes it again."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
