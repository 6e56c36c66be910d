"""Durable tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Parquet's writer looks at its buffers from the first row on, so few rows of long texts don't fill them.
WIDE_ROWS = {"parquet.block.size.row.check.min": "1", "parquet.page.size.row.check.min": "1"}


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir.  Only a local session may do without the setting; on a
    cluster a folder of one machine would lose rows, so it is an error there."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/textlake-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` and reads it back: the table cuts the lineage and outlives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.options(**WIDE_ROWS).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
