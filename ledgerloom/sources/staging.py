"""Intermediate tables that a plan of several rounds writes to the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_place(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; a local session without it gets a folder of its own, a cluster an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="ledgerloom-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def staged(df: DataFrame) -> DataFrame:
    """df, written once and read back: later steps don't compute it again, and a lost executor costs none of it. It lasts as long as the session's JVM."""
    spark = df.sparkSession
    folder = f"{shared_place(spark)}/staged/{spark.sparkContext.applicationId}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    table, schema = f"{folder}/{uuid.uuid4().hex}", df.schema
    df.write.parquet(table)
    return spark.read.schema(schema).parquet(table)
