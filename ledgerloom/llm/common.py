"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows that a Python task holds at once; texts may be long.
SLICE = 1024


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir.

    Where it is unset, a local session (one machine, as in tests) gets a folder of its own; a cluster is an error, as its executors don't see
    each other's disks.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="ledgerloom-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def _tables(spark: SparkSession):
    """The folder of this session's intermediate tables, as a Hadoop path, and its file system."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/tables/{spark.sparkContext.applicationId}")
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def forget(spark: SparkSession) -> None:
    """Delete the intermediate tables of this session now; results that were not written yet can't be read after this."""
    path, files = _tables(spark)
    files.delete(path, True)


def materialize(df: DataFrame) -> DataFrame:
    """Write df once to the shared folder and read it back: later steps neither recompute it nor lose it with an executor.

    The table lasts as long as the session's JVM, or until forget().
    """
    spark = df.sparkSession
    folder, files = _tables(spark)
    files.deleteOnExit(folder)
    path = f"{folder}/{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def slices(batches: Iterable[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most so many rows, so memory follows a few texts and not the batch size."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
