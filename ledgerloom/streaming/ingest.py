"""Incremental ingest: new files of the drop folder, classified and written once each."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType

from ..operators.classify import classify
from ..sources.containers import content_clues
from ..sources.files import LARGEST, listing
from ..sources.snapshots import Snapshots
from ..sources.staging import staged


def overwrite_partitions(rows: DataFrame, path: str, by: list[str]) -> None:
    """Replace just the partitions that rows has, atomically for each; running it again gives the same table."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def classified_files(files: DataFrame) -> DataFrame:
    """Files with content as bytes to the listing with kind, confidence, reason, told from names and contents."""
    told = classify(content_clues(files, LARGEST))
    return listing(told.select("path", "length", "modificationTime", F.col("verdict.kind").alias("detected_kind"), F.col("verdict.confidence").alias("confidence"), F.col("verdict.reason").alias("classify_reason")))


def ingest_folder(spark: SparkSession, folder: str, table: str, checkpoint: str) -> StreamingQuery:
    """Take in all files that came since the last call, then stop. A batch that is run again after a failure overwrites its own partition."""
    stream = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", True).load(folder)

    def write(batch: DataFrame, number: int) -> None:
        overwrite_partitions(classified_files(batch).withColumn("batch", F.lit(number)), table, ["batch"])

    return stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(write).start()


def run_available(spark: SparkSession, folder: str, schema: StructType, glob: str, change: Callable[[DataFrame], DataFrame], table: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Stream the parquet files of a folder that match the pattern through `change` into a parquet table, until none is left; its rows."""
    stream = spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(folder)
    query = change(stream).writeStream.trigger(availableNow=True).outputMode(mode).option("checkpointLocation", checkpoint).format("parquet").option("path", table).start()
    query.awaitTermination()
    return spark.read.parquet(table)


STATE = "told long, at timestamp, changes long"


def changed(stream: DataFrame, key: str, at: str, columns: list[str]) -> DataFrame:
    """key, at, changes and the columns of each delivery of a stream that changed its key's columns: what was delivered before, and late deliveries, are
    no work. changes counts the times that a key has changed, its first delivery included.

    The state of a key is a hash of what it was last, so content that comes back after another one is a change again. Of the deliveries of a key in one batch the
    latest by `at` counts for each of its changes, in order. The state grows with the number of keys, by a few bytes each.
    """
    told = F.xxhash64(*columns).alias("__told")
    own = stream.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(key, F.col(at).cast("timestamp").alias("at"), *columns, told)

    def latest(found: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, when, changes = state.get if state.exists else (None, None, 0)
        held = list(frames)
        rows = held[0] if len(held) == 1 else pd.concat(held)
        if len(rows) > 1:
            rows = rows.sort_values(["at", "__told"])
        row = None
        for k, (hashed, moment) in enumerate(zip(rows["__told"], rows["at"], strict=True)):
            if (when is None or moment >= pd.Timestamp(when)) and (last is None or hashed != last):
                last, when, changes, row = int(hashed), moment.to_pydatetime(), changes + 1, k
        if row is not None:
            state.update((last, when, changes))
            yield pd.DataFrame({c: [changes] if c == "changes" else rows[c].iloc[row : row + 1].array for c in (key, "at", "changes", *columns)})

    schema = StructType([own.schema[key], own.schema["at"], StructField("changes", LongType()), *[own.schema[c] for c in columns]])
    return own.groupBy(key).applyInPandasWithState(latest, schema, STATE, "append", GroupStateTimeout.NoTimeout)


def upsert(sets: Snapshots, name: str, key: str, rows: DataFrame, buckets: int = 8) -> None:
    """Replace the rows of the keys that rows has, and leave all others: in each of so many buckets by hash of the key that has any, as one snapshot. Running
    it again with the same rows gives the same table."""
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets))
    rows = staged(rows)
    for r in rows.select(bucket.alias("b")).distinct().collect():
        place, new = f"{name}-{r['b']}", rows.where(bucket == r["b"])
        old = sets.read(name, place)
        sets.write(place, {name: new if old is None else old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)})


def upsert_stream(stream: DataFrame, sets: Snapshots, name: str, key: str, at: str, columns: list[str], checkpoint: str, derive: Callable[[DataFrame], DataFrame] = lambda df: df, buckets: int = 8) -> StreamingQuery:
    """Keep a table of what the latest content of each key gives: of each batch only keys that have changed are derived, and only their rows replaced.

    derive makes rows, with the key, of the rows of changed(), say by reading and parsing the files that they name; it sees no delivery twice, unless a
    batch is run again after a failure, which gives the same table.
    """

    def write(batch: DataFrame, _: int) -> None:
        upsert(sets, name, key, derive(batch), buckets)

    made = changed(stream, key, at, columns)
    return made.writeStream.trigger(availableNow=True).outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(write).start()
