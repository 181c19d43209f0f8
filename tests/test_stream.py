"""Streams of deliveries: what has changed is derived, once; everything else is no work."""

from pyspark.sql import functions as F

from ledgerloom.sources.snapshots import Snapshots
from ledgerloom.streaming import ingest

SCHEMA = "path string, at timestamp, body string, size long"


def deliver(spark, folder, *rows):
    spark.createDataFrame([(p, at, b, len(b or "")) for p, at, b in rows], "path string, at long, body string, size long").withColumn("at", F.timestamp_seconds("at")).coalesce(1).write.mode("append").parquet(folder)


def test_only_changes_are_derived(spark, tmp_path):
    folder, sets, derived = str(tmp_path / "in"), Snapshots(spark, str(tmp_path / "t")), []

    def derive(rows):
        derived.append(sorted(r["path"] for r in rows.collect()))
        # a file gives a row for each word
        return rows.select("path", "changes", F.explode(F.split("body", " ")).alias("word"))

    def run():
        stream = spark.readStream.schema(SCHEMA).parquet(folder)
        ingest.upsert_stream(stream, sets, "words", "path", "at", ["body", "size"], str(tmp_path / "c"), derive, buckets=3).awaitTermination()
        return sorted((r["path"], r["word"], r["changes"]) for r in sets.read("words").collect())

    deliver(spark, folder, ("a", 1, "one two"), ("b", 1, "three"), ("c", 1, None), (None, 1, "lost"), ("d", None, "lost"))
    assert run() == [("a", "one", 1), ("a", "two", 1), ("b", "three", 1)] and derived == [["a", "b", "c"]]
    # the same again, and nothing new: no rows to derive
    deliver(spark, folder, ("a", 2, "one two"), ("b", 2, "three"))
    assert run() == [("a", "one", 1), ("a", "two", 1), ("b", "three", 1)] and derived[1:] in ([], [[]])
    del derived[1:]
    # b changes; a late delivery of something older doesn't count; c gets a text
    deliver(spark, folder, ("b", 5, "four five"), ("a", 0, "older"), ("c", 5, "six"))
    assert run() == [("a", "one", 1), ("a", "two", 1), ("b", "five", 2), ("b", "four", 2), ("c", "six", 2)] and derived[1:] == [["b", "c"]]
    # what it was at first, after something else, is a change again; several in one batch count in their order
    deliver(spark, folder, ("b", 6, "three"), ("c", 6, "x"), ("c", 7, "six"), ("c", 8, "y"))
    assert run() == [("a", "one", 1), ("a", "two", 1), ("b", "three", 3), ("c", "y", 5)] and derived[2:] == [["b", "c"]]


def test_an_upsert_again_gives_the_same_table(spark, tmp_path):
    sets = Snapshots(spark, str(tmp_path / "t"))
    rows = lambda *x: spark.createDataFrame(list(x), "path string, n long")
    ingest.upsert(sets, "t", "path", rows(("a", 1), ("a", 2), ("b", 3)), 4)
    for _ in range(2):
        ingest.upsert(sets, "t", "path", rows(("a", 9)), 4)
        assert sorted(map(tuple, sets.read("t").collect())) == [("a", 9), ("b", 3)]
    ingest.upsert(sets, "t", "path", rows(), 4)
    assert sets.read("t").count() == 2


def test_deliveries_of_several_files_are_a_batch_each(spark, monkeypatch):
    """A delivery is dealt over files; each batch takes all of one, so a key's changes come in their order."""
    from ledgerloom.plans import table_queries

    from .conftest import DATA

    batches = []
    monkeypatch.setattr(table_queries, "upsert_stream", lambda stream, *a, keep=table_queries.upsert_stream, **k: batches.append(keep(stream, *a, **k)) or batches[0])
    table_queries.stream_upsert(spark, DATA).count()
    rows = [x["numInputRows"] for x in batches[0].recentProgress if x["numInputRows"]]
    keys = spark.read.parquet(f"{DATA}/events.parquet").select("user_id").distinct().count()
    assert rows == [keys] * 3 and table_queries.DELIVERED > 1
