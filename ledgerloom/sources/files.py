"""The dump folder: every file once, with what its name and size tell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import file_name, file_suffix, safe_name
from ..operators.reports import first_seen
from .staging import staged

#: The largest file that is read, and types by suffix.
LARGEST = 100 * 1024 * 1024
MIME = {".pdf": "application/pdf", ".json": "application/json", ".xml": "text/xml", ".txt": "text/plain", ".csv": "text/csv", ".zip": "application/zip", ".xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", ".xls": "application/vnd.ms-excel", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".png": "image/png", ".webp": "image/webp", ".tif": "image/tiff", ".tiff": "image/tiff", ".bmp": "image/bmp"}


def mime(path: Column | str) -> Column:
    suffix, out = file_suffix(path), F.lit(None).cast("string")
    for k, v in MIME.items():
        out = F.when(suffix == k, v).otherwise(out)
    return out


def visible(path: Column) -> Column:
    """Not a dot-file, nor below a dot-folder or __MACOSX."""
    return ~path.rlike(r"(^|[/\\])(\.[^/\\]+|__MACOSX)([/\\]|$)")


def listed(paths: DataFrame) -> DataFrame:
    """paths (path, length, ...) with name, suffix, mime, size_status, stored_name: columns of the path and the length alone."""
    return paths.withColumns({"name": file_name("path"), "suffix": file_suffix("path"), "mime": mime("path"), "size_status": F.when(F.col("length") > LARGEST, "oversize").otherwise("ok"), "stored_name": F.concat(F.substring(F.sha2("path", 256), 1, 8), F.lit("_"), safe_name(file_name("path")))})


def listing(paths: DataFrame) -> DataFrame:
    """paths (path, length, ...) without hidden files and repeats (compared in lower case), with the columns of listed().

    No file is cut off silently: too large ones stay with size_status oversize.
    """
    return listed(first_seen(paths.where(visible(F.col("path"))), "path", ["path"]))


def repeats(paths: DataFrame) -> DataFrame:
    """path of the files that listing() leaves out as repeats of another one."""
    key = F.lower("path").alias("key")
    first = paths.groupBy(key).agg(F.min("path").alias("first"), F.count("*").alias("n")).where("n > 1")
    return paths.select(key, "path").join(first, "key").where(F.col("path") != F.col("first")).select("path")


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """All files below a folder with their content; the content of too large ones is null. Lengths are filtered before contents are read.

    Only paths are compared and shuffled: files that repeat another one's path, which are few, are taken out where they are read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    seen = files.where(visible(F.col("path")))
    small = seen.where(F.col("length") <= LARGEST).select("path", "length", "modificationTime", "content")
    large = seen.where(F.col("length") > LARGEST).select("path", "length", "modificationTime", F.lit(None).cast("binary").alias("content"))
    again = staged(repeats(seen.select("path")))
    if again.isEmpty():
        return listed(small.unionByName(large))
    return listed(small.unionByName(large).join(again, "path", "left_anti"))


def apart(folders: list[str]) -> list[str]:
    """The folders without those that lie in another one, so that no file is listed twice."""
    ends = sorted({f.rstrip("/") + "/" for f in folders})
    return [f.rstrip("/") for f in ends if not any(f != g and f.startswith(g) for g in ends)]


def listed_files(spark: SparkSession, folders: list[str]) -> DataFrame:
    """path, length, modified of all files below the folders; no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folders)
    return files.where(visible(F.col("path"))).select("path", "length", F.col("modificationTime").alias("modified"))


#: Files whose rows are sent to all tasks at a time, and paths that are opened one by one instead of by their folders.
BLOCK, PATHS = 100_000, 10_000


def with_content(spark: SparkSession, files: DataFrame, folders: list[str]) -> DataFrame:
    """files (path, ...) with content; null where there is no file or it is too large.

    The rows of files go to where contents are read, a bounded block at a time, so no content is ever shuffled. A few files are opened by their paths,
    so that the others are not read at all.
    """
    n = files.count()
    if not n or not folders:
        return files.withColumn("content", F.lit(None).cast("binary"))
    have = listed_files(spark, folders).where(F.col("length") <= LARGEST).select("path")
    there = staged(files.join(have, "path", "left_semi"))
    few = [r[0] for r in there.select("path").distinct().collect()] if n <= PATHS else None
    if few == []:
        return files.withColumn("content", F.lit(None).cast("binary"))
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(few or folders)
    small = read.where(F.col("length") <= LARGEST).select("path", "content")
    blocks = -(-n // BLOCK)
    out = files.join(have, "path", "left_anti").withColumn("content", F.lit(None).cast("binary"))
    for k in range(blocks):
        own = there.where(F.pmod(F.xxhash64("path"), F.lit(blocks)) == k)
        out = out.unionByName(small.join(F.broadcast(own), "path").select(*out.columns))
    return out
