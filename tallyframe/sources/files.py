"""CSV tables, file fingerprints, change detection.

A fingerprint is the SHA-256 of a file of one range (``RANGE`` bytes at most); the
ranges of a larger file are digested in parallel, and its fingerprint is the SHA-256
of their digests in order.  No file is ever held in one row or task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RANGE = 64 << 20
_CHUNK = 4 << 20


def read_csv(
    spark: SparkSession, path: str | Sequence[str], schema: T.StructType | str | None = None
) -> DataFrame:
    """CSV with a header row; names are trimmed.  Give the schema where it is
    known: inference reads the files once more."""
    reader = spark.read.option("header", True).option("multiLine", False)
    reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
    df = reader.csv(path)
    return df.toDF(*[c.strip() for c in df.columns])


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def _mtime() -> Column:
    return (F.unix_micros("modificationTime") / 1e6).alias("mtime")


def file_times(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """``path, mtime, length`` from file metadata alone; no content is read.

    Spark's listing leaves out empty files.
    """
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths)
    return df.select("path", _mtime(), "length")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each byte range, read piece by piece."""
    for batch in batches:
        found = []
        for row in batch.to_pylist():
            fs, name = _opened(row["path"])
            digest, left = hashlib.sha256(), row["size"]
            with fs.open_input_file(name) as file:
                file.seek(row["offset"])
                while left:
                    data = file.read(min(left, _CHUNK))
                    if not data:
                        raise OSError(f"{row['path']} became shorter while it was read")
                    digest.update(data)
                    left -= len(data)
            found.append(digest.digest())
        yield batch.append_column("digest", pa.array(found, pa.binary()))


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and name of a path as Spark lists it (``file:/a b`` or ``scheme://host/a b``)."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(quote(path, safe=":/@"))


def digests(files: DataFrame, size: int | None = None) -> DataFrame:
    """``files`` (path, length, ...) with ``sha256``, the fingerprint of the content.

    Ranges are dealt out over all tasks, so one huge file is read by many.
    """
    size = size or RANGE
    last = F.greatest(F.floor((F.col("length") - 1) / size), F.lit(0)).cast("long")
    ranges = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("part"))
    ranges = ranges.select(
        "path", (F.col("part") * size).alias("offset"),
        F.least(F.lit(size), F.col("length") - F.col("part") * size).cast("long").alias("size"),
    )
    done = ranges.repartition("path", "offset").mapInArrow(_digest, "path string, offset long, size long, digest binary")
    # 32 bytes for each range of a file
    tree = done.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("offset", "digest"))).alias("parts"))
    joined = F.aggregate("parts", F.unhex(F.lit("")), lambda all_, p: F.concat(all_, p["digest"]))
    one = F.lower(F.hex(F.col("parts")[0]["digest"]))
    hashed = tree.select("path", F.when(F.size("parts") == 1, one).otherwise(F.sha2(joined, 256)).alias("sha256"))
    return files.join(hashed, "path")


def fingerprints(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """``path, sha256, mtime, length`` of files of any size."""
    return digests(file_times(spark, paths)).select("path", "sha256", "mtime", "length")


def same_time(a: Column, b: Column) -> Column:
    return F.coalesce((b > 0) & (F.abs(a - b) < 0.001), F.lit(False))


def detect_changes(current: DataFrame, catalog: DataFrame) -> DataFrame:
    """``path, mtime, sha256, changed`` for every catalogued file that exists.

    Same modification time: unchanged.  Else the content hash decides.  The
    time and hash kept for an unchanged file are the ones to record next.
    """
    known = catalog.select("path", F.col("sha256").alias("_hash"), F.col("mtime").alias("_time"))
    both = current.join(known, "path")
    same = same_time(F.col("mtime"), F.col("_time"))
    differs = ~F.col("sha256").eqNullSafe(F.col("_hash"))
    return both.select(
        "path",
        F.when(same, F.col("_time")).otherwise(F.col("mtime")).alias("mtime"),
        F.when(same, F.col("_hash")).otherwise(F.col("sha256")).alias("sha256"),
        (~same & differs).alias("changed"),
    )


def check_files(spark: SparkSession, paths: str | Sequence[str], catalog: DataFrame) -> DataFrame:
    """``path, mtime, sha256, changed, opened`` of every catalogued file that exists.

    Two tiers in one plan: the times of all files come from the listing, and only
    files whose time moved go on to be read (``opened``).  No path passes the driver.
    """
    known = catalog.select("path", F.col("sha256").alias("_hash"), F.col("mtime").alias("_time"))
    both = file_times(spark, paths).join(known, "path")
    same = same_time(F.col("mtime"), F.col("_time"))
    still = both.filter(same).select(
        "path", F.col("_time").alias("mtime"), F.col("_hash").alias("sha256"), F.lit(False).alias("changed"), F.lit(False).alias("opened")
    )
    moved = digests(both.filter(~same)).select(
        "path", "mtime", "sha256", (~F.col("sha256").eqNullSafe(F.col("_hash"))).alias("changed"), F.lit(True).alias("opened")
    )
    return still.unionByName(moved)


def changed_files(spark: SparkSession, paths: str | Sequence[str], catalog: DataFrame) -> DataFrame:
    """The files of :func:`check_files` whose content changed."""
    return check_files(spark, paths, catalog).filter("changed").drop("opened")
