"""Rows as JSON documents, and snapshots of a dataset replaced as a whole.

A snapshot is a folder of its own.  What makes it the dataset is a manifest, a
small numbered file that names the folder and gets its place by a rename; readers
take the manifest with the highest number and stay with its folder.  A job that
ends before the rename leaves the dataset as it was, and a reader that has begun is
not disturbed by a new version: the one before is kept until the next replacement.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.functions.numbering import global_row_number

# Microseconds on both sides make the round trip exact.
_WRITE = {
    "ignoreNullFields": "false",
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}
_READ = {k: v for k, v in _WRITE.items() if k != "ignoreNullFields"}


def to_documents(
    df: DataFrame, dataset_id: str, order: Sequence[str | Column] | None = None
) -> DataFrame:
    """``dataset_id, row_index, record_json``; the index counts from 0 in ``order``.

    Without an order the rows keep the order in which the table is read.
    """
    order_names = {f"_o{i}": F.col(c) if isinstance(c, str) else c for i, c in enumerate(order or [])}
    docs = df.select(F.to_json(F.struct(*df.columns), _WRITE).alias("record_json"),
                     *[c.alias(n) for n, c in order_names.items()])
    numbered = global_row_number(docs, list(order_names) or None, "row_index")
    return numbered.select(F.lit(dataset_id).alias("dataset_id"), "row_index", "record_json")


def from_documents(docs: DataFrame, schema: T.StructType | str) -> DataFrame:
    """Typed rows out of ``record_json``; the schema comes with the dataset profile."""
    return docs.select(F.from_json("record_json", schema, _READ).alias("r")).select("r.*")


def _fs(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the way to make its paths."""
    make = spark._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark._jsc.hadoopConfiguration()), make


def _manifests(spark: SparkSession, home: str) -> list[tuple[int, str]]:
    """Number and version of all manifests of a dataset, newest first."""
    fs, path = _fs(spark, home)
    folder = path(f"{home}/_manifests")
    if not fs.exists(folder):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(folder)]
    found = [n.split("-", 1) for n in names if n[:1].isdigit()]
    return sorted(((int(n), version) for n, version in found), reverse=True)


def _commit(spark: SparkSession, home: str, version: str) -> int:
    """Make ``version`` the dataset; the name of a manifest is all it has to say."""
    fs, path = _fs(spark, home)
    number = next((n for n, _ in _manifests(spark, home)), 0) + 1
    draft = path(f"{home}/_manifests/draft-{version}")
    fs.mkdirs(draft.getParent())
    fs.create(draft, True).close()
    if not fs.rename(draft, path(f"{home}/_manifests/{number:012d}-{version}")):
        raise OSError(f"{home}: the new version could not be named")
    return number


def _remove_old(spark: SparkSession, home: str, keep: int = 2) -> None:
    """Drop all but the newest versions, the folder before the manifest."""
    fs, path = _fs(spark, home)
    for number, version in _manifests(spark, home)[keep:]:
        fs.delete(path(f"{home}/{version}"), True)
        fs.delete(path(f"{home}/_manifests/{number:012d}-{version}"), False)


def replace_snapshot(docs: DataFrame, root: str, dataset_id: str) -> str:
    """Write the rows of one dataset in place of all its earlier ones; returns their folder."""
    home, version = f"{root}/dataset_id={dataset_id}", uuid.uuid4().hex
    docs.drop("dataset_id").write.parquet(f"{home}/{version}")
    _commit(docs.sparkSession, home, version)
    _remove_old(docs.sparkSession, home)
    return f"{home}/{version}"


def read_snapshot(spark: SparkSession, root: str, dataset_id: str) -> DataFrame:
    """Documents of one dataset as of now; only the folder of its newest version is read."""
    home = f"{root}/dataset_id={dataset_id}"
    schema = "row_index long, record_json string"
    newest = next((version for _, version in _manifests(spark, home)), None)
    docs = spark.read.schema(schema).parquet(f"{home}/{newest}") if newest else spark.createDataFrame([], schema)
    return docs.withColumn("dataset_id", F.lit(dataset_id))
