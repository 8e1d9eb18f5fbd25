"""State tables on files: dataset catalog, KPI definitions, logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DATASETS = (
    "id string, name string, filename string, uploaded_at timestamp, row_count long, "
    "col_count int, quality_score double, quality_report_json string, schema_profile_json string, "
    "filepath string, file_hash string, last_mtime double, auto_monitor int"
)


def latest_per_id(rows: DataFrame, id_column: str, order: list[str]) -> DataFrame:
    """The last version of every id.  An aggregate: versions meet on the map side."""
    fields = [c for c in rows.columns if c != id_column]
    newest = F.max_by(F.struct(*fields), F.struct(*order))
    return rows.groupBy(id_column).agg(newest.alias("_s")).select(id_column, "_s.*").select(*rows.columns)


def upsert(current: DataFrame, changes: DataFrame, id_column: str = "id") -> DataFrame:
    """Rows of ``changes`` replace rows of the same id; the rest stays.

    If an id occurs more than once in ``changes``, the greatest row wins.
    """
    both = current.withColumn("_new", F.lit(0)).unionByName(
        changes.withColumn("_new", F.lit(1)), allowMissingColumns=True
    )
    fields = [c for c in both.columns if c not in (id_column, "_new")]
    return latest_per_id(both, id_column, ["_new", *fields]).drop("_new")


def monitored(datasets: DataFrame) -> DataFrame:
    """Watched datasets that have a path, newest first."""
    return datasets.filter(
        (F.col("auto_monitor") == 1) & F.col("filepath").isNotNull() & (F.col("filepath") != "")
    ).orderBy(F.col("uploaded_at").desc(), "id")


def latest(datasets: DataFrame) -> DataFrame:
    return datasets.orderBy(F.col("uploaded_at").desc(), "id").limit(1)


def without_kpis(rows: DataFrame, gone: DataFrame, column: str = "kpi_id") -> DataFrame:
    """Rows that belong to none of the KPIs in ``gone`` (column ``id``)."""
    return rows.join(gone.select(F.col("id").alias(column)), column, "left_anti")


def append(rows: DataFrame, path: str) -> None:
    """Add rows to a log."""
    rows.write.mode("append").parquet(path)


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path)
