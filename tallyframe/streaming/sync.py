"""Re-processing of changed files: read, profile, clean, replace, re-evaluate.

Files edited in place are found by their fingerprint and handled as a batch job;
it is run by whatever starts jobs on the cluster.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.operators import alerts, clean, kpi
from tallyframe.operators.profile import profile
from tallyframe.session import scratch_path
from tallyframe.sources import catalog, files, records


@dataclass
class Synced:
    """Outcome for one dataset: numbers for its catalog row."""

    dataset_id: str
    path: str
    row_count: int
    col_count: int
    quality_score: float
    schema_json: str


def sync_dataset(
    spark: SparkSession,
    path: str,
    dataset_id: str,
    root: str,
    schema: T.StructType | str | None = None,
) -> Synced:
    """Read one CSV dataset, clean it, and replace its stored rows."""
    raw = files.read_csv(spark, path, schema)
    info = profile(raw)
    plan = clean.plan_cleaning(raw, info)
    # the cleaned rows are used twice (documents, counts): written once
    staged = scratch_path(spark, f"clean-{dataset_id}")
    clean.clean(raw, plan).write.parquet(staged)
    tidy = spark.read.parquet(staged)
    records.replace_snapshot(records.to_documents(tidy, dataset_id), root, dataset_id)
    report = clean.quality_report(raw, plan).filter("metric = 'quality_score'").first()
    return Synced(
        dataset_id, path, tidy.count(), len(tidy.columns), report["value"], tidy.schema.json()
    )


def load_dataset(spark: SparkSession, root: str, done: Synced) -> DataFrame:
    schema = T.StructType.fromJson(json.loads(done.schema_json))
    return records.from_documents(records.read_snapshot(spark, root, done.dataset_id), schema)


def sync_changed(
    spark: SparkSession, datasets: DataFrame, root: str
) -> tuple[list[Synced], DataFrame]:
    """Re-sync every watched dataset whose file changed.

    ``datasets`` has the catalog columns.  Returns the outcomes and the catalog
    with the new fingerprints.  The loop runs over changed files, each of which
    is a Spark job of its own.
    """
    watched = catalog.monitored(datasets).select(
        "id", F.col("filepath").alias("path"), F.col("file_hash").alias("sha256"),
        F.col("last_mtime").alias("mtime"),
    )
    paths = [r["path"] for r in watched.select("path").distinct().collect()]
    if not paths:
        return [], datasets
    changed = files.changed_files(spark, paths, watched.drop("id"))
    todo = changed.join(watched.select("id", "path"), "path").collect()
    outcomes, rows = [], []
    for r in todo:
        done = sync_dataset(spark, r["path"], r["id"], root)
        outcomes.append(done)
        rows.append((r["id"], r["sha256"], r["mtime"], done.row_count, done.col_count,
                     done.quality_score))
    if not rows:
        return [], datasets
    news = spark.createDataFrame(
        rows, "id string, h string, t double, n long, c int, q double"
    )
    joined = datasets.join(news, "id", "left")
    pairs = {"file_hash": "h", "last_mtime": "t", "row_count": "n", "col_count": "c",
             "quality_score": "q"}
    updated = joined.select(
        *[F.coalesce(pairs[c], c).alias(c) if c in pairs else F.col(c) for c in datasets.columns]
    )
    return outcomes, updated


def monitor_cycle(
    kpis: DataFrame,
    facts: DataFrame,
    log: DataFrame | None,
    as_of: str,
    at: str,
    metrics: list[str] | None = None,
    date: str | None = None,
    hours: int = alerts.DEFAULT_HOURS,
) -> tuple[DataFrame, DataFrame]:
    """Evaluate all KPIs and derive alerts, held against the log so far.

    Returns snapshots and alert rows; the caller appends them.
    """
    snaps = kpi.evaluate(kpis, facts, as_of, metrics, date)
    raised = alerts.alerts_from(snaps).withColumn("triggered_at", F.lit(at).cast("timestamp"))
    if log is None:
        raised = raised.withColumn("suppressed", F.lit(False))
    else:
        raised = alerts.cooldown_against(raised, log, hours)
    return snaps, alerts.notify(raised, hours)
