"""Structured Streaming: KPI totals, alert sessions, cooldown on a live stream."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from tallyframe.operators import alerts, day_windows, kpi

INTERVAL = "300 seconds"
COMPACT = 64  # batches whose day states are merged into one


def file_stream(
    spark: SparkSession, folder: str, schema: T.StructType, kind: str = "parquet",
    pattern: str | None = None, files_per_trigger: int | None = None,
) -> DataFrame:
    """Stream of the files that arrive in a folder, or in places that match a pattern."""
    reader = spark.readStream.format(kind).schema(schema)
    if kind == "csv":
        reader = reader.option("header", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(folder)


def event_time(df: DataFrame, column: str) -> DataFrame:
    """Watermarks need a timestamp with a time zone."""
    return df.withColumn(column, F.col(column).cast("timestamp"))


def window_totals(
    df: DataFrame, time: str, value: str, keys: Sequence[str], width: str = "1 day",
    late: str = "1 hour",
) -> DataFrame:
    """Sum and count per key and tumbling window; rows later than the watermark drop.

    The same function serves a stream and a batch table.
    """
    timed = event_time(df, time)
    if df.isStreaming:
        timed = timed.withWatermark(time, late)
    return (
        timed.groupBy(F.window(time, width), *keys)
        .agg(F.sum(value).alias("total"), F.count(F.lit(1)).alias("n_rows"))
        .select(F.col("window.start").alias("window_start"), *keys, "total", "n_rows")
    )


def upsert_windows(totals: DataFrame, folder: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Keep the totals of a stream's windows below ``folder``; read them with :func:`newest_windows`.

    A trigger writes the windows that it changed, under its number, so a repeated
    trigger changes nothing.  Windows that the watermark has passed leave the state.
    """

    def keep(changed: DataFrame, batch_id: int) -> None:
        changed.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    writer = totals.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).outputMode("update")
    trigger = {"availableNow": True} if once else {"processingTime": INTERVAL}
    return writer.trigger(**trigger).start()


def newest_windows(spark: SparkSession, folder: str, keys: Sequence[str]) -> DataFrame:
    """The last state of each window (``window_start`` and ``keys``); sums, so narrow rows."""
    found = spark.read.parquet(folder)
    key = ["window_start", *keys]
    rest = [c for c in found.columns if c not in (*key, "batch")]
    return found.groupBy(*key).agg(F.max_by(F.struct(*rest), "batch").alias("last")).select(*key, "last.*")


def alert_sessions(
    df: DataFrame, keys: Sequence[str], time: str = "triggered_at", gap: str = "24 hours",
    late: str = "1 hour",
) -> DataFrame:
    """Alert runs per key on a stream; a run is emitted when it can no longer grow."""
    timed = event_time(df, time)
    if df.isStreaming:
        timed = timed.withWatermark(time, late)
    return (
        timed.groupBy(F.session_window(time, gap), *keys)
        .agg(F.min(time).alias("first_at"), F.max(time).alias("last_at"),
             F.count(F.lit(1)).alias("n_alerts"))
        .drop("session_window")
    )


def live_sessions(
    stream: DataFrame, keys: Sequence[str], folder: str, checkpoint: str,
    time: str = "triggered_at", once: bool = False,
) -> StreamingQuery:
    """Keeps what alert runs need of a stream; read them, open ones included, with :func:`session_report`."""
    return monitor(stream, lambda batch, batch_id: keep_hours(batch, batch_id, keys, folder, time), checkpoint, once)


def keep_hours(batch: DataFrame, batch_id: int, keys: Sequence[str], folder: str, time: str = "triggered_at") -> None:
    """First, last and number of the batch's alerts per key and hour, below ``folder`` under the batch's number.

    So a repeated batch changes nothing, alerts may arrive in any order, and none
    is too late.  After each ``COMPACT`` batches the hours so far are merged.
    """
    spark = batch.sparkSession
    rows = alerts.hourly(event_time(batch, time), keys, time)
    rows.write.mode("overwrite").parquet(f"{folder}/hours/batch={batch_id}")
    if batch_id % COMPACT == 0:
        before = max(batch_id - COMPACT, 0)
        parts = [f"{folder}/merged/upto={before}"] if batch_id else []
        parts += [f"{folder}/hours/batch={i}" for i in range(before + 1 if batch_id else 0, batch_id + 1)]
        merged = alerts.merged_hours(spark.read.schema(rows.schema).parquet(*parts), keys)
        merged.write.mode("overwrite").parquet(f"{folder}/merged/upto={batch_id}")


def session_report(
    spark: SparkSession, folder: str, keys: Sequence[str], hours: int = alerts.DEFAULT_HOURS, late: str = "1 hour",
) -> DataFrame:
    """All alert runs so far; ``closed`` if the newest alert, less ``late``, is more than ``hours`` after the run."""
    merged, parts = spark.read.parquet(f"{folder}/merged"), spark.read.parquet(f"{folder}/hours")
    newest = merged.agg(F.max("upto")).first()[0]  # null if nothing has been merged but empty batches
    done = -1 if newest is None else newest
    kept = merged.filter(F.col("upto") == done).drop("upto").unionByName(parts.filter(F.col("batch") > done).drop("batch"))
    per_hour = alerts.merged_hours(kept, keys)
    end = F.col("last_at") + F.expr(f"INTERVAL {int(hours)} HOURS")
    over = per_hour.agg(F.max("_to") - F.expr(f"INTERVAL {late}")).scalar()
    return alerts.runs(per_hour, hours, keys).withColumn("closed", end < over)


def live_cooldown(
    stream: DataFrame, keys: Sequence[str], folder: str, checkpoint: str,
    time: str = "triggered_at", hours: int = 24, once: bool = False,
) -> StreamingQuery:
    """Keeps an alert log and its verdicts up to date as alerts (``id``, keys, time) arrive.

    The log below ``folder`` lies in folders by day (of 24 hours since 1970) and
    batch.  A batch is added to it; then the alerts of its days, and of those that
    ``hours`` reach from there, are judged again by :func:`alerts.cooldown`, so an
    alert that arrives late also changes the verdict of the one that follows it.
    A trigger lists and opens these days alone, however long the log is.  Folders
    carry the batch number: a repeated batch writes the same place again.  Alerts
    without a time stay in the log but have no verdict.  Read the result with
    :func:`cooldown_verdicts`.
    """
    hours = hours or alerts.DEFAULT_HOURS
    reach = -(-hours // 24)

    def judge(batch: DataFrame, batch_id: int) -> None:
        day = F.floor(F.unix_seconds(F.col(time)) / 86400).cast("long")
        rows = event_time(batch, time).select("id", *keys, time, day.alias("day"), F.lit(batch_id).cast("long").alias("batch"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(
            f"{folder}/log"
        )
        touched = {r[0] for r in rows.select("day").distinct().collect()} - {None}
        if not touched:
            return
        later = {d + j for d in touched for j in range(reach + 1)}
        near = later | {d - j for d in touched for j in range(reach + 1)}
        log = log_days(batch.sparkSession, folder, rows.schema, near).filter(F.col("batch") <= batch_id)
        judged = alerts.cooldown(log.drop("batch"), hours, keys, time)
        judged.filter(F.col("day").isin(*later)).select("id", "suppressed").write.mode("overwrite").parquet(
            f"{folder}/verdicts/batch={batch_id}"
        )

    return monitor(stream, judge, checkpoint, once)


def log_days(spark: SparkSession, folder: str, schema: T.StructType, days: Iterable[int]) -> DataFrame:
    """The alerts of some days of a live log; the folders of other days are not listed.  One day at least must be there."""
    wanted = ",".join(str(d) for d in sorted(days))
    return spark.read.schema(schema).option("basePath", f"{folder}/log").parquet(f"{folder}/log/day={{{wanted}}}")


def cooldown_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    """``id, suppressed`` of every alert so far, by its newest verdict."""
    found = spark.read.parquet(f"{folder}/verdicts")
    return found.groupBy("id").agg(F.max(F.struct("batch", "suppressed")).alias("v")).select("id", "v.suppressed")


class DayStates:
    """Day totals and day values of all facts that a stream has brought, kept by batch.

    A batch adds one small state, under its number, so a repeated batch writes the
    same place again and changes nothing.  After each ``COMPACT`` batches all
    states so far are merged into one, so a trigger reads that many at most.  The
    facts themselves are read once, when they arrive.
    """

    def __init__(self, folder: str, metrics: Sequence[str], medians: Sequence[str], date: str | None):
        self.folder, self.metrics, self.medians, self.date = folder, list(metrics), list(medians), date

    def add(self, batch: DataFrame, batch_id: int) -> None:
        """Keep the rows of a batch."""
        new = {"totals": kpi.day_totals(batch, self.metrics, self.date)}
        if self.medians:
            new["values"] = kpi.day_values(batch, self.medians, self.date)
        for kind, state in new.items():
            state.write.mode("overwrite").parquet(f"{self.folder}/{kind}/batch={batch_id}")
        if (batch_id + 1) % COMPACT == 0:
            for kind, state in zip(new, self.upto(batch.sparkSession, batch_id)):
                state.write.mode("overwrite").parquet(f"{self.folder}/{kind}/upto={batch_id}")

    def _parts(self, kind: str, batch_id: int) -> list[str]:
        done = batch_id // COMPACT * COMPACT  # batches in the newest merged state
        merged = [f"{self.folder}/{kind}/upto={done - 1}"] if done else []
        return merged + [f"{self.folder}/{kind}/batch={i}" for i in range(done, batch_id + 1)]

    def upto(self, spark: SparkSession, batch_id: int) -> tuple[DataFrame, DataFrame | None]:
        """Totals and values of all batches up to this one, merged by their keys."""
        totals = spark.read.schema("metric_column string, day date, s double, n long, filled long, lo double, hi double")
        totals = day_windows.merged(totals.parquet(*self._parts("totals", batch_id)))
        if not self.medians:
            return totals, None
        values = spark.read.schema("metric_column string, day date, v double, c long").parquet(*self._parts("values", batch_id))
        return totals, values.groupBy("metric_column", "day", "v").agg(F.sum("c").alias("c"))


def live_kpis(
    stream: DataFrame, kpis: DataFrame, folder: str, checkpoint: str, as_of: str, metrics: Sequence[str],
    date: str | None = None, once: bool = False,
) -> StreamingQuery:
    """Snapshots of all KPIs after each batch of facts, below ``folder``/snapshots by batch.

    Only the merged days are evaluated, whatever the number of facts so far.  The
    day values of metrics that have MEDIAN KPIs at the start are kept.
    """
    states = DayStates(folder, metrics, kpi.median_metrics(kpi.normalize_definitions(kpis), metrics), date)

    def evaluate(batch: DataFrame, batch_id: int) -> None:
        states.add(batch, batch_id)
        totals, values = states.upto(batch.sparkSession, batch_id)
        snaps = kpi.evaluate_days(kpis, totals, values, as_of, metrics, date is not None)
        snaps.write.mode("overwrite").parquet(f"{folder}/snapshots/batch={batch_id}")

    return monitor(stream, evaluate, checkpoint, once)


def newest_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """The snapshots of the last batch."""
    found = spark.read.parquet(f"{folder}/snapshots")
    last = found.agg(F.max("batch")).first()[0]
    return found.filter(F.col("batch") == last).drop("batch")


class FixedCooldown(StatefulProcessor):
    """Remembers the last alert of a key that went out; emits each alert with its verdict."""

    def __init__(self, hours: int, keys: Sequence[str], time: str):
        self._gap = pd.Timedelta(hours=hours)
        self._keys = list(keys)
        self._time = time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._last = handle.getValueState("last", "at timestamp")

    def handleInputRows(self, key, rows, timerValues):
        last = self._last.get()[0] if self._last.exists() else None
        last = None if last is None else pd.Timestamp(last)
        # all batches of a key and trigger at once: a verdict must not depend on how they were cut
        pdf = pd.concat(list(rows)).sort_values([self._time, "id"])
        verdicts = []
        for at in pdf[self._time]:
            near = last is not None and at - last <= self._gap
            verdicts.append(bool(near))
            if not near:
                last = at if last is None else max(last, at)
        yield pdf.assign(suppressed=verdicts)[["id", *self._keys, self._time, "suppressed"]]
        if last is not None:
            self._last.update((last.to_pydatetime(),))

    def close(self) -> None:
        pass


def fixed_cooldown(
    df: DataFrame, keys: Sequence[str], time: str = "triggered_at", hours: int = 24
) -> DataFrame:
    """Verdict per alert as it arrives; only alerts that went out start a quiet time.

    Needs the RocksDB state store; state is one time per key.  Each verdict hangs on
    the one before, so a key's alerts of a trigger are judged in one task, and
    alerts must arrive in time order across triggers.
    """
    timed = event_time(df, time)
    kinds = {f.name: f.dataType for f in timed.schema.fields}
    out = T.StructType(
        [T.StructField("id", kinds["id"])]
        + [T.StructField(k, kinds[k]) for k in keys]
        + [T.StructField(time, T.TimestampType()), T.StructField("suppressed", T.BooleanType())]
    )
    return (
        timed.select("id", *keys, time)
        .groupBy(*keys)
        .transformWithStateInPandas(
            FixedCooldown(hours, keys, time), out, "Append", "None"
        )
    )


def monitor(
    stream: DataFrame, evaluate: Callable[[DataFrame, int], None], checkpoint: str,
    once: bool = False,
) -> StreamingQuery:
    """Run ``evaluate(batch, batch_id)`` on the rows of newly arrived files, every
    five minutes, or once over all that is there."""
    writer = stream.writeStream.foreachBatch(evaluate).option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if once else {"processingTime": INTERVAL}
    return writer.trigger(**trigger).start()


def run_to_end(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Drive a stream over everything available and write the result."""
    if mode == "append":
        q = (df.writeStream.format("parquet").option("path", path)
             .option("checkpointLocation", checkpoint).outputMode("append")
             .trigger(availableNow=True).start())
    else:
        # complete results are one table, replaced at each trigger
        q = (df.writeStream.foreachBatch(lambda b, _: b.write.mode("overwrite").parquet(path))
             .option("checkpointLocation", checkpoint).outputMode(mode)
             .trigger(availableNow=True).start())
    q.awaitTermination()
