"""Alert rules, cooldown, messages, alert log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions.columns import let, recipient_list

ALERT_KEY = ("kpi_id", "alert_type", "severity")
DEFAULT_HOURS = 24


def _money(c: Column) -> Column:
    return F.format_string("%,.2f", c)


def _percent(c: Column) -> Column:
    return F.format_string("%.1f%%", c)


def _signed(c: Column) -> Column:
    return F.format_string("%+.1f%%", c)


def message(
    status: Column, name: Column, actual: Column, target: Column, achievement: Column, gap: Column
) -> Column:
    """A sentence per status with achievement, actual and target value, and gap to the plan."""
    done = F.concat(F.lit(": "), _percent(achievement), F.lit(" done"))
    values = F.concat(F.lit(" ("), _money(actual), F.lit(" / "), _money(target), F.lit(")"))
    plan = F.concat(F.lit(", "), _signed(gap), F.lit(" to plan"))
    critical = F.concat(F.lit("Far behind plan, "), name, done, values, plan)
    risk = F.concat(F.lit("Behind plan, "), name, done, F.lit(", short by "), _percent(F.abs(gap)))
    exceeded = F.concat(F.lit("Beyond target, "), name, done, values)
    fine = F.concat(F.lit("As planned, "), name, plan)
    return let(
        status,
        lambda s: F.when(s == "CRITICAL", critical)
        .when(s == "AT RISK", risk)
        .when(s == "EXCEEDED", exceeded)
        .otherwise(fine),
    )


def _by_status(status: Column, answers: dict[str, str]) -> Column:
    pairs = [F.lit(x) for pair in answers.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), status)


def alert_type(status: Column) -> Column:
    return _by_status(
        status, {"CRITICAL": "CRITICAL", "AT RISK": "AT_RISK", "EXCEEDED": "TARGET_EXCEEDED"}
    )


def severity(status: Column) -> Column:
    return _by_status(status, {"CRITICAL": "CRITICAL", "AT RISK": "WARNING", "EXCEEDED": "INFO"})


def alerts_from(snapshots: DataFrame) -> DataFrame:
    """The snapshots that raise an alert, with type, severity and message."""
    s = F.col("status")
    return (
        snapshots.withColumn("alert_type", alert_type(s))
        .filter(F.col("alert_type").isNotNull())
        .withColumn("severity", severity(s))
        .withColumn(
            "message",
            message(s, F.col("kpi_name"), F.col("actual_value"), F.col("target_value"),
                    F.col("achievement_pct"), F.col("performance_gap")),
        )
    )


def _hour(c: Column) -> Column:
    """Whole hours since 1970, without reference to a time zone."""
    return F.datediff(F.to_date(c), F.lit("1970-01-01").cast("date")) * 24 + F.hour(c)


def previous_alert(
    log: DataFrame, key: Sequence[str] = ALERT_KEY, time: str = "triggered_at", tie: str = "id"
) -> DataFrame:
    """Adds ``previous_at``: time of the alert before, per key.

    The log of one key can be most of the log, so no task gets a whole key: rows
    are ordered within one key and hour, and the first row of an hour takes the
    last time of the hour before from a table of one row per key and hour.
    """
    key = list(key)
    rows = log.withColumn("_hour", _hour(F.col(time)))
    hours = rows.groupBy(*key, "_hour").agg(F.max(time).alias("_last"))
    before = hours.select(
        *key, "_hour", F.lag("_last").over(Window.partitionBy(*key).orderBy("_hour")).alias("_before")
    )
    w = Window.partitionBy(*key, "_hour").orderBy(time, tie)
    inside = rows.withColumn("_inside", F.lag(time).over(w))
    return (
        inside.join(before, [*key, "_hour"], "left")
        .withColumn("previous_at", F.coalesce("_inside", "_before"))
        .drop("_inside", "_before", "_hour")
    )


def cooldown(
    log: DataFrame,
    hours: int | None = DEFAULT_HOURS,
    key: Sequence[str] = ALERT_KEY,
    time: str = "triggered_at",
    tie: str = "id",
) -> DataFrame:
    """Marks alerts that follow one of the same key within ``hours`` (inclusive).

    Every alert counts for the next one, suppressed or not, so the quiet time
    slides along.  0 hours means the default.
    """
    gap = F.expr(f"INTERVAL {int(hours or DEFAULT_HOURS)} HOURS")
    out = previous_alert(log, key, time, tie)
    near = F.col(time) - F.col("previous_at") <= gap
    return out.withColumn("suppressed", F.coalesce(near, F.lit(False)))


def cooldown_against(
    fresh: DataFrame,
    history: DataFrame,
    hours: int | None = DEFAULT_HOURS,
    key: Sequence[str] = ALERT_KEY,
    time: str = "triggered_at",
) -> DataFrame:
    """The same rule for new alerts against the log written so far.

    Only the newest log time per key matters, so the log is reduced to that
    before the join.
    """
    gap = F.expr(f"INTERVAL {int(hours or DEFAULT_HOURS)} HOURS")
    last = history.groupBy(*key).agg(F.max(time).alias("_last"))
    joined = fresh.join(last, list(key), "left")
    near = F.col(time) - F.col("_last") <= gap
    return joined.withColumn("suppressed", F.coalesce(near, F.lit(False))).drop("_last")


def notify(alerts: DataFrame, hours: int | None = DEFAULT_HOURS) -> DataFrame:
    """Whether an alert goes out, to whom, and why not."""
    to = recipient_list("recipients")
    has = F.coalesce(F.size(to) > 0, F.lit(False))
    reason = F.when(
        F.col("suppressed"),
        f"Same alert within the last {hours or DEFAULT_HOURS} hours",
    ).when(~has, "No recipient")
    return (
        alerts.withColumn("send_to", F.when(has, F.array_join(to, ",")))
        .withColumn("notify", ~F.col("suppressed") & has)
        .withColumn("reason", reason)
    )


def sessions(
    log: DataFrame,
    hours: int = DEFAULT_HOURS,
    key: Sequence[str] = ALERT_KEY,
    time: str = "triggered_at",
) -> DataFrame:
    """Runs of alerts of one key with no gap above ``hours``.

    Alerts of one clock hour always belong together (``hours`` is at least 1),
    so the log is first reduced to one row per key and hour.
    """
    return runs(hourly(log, key, time), hours, key)


def hourly(log: DataFrame, key: Sequence[str] = ALERT_KEY, time: str = "triggered_at") -> DataFrame:
    """First, last and number of alerts per key and clock hour; alerts without a time are left out."""
    return (
        log.filter(F.col(time).isNotNull())
        .withColumn("_hour", _hour(F.col(time)).cast("long"))
        .groupBy(*key, "_hour")
        .agg(F.min(time).alias("_from"), F.max(time).alias("_to"), F.count("*").alias("_n"))
    )


def merged_hours(hours: DataFrame, key: Sequence[str] = ALERT_KEY) -> DataFrame:
    """Rows of :func:`hourly` of several parts of a log as those of all of it."""
    return hours.groupBy(*key, "_hour").agg(
        F.min("_from").alias("_from"), F.max("_to").alias("_to"), F.sum("_n").alias("_n")
    )


def runs(per_hour: DataFrame, hours: int = DEFAULT_HOURS, key: Sequence[str] = ALERT_KEY) -> DataFrame:
    """The sessions of a log that is given by its rows of :func:`hourly`."""
    if hours < 1:
        raise ValueError("sessions need a gap of at least one hour")
    key = list(key)
    gap = F.expr(f"INTERVAL {int(hours)} HOURS")
    w = Window.partitionBy(*key).orderBy("_hour")
    opens = F.coalesce(F.col("_from") - F.lag("_to").over(w) > gap, F.lit(True))
    numbered = per_hour.withColumn("_open", opens.cast("int")).withColumn(
        "_session", F.sum("_open").over(w)
    )
    return (
        numbered.groupBy(*key, "_session")
        .agg(
            F.min("_from").alias("first_at"),
            F.max("_to").alias("last_at"),
            F.sum("_n").alias("n_alerts"),
        )
        .drop("_session")
    )


def history(
    log: DataFrame, limit: int = 100, severity: str | None = None, kpi_id: str | None = None
) -> DataFrame:
    """Newest alerts first; severity ``ALL`` is no filter."""
    if severity and severity.upper() != "ALL":
        log = log.filter(F.col("severity") == severity.upper())
    if kpi_id:
        log = log.filter(F.col("kpi_id") == kpi_id)
    return log.orderBy(F.col("triggered_at").desc(), F.col("id").desc()).limit(limit)


def snapshot_history(snapshots: DataFrame, kpi_id: str, limit: int = 30) -> DataFrame:
    newest = [F.col("snapshot_time").desc(), F.col("id").desc()]
    return snapshots.filter(F.col("kpi_id") == kpi_id).orderBy(*newest).limit(limit)
