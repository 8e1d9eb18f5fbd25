"""KPI targets: actual values, variance, elapsed-time expectation, status."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.functions.columns import iso_day, let, pct0
from tallyframe.operators import day_windows
from tallyframe.session import staged

_FAR_PAST, _FAR_FUTURE = "0001-01-01", "9999-12-31"


def normalize_definitions(kpis: DataFrame) -> DataFrame:
    """Defaults of a definition: SUM, Monthly, 10 percent, no recipients, ACTIVE."""
    defaults = {
        "period": F.lit("Monthly"),
        "alert_threshold_pct": F.lit(10.0),
        "recipients": F.lit(""),
        "status": F.lit("ACTIVE"),
    }
    out = kpis.withColumns(
        {c: F.coalesce(F.col(c), d) if c in kpis.columns else d for c, d in defaults.items()}
    )
    calculation = F.col("calculation") if "calculation" in kpis.columns else F.lit(None)
    return out.withColumn("calculation", F.upper(F.coalesce(calculation, F.lit("SUM"))))


def in_scope(kpis: DataFrame, dataset_id: str | None = None, active_only: bool = True) -> DataFrame:
    """KPIs of one dataset plus those of none; active ones only by default."""
    if dataset_id is not None:
        own = F.col("dataset_id") == dataset_id
        kpis = kpis.filter(own | F.col("dataset_id").isNull())
    return kpis.filter(F.col("status") == "ACTIVE") if active_only else kpis


def date_column(df: DataFrame) -> str | None:
    """First column whose name speaks of dates."""
    return next(
        (c for c in df.columns if any(w in c.lower() for w in ("date", "time", "day"))), None
    )


def _day(df: DataFrame, date: str | None) -> Column:
    if date is None:
        return F.lit(None).cast("date")
    if isinstance(df.schema[date].dataType, T.StringType):
        return iso_day(date)
    return F.to_date(date)


def _number(df: DataFrame, metric: str) -> Column:
    """Numbers stay as they are (nulls do not count); text that is no number counts as 0."""
    c = F.col(f"`{metric}`")
    if isinstance(df.schema[metric].dataType, T.NumericType):
        return c.cast("double")
    return F.coalesce(c.cast("string").try_cast("double"), F.lit(0.0))


def _long(df: DataFrame, metrics: Sequence[str], date: str | None) -> DataFrame:
    cells = F.array(
        *[
            F.struct(
                F.lit(m).alias("metric_column"),
                _number(df, m).alias("v"),
                F.col(f"`{m}`").isNotNull().cast("long").alias("filled"),
            )
            for m in metrics
        ]
    )
    return df.select(_day(df, date).alias("day"), F.inline(cells))


def _windows(kpis: DataFrame, dated: bool) -> DataFrame:
    """kpi_id, how, and the day window of each KPI; without days all of them are whole.

    An open side reaches to the end of the calendar.  A window open on both sides
    is whole: it takes rows without a day, too.
    """
    start, end = iso_day("start_date"), iso_day("end_date")
    if not dated:
        start = end = F.lit(None).cast("date")
    bounds = kpis.select(
        F.col("id").alias("kpi_id"), "metric_column", F.upper("calculation").alias("how"),
        start.alias("start_day"), end.alias("end_day"),
    )
    return bounds.select(
        "kpi_id", "metric_column", "how",
        F.coalesce("start_day", F.lit(_FAR_PAST).cast("date")).alias("first_day"),
        F.coalesce("end_day", F.lit(_FAR_FUTURE).cast("date")).alias("last_day"),
        (F.col("start_day").isNull() & F.col("end_day").isNull()).alias("whole"),
    )


def day_totals(df: DataFrame, metrics: Sequence[str], date: str | None) -> DataFrame:
    """metric_column, day, s, n, filled, lo, hi: all that KPIs but medians need of the facts."""
    return _long(df, metrics, date).groupBy("metric_column", "day").agg(
        F.sum("v").alias("s"), F.count("v").alias("n"), F.sum("filled").alias("filled"),
        F.min("v").alias("lo"), F.max("v").alias("hi"),
    )


def day_values(df: DataFrame, metrics: Sequence[str], date: str | None) -> DataFrame:
    """metric_column, day, v, c: how often each value occurs on each day; for medians."""
    long = _long(df, metrics, date).filter("v is not null")
    return long.groupBy("metric_column", "day", "v").agg(F.count("*").alias("c"))


def median_metrics(kpis: DataFrame, metrics: Sequence[str]) -> list[str]:
    """Those of ``metrics`` that a MEDIAN KPI is about."""
    wanted = kpis.filter((F.upper("calculation") == "MEDIAN") & F.col("metric_column").isin(*metrics))
    found = {r[0] for r in wanted.select("metric_column").distinct().collect()}
    return [m for m in metrics if m in found]


def actuals(
    kpis: DataFrame, df: DataFrame, metrics: Sequence[str] | None = None, date: str | None = None
) -> DataFrame:
    """``kpi_id, actual_value`` for every KPI whose metric is a column of ``df``.

    The facts are read once for the totals of each metric and day, and once for
    the values of each day of metrics that have MEDIAN KPIs.
    """
    date = date or date_column(df)
    metrics = [m for m in (metrics or df.columns) if m != date]
    medians = median_metrics(kpis, metrics)
    values = day_values(df, medians, date) if medians else None
    return actuals_of_days(kpis, day_totals(df, metrics, date), values, metrics, date is not None)


def actuals_of_days(
    kpis: DataFrame, totals: DataFrame, values: DataFrame | None, metrics: Sequence[str], dated: bool = True
) -> DataFrame:
    """``kpi_id, actual_value`` from day totals and, for medians, day values.

    KPIs of one metric and window are answered together; see ``day_windows``.
    """
    kpis = staged(_windows(kpis, dated).filter(F.col("metric_column").isin(*metrics)))
    totals = staged(totals)
    key = ["metric_column", "first_day", "last_day", "whole"]
    windows = kpis.select(*key).filter("first_day <= last_day").distinct()
    grid = day_windows.numbered_days(totals, windows)
    found = day_windows.window_totals(totals, windows, grid)
    if values is None:
        found = found.withColumn("median", F.lit(None).cast("double"))
    else:
        found = staged(found)
        asked = kpis.filter("how = 'MEDIAN'").select(*key).distinct()
        medians = day_windows.window_medians(values, found.join(asked, key, "left_semi"), grid)
        found = found.join(medians, key, "left")
    how = F.col("how")
    value = (
        F.when(how.isin("AVERAGE", "MEAN", "RATE", "PERCENTAGE"), F.try_divide("s", "n"))
        .when(how == "MIN", F.col("lo"))
        .when(how == "MAX", F.col("hi"))
        .when(how == "COUNT", F.col("filled").cast("double"))
        .when(how == "MEDIAN", F.col("median"))
        .otherwise(F.col("s"))
    )
    return kpis.join(found, key, "left").select(
        "kpi_id", F.round(F.coalesce(value, F.lit(0.0)), 2).alias("actual_value")
    )


def variance(df: DataFrame) -> DataFrame:
    """Adds variance, variance % and achievement % to ``actual_value, target_value``."""
    a, t = F.col("actual_value"), F.col("target_value")
    return (
        df.withColumn("variance", F.round(a - t, 2))
        .withColumn("variance_pct", F.round(pct0(F.col("variance"), t), 2))
        .withColumn("achievement_pct", F.round(pct0(a, t), 2))
    )


def progress(df: DataFrame, as_of: str | Column) -> DataFrame:
    """Adds the share of the window that has passed and the gap to it.

    Without a window of two valid, ascending dates all of it counts as passed.
    """
    today = F.to_date(F.lit(as_of)) if isinstance(as_of, str) else as_of
    window = F.struct(iso_day("start_date").alias("s"), iso_day("end_date").alias("e"))

    def share(w: Column) -> Column:
        passed = F.greatest(F.lit(0), F.datediff(today, w["s"]))
        done = F.least(F.lit(100.0), passed / F.datediff(w["e"], w["s"]) * 100.0)
        return F.when(w["e"] > w["s"], F.round(done, 2)).otherwise(100.0)

    expected = let(window, share)
    return (
        df.withColumn("expected_progress_pct", expected)
        .withColumn("actual_progress_pct", F.col("achievement_pct"))
        .withColumn(
            "performance_gap", F.round(F.col("achievement_pct") - F.col("expected_progress_pct"), 2)
        )
    )


def status(achievement: Column, gap: Column, threshold: Column) -> Column:
    """The first rule that fits, best status first."""
    parts = F.struct(
        achievement.alias("a"), gap.alias("g"), F.coalesce(threshold, F.lit(10.0)).alias("t")
    )
    return let(
        parts,
        lambda x: F.when(x["a"] >= 100, "EXCEEDED")
        .when((x["g"] >= 0) | (x["a"] >= 100.0 - x["t"]), "ON TRACK")
        .when((x["g"] >= -15) | (x["a"] >= 70), "AT RISK")
        .otherwise("CRITICAL"),
    )


def with_status(df: DataFrame) -> DataFrame:
    return df.withColumn(
        "status",
        status(F.col("achievement_pct"), F.col("performance_gap"), F.col("alert_threshold_pct")),
    )


def evaluate(
    kpis: DataFrame,
    df: DataFrame,
    as_of: str,
    metrics: Sequence[str] | None = None,
    date: str | None = None,
    dataset_id: str | None = None,
) -> DataFrame:
    """One snapshot per active KPI in scope.

    A KPI whose metric column is absent becomes a row with status ERROR and does
    not stop the others.
    """
    scoped = in_scope(normalize_definitions(kpis), dataset_id)
    return snapshots(scoped, actuals(scoped, df, metrics, date), as_of)


def evaluate_days(
    kpis: DataFrame,
    totals: DataFrame,
    values: DataFrame | None,
    as_of: str,
    metrics: Sequence[str],
    dated: bool = True,
    dataset_id: str | None = None,
) -> DataFrame:
    """As ``evaluate``, from kept day totals and day values instead of the facts."""
    scoped = in_scope(normalize_definitions(kpis), dataset_id)
    return snapshots(scoped, actuals_of_days(scoped, totals, values, metrics, dated), as_of)


def snapshots(scoped: DataFrame, values: DataFrame, as_of: str) -> DataFrame:
    """Snapshots of normalized definitions from ``kpi_id, actual_value``."""
    state = scoped.withColumnRenamed("status", "state")
    rated = with_status(progress(variance(state.join(values.withColumnRenamed("kpi_id", "id"), "id", "left")), as_of))
    failed = F.col("actual_value").isNull()
    numbers = ["actual_value", "variance", "variance_pct", "achievement_pct",
               "expected_progress_pct", "actual_progress_pct", "performance_gap"]
    return rated.select(
        F.col("id").alias("kpi_id"),
        "kpi_name",
        "metric_column",
        "calculation",
        "target_value",
        *[F.when(~failed, F.col(c)).alias(c) for c in numbers],
        F.when(failed, "ERROR").otherwise(F.col("status")).alias("status"),
        "recipients",
    )


def latest_snapshots(snapshots: DataFrame) -> DataFrame:
    """The newest snapshot per KPI.  An aggregate, not a window: a KPI with a
    very long history is reduced on the map side."""
    fields = [c for c in snapshots.columns if c != "kpi_id"]
    order = [F.col(c) for c in ("snapshot_time", "id") if c in snapshots.columns]
    return snapshots.groupBy("kpi_id").agg(
        F.max_by(F.struct(*fields), F.struct(*order)).alias("s")
    ).select("kpi_id", "s.*")


def with_latest(kpis: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Definitions with the values of their newest snapshot, null without one."""
    last = latest_snapshots(snapshots).select(
        F.col("kpi_id").alias("id"),
        "actual_value",
        "achievement_pct",
        "expected_progress_pct",
        "actual_progress_pct",
        "performance_gap",
        F.col("status").alias("latest_status"),
        F.col("snapshot_time").alias("last_evaluated_at"),
    )
    return kpis.join(last, "id", "left")


def dashboard_counts(kpis: DataFrame) -> DataFrame:
    """Number of KPIs per latest status; one without a status is unmonitored."""
    s = F.col("latest_status")
    return kpis.agg(
        F.count(F.lit(1)).alias("total_kpis"),
        F.count_if(s == "ON TRACK").alias("on_track"),
        F.count_if(s == "AT RISK").alias("at_risk"),
        F.count_if(s == "CRITICAL").alias("critical"),
        F.count_if(s == "EXCEEDED").alias("exceeded"),
        F.count_if(s.isNull()).alias("unmonitored"),
    )
