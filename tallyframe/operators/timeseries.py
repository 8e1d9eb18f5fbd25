"""Regular time series: totals per period with gaps filled, growth, running values.

The fact rows are first summed per period (map-side combine).  Everything after
that works on one row per calendar period, which is why the ordering windows
need no partition key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions.columns import growth_pct, sum0

STEP = {
    "day": "INTERVAL 1 DAY",
    "week": "INTERVAL 7 DAY",
    "month": "INTERVAL 1 MONTH",
    "quarter": "INTERVAL 3 MONTH",
    "year": "INTERVAL 1 YEAR",
}
PER_YEAR = {"month": 12, "quarter": 4, "year": 1}


def _check(grain: str) -> None:
    if grain not in STEP:
        raise ValueError(f"unknown period {grain!r}; choose one of {', '.join(STEP)}")


def period_start(c: Column, grain: str) -> Column:
    """First day of the period; weeks start on Monday."""
    _check(grain)
    return F.to_date(c) if grain == "day" else F.trunc(F.to_date(c), grain)


def period_label(start: Column, grain: str) -> Column:
    """Text for a period; a week carries the date of its Sunday."""
    _check(grain)
    if grain == "year":
        return F.date_format(start, "yyyy")
    if grain == "quarter":
        return F.concat(F.year(start).cast("string"), F.lit("Q"), F.quarter(start).cast("string"))
    if grain == "month":
        return F.date_format(start, "yyyy-MM")
    day = F.date_add(start, 6) if grain == "week" else start
    return F.date_format(day, "yyyy-MM-dd")


def present_periods(
    df: DataFrame, date: str, column: str, grain: str = "month", op: str = "sum"
) -> DataFrame:
    """Value per period that has rows; periods without rows are absent."""
    f: Callable[[str], Column] = {"sum": sum0, "mean": F.avg}[op]
    start = period_start(F.col(date), grain)
    return (
        df.select(start.alias("period_start"), F.col(column).alias("_v"))
        .filter(F.col("period_start").isNotNull())
        .groupBy("period_start")
        .agg(f("_v").alias("total"))
        .withColumn("period", period_label(F.col("period_start"), grain))
    )


def resample(df: DataFrame, date: str, column: str, grain: str = "month") -> DataFrame:
    """Sum per period from the first to the last, absent periods as 0.

    Each present period is stretched up to the day before the next one, so the
    calendar needs neither a second pass over the totals nor a join.
    """
    present = present_periods(df, date, column, grain).drop("period")
    step = F.expr(STEP[grain])
    following = F.lead("period_start").over(Window.orderBy("period_start"))
    until = F.coalesce((following - step).cast("date"), F.col("period_start"))
    filled = present.withColumn("_until", until).select(
        F.col("period_start").alias("_own"),
        "total",
        F.explode(F.sequence("period_start", "_until", step)).alias("period_start"),
    )
    return filled.select(
        "period_start",
        period_label(F.col("period_start"), grain).alias("period"),
        F.when(F.col("period_start") == F.col("_own"), F.col("total")).otherwise(0.0).alias("total"),
    )


def _in_order() -> Window:
    return Window.orderBy("period_start")


def growth(df: DataFrame, date: str, column: str, grain: str = "month", lag: int = 1) -> DataFrame:
    """Total and percent change against ``lag`` periods before.

    The first periods and growth from 0 have no rate: NULL, never infinity.
    """
    series = resample(df, date, column, grain)
    before = F.lag("total", lag).over(_in_order())
    return series.withColumn("growth_pct", growth_pct(F.col("total"), before))


def year_over_year(df: DataFrame, date: str, column: str, grain: str = "month") -> DataFrame:
    """Change against the same period one year before (month, quarter or year)."""
    if grain not in PER_YEAR:
        raise ValueError("year over year needs months, quarters or years")
    return growth(df, date, column, grain, PER_YEAR[grain])


def best_growth(df: DataFrame, date: str, column: str, grain: str = "month") -> DataFrame:
    """The period with the highest growth, the earliest on a tie."""
    return (
        growth(df, date, column, grain)
        .filter(F.col("growth_pct").isNotNull())
        .orderBy(F.col("growth_pct").desc(), "period_start")
        .limit(1)
        .select(F.col("period").alias("highest_growth_period"),
                F.col("growth_pct").alias("highest_growth_value"))
    )


def period_comparison(df: DataFrame, date: str, column: str, grain: str = "year") -> DataFrame:
    """Every period with its total and its change; 0 where there is no rate."""
    out = growth(df, date, column, grain)
    return out.withColumn("growth_pct", F.coalesce("growth_pct", F.lit(0.0)))


def current_vs_previous(df: DataFrame, date: str, column: str, grain: str = "month") -> DataFrame:
    """The last period beside the one before it."""
    series = resample(df, date, column, grain)
    w = _in_order()
    return (
        series.withColumn("previous_period", F.lag("period").over(w))
        .withColumn("previous_total", F.lag("total").over(w))
        .orderBy(F.col("period_start").desc())
        .limit(1)
        .select("period", "total", "previous_period", "previous_total",
                growth_pct(F.col("total"), F.col("previous_total")).alias("growth_pct"))
    )


def moving_average(
    df: DataFrame, date: str, column: str, grain: str = "month", window: int = 3
) -> DataFrame:
    """Mean of the last ``window`` periods; 0 until there are that many."""
    w = _in_order()
    mean = F.avg("total").over(w.rowsBetween(-(window - 1), Window.currentRow))
    full = F.row_number().over(w) >= window
    return resample(df, date, column, grain).withColumn(
        "moving_average", F.when(full, mean).otherwise(0.0)
    )


def cumulative(df: DataFrame, date: str, column: str, grain: str = "month") -> DataFrame:
    w = _in_order().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return resample(df, date, column, grain).withColumn("running_total", F.sum("total").over(w))
