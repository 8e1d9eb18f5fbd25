"""Single-table statistics and grouped aggregates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.columns import adjusted_skew, pct0, ratio0, safe_corr, sum0
from tallyframe.functions.quantiles import exact_quantiles

SIMPLE = {
    "sum": sum0,
    "mean": F.avg,
    "min": F.min,
    "max": F.max,
    "std": F.stddev_samp,
    "variance": F.var_samp,
}


def metric(df: DataFrame, op: str, column: str, name: str = "value") -> DataFrame:
    """One row with one statistic of one column."""
    if op == "median":
        return percentile(df, column, 50, name)
    if op == "nunique":
        return nunique(df, column, name=name)
    return df.agg(SIMPLE[op](column).alias(name))


def count_of(df: DataFrame, column: str | None = None, name: str = "value") -> DataFrame:
    """Non-null count of a column, or the number of rows."""
    return df.agg(F.count(F.col(column) if column else F.lit(1)).alias(name))


def nunique(df: DataFrame, column: str, approx: bool = False, name: str = "value") -> DataFrame:
    f = F.approx_count_distinct if approx else F.count_distinct
    return df.agg(f(F.col(column)).alias(name))


def distinct_values(df: DataFrame, column: str, n: int | None = None) -> DataFrame:
    """The values in order (the first ``n``, if given), with the count of all distinct ones."""
    values = df.select(F.col(column).alias("value")).filter(F.col("value").isNotNull()).distinct()
    total = values.agg(F.count("*").alias("c")).scalar()
    ordered = values.orderBy("value")
    return (ordered if n is None else ordered.limit(n)).withColumn("distinct_count", total)


def percentile(
    df: DataFrame, column: str, p: float = 90, name: str = "value", approx: bool = False
) -> DataFrame:
    """Linear-interpolated percentile; ``p`` above 1 counts as percent."""
    share = p / 100.0 if p > 1 else float(p)
    if approx:
        return df.agg(F.percentile_approx(column, share).cast("double").alias(name))
    return exact_quantiles(df, column, [share]).select(F.col("q")[0].alias(name))


def quartiles(df: DataFrame, column: str) -> DataFrame:
    return exact_quantiles(df, column, [0.25, 0.5, 0.75]).select(
        F.col("q")[0].alias("q1"), F.col("q")[1].alias("q2"), F.col("q")[2].alias("q3")
    )


def distribution(df: DataFrame, column: str) -> DataFrame:
    """Mean, spread, quartiles and skew in one row."""
    shape = exact_quantiles(df, column, [0.25, 0.5, 0.75]).select(F.struct("q").alias("s"))
    return df.agg(
        F.avg(column).alias("mean"),
        F.stddev_samp(column).alias("std_dev"),
        F.var_samp(column).alias("variance"),
        F.min(column).alias("min"),
        F.max(column).alias("max"),
        adjusted_skew(column).alias("skewness"),
    ).withColumn("_q", shape.scalar()).select(
        "mean",
        F.col("_q.q")[1].alias("median"),
        "std_dev",
        "variance",
        "min",
        F.col("_q.q")[0].alias("p25"),
        F.col("_q.q")[1].alias("p50"),
        F.col("_q.q")[2].alias("p75"),
        "max",
        "skewness",
    )


def correlation(df: DataFrame, a: str, b: str, name: str = "value") -> DataFrame:
    return df.agg(safe_corr(a, b).alias(name))


def covariance(df: DataFrame, a: str, b: str, name: str = "value") -> DataFrame:
    return df.agg(F.covar_samp(a, b).alias(name))


def outliers(df: DataFrame, column: str, k: float = 1.5) -> DataFrame:
    """Count of values strictly outside the Tukey fences, with the fences."""
    q = exact_quantiles(df, column, [0.25, 0.75])
    q1, q3 = F.col("q")[0], F.col("q")[1]
    fences = q.select(
        F.struct((q1 - k * (q3 - q1)).alias("lo"), (q3 + k * (q3 - q1)).alias("hi")).alias("s")
    )
    return (
        df.select(F.col(column).alias("v"))
        .withColumn("f", fences.scalar())
        .agg(
            F.count_if((F.col("v") < F.col("f.lo")) | (F.col("v") > F.col("f.hi"))).alias(
                "outlier_count"
            ),
            F.first("f.lo").alias("lower_bound"),
            F.first("f.hi").alias("upper_bound"),
            F.count("*").alias("total_records"),
        )
    )


def column_totals(df: DataFrame, a: str, b: str, op: str, name: str = "value") -> DataFrame:
    """Arithmetic on the two column sums."""
    x, y = F.col("x"), F.col("y")
    results = {
        "addition": x + y,
        "difference": x - y,
        "subtraction": x - y,
        "multiplication": x * y,
        "ratio": ratio0(x, y),
        "division": ratio0(x, y),
        "percentage": pct0(x - y, y),
        "percentage_difference": pct0(x - y, y),
    }
    return df.agg(sum0(a).alias("x"), sum0(b).alias("y")).select(results[op].alias(name))


def formula(df: DataFrame, totals: Mapping[str, Column], text: str, name: str = "value") -> DataFrame:
    """A SQL expression over named aggregates."""
    return df.agg(*[c.alias(n) for n, c in totals.items()]).select(F.expr(text).alias(name))


def group_totals(
    df: DataFrame, keys: Sequence[str], column: str | None, op: str = "sum", name: str = "value"
) -> DataFrame:
    """Aggregate per group; rows with a null key are left out."""
    keys = list(keys)
    kept = df
    for k in keys:
        kept = kept.filter(F.col(k).isNotNull())
    if op == "median":
        # groups whose values are all null stay, with a null median
        groups = kept.groupBy(*keys).agg(F.count(column).alias("_n"))
        q = exact_quantiles(kept, column, [0.5], keys).select(*keys, F.col("q")[0].alias(name))
        return groups.join(q, keys, "left").select(*keys, name)
    if op == "count":
        return kept.groupBy(*keys).agg(F.count(F.col(column) if column else F.lit(1)).alias(name))
    if op == "nunique":
        return kept.groupBy(*keys).agg(F.count_distinct(F.col(column)).alias(name))
    return kept.groupBy(*keys).agg(SIMPLE[op](column).alias(name))


def label(keys: Sequence[str], separator: str = " - ") -> Column:
    return F.concat_ws(separator, *[F.col(k).cast("string") for k in keys])


def group_by(
    df: DataFrame,
    keys: Sequence[str],
    column: str | None,
    op: str = "sum",
    limit: int | None = None,
    ascending: bool = False,
    name: str = "value",
) -> DataFrame:
    """All groups by value, largest first, keys break ties; the first ``limit``, if given."""
    order = F.col(name).asc() if ascending else F.col(name).desc()
    groups = group_totals(df, keys, column, op, name).orderBy(order, *keys)
    return groups if limit is None else groups.limit(limit)
