"""Exact quantiles that never hold a whole column in one task.

``percentile`` in Spark keeps a map of every distinct value of a group in one
aggregation buffer.  Here the work is split in two lazy steps:

1. a mergeable sketch (``percentile_approx``, bounded state) gives for each
   wanted quantile two values that bracket it for certain;
2. one pass counts rows: values inside a bracket are kept apart, everything
   between brackets collapses to one row per gap.  The counts are combined on
   the map side, so repeats of a value cost nothing, and the remaining rows
   (a share of about ``4 / accuracy`` of the group) are ranked.

The interpolation is linear between the two neighbouring ranks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACCURACY = 100_000


def _bracket_columns(ps: Sequence[float], accuracy: int) -> Column:
    # the sketch promises a rank error below n/accuracy; twice that on both sides
    slack = 2.0 / accuracy
    edges: list[float] = []
    for p in ps:
        edges += [max(0.0, p - slack), min(1.0, p + slack)]
    return F.percentile_approx("_v", [float(e) for e in edges], accuracy)


def exact_quantiles(
    df: DataFrame,
    value: str | Column,
    ps: Sequence[float],
    keys: Sequence[str] = (),
    accuracy: int = ACCURACY,
) -> DataFrame:
    """One row per key (one row in all without keys): the keys, the number ``n``
    of values and an array ``q`` with the exact quantile for every entry of ``ps``.

    Null values and null keys are left out.  A group without values gives no
    row; without keys there is always one row.
    """
    ps = [float(p) for p in ps]
    if not ps or any(p < 0 or p > 1 for p in ps):
        raise ValueError("quantiles lie between 0 and 1")
    keys = list(keys)
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    rows = df.select(*keys, v.alias("_v")).filter(F.col("_v").isNotNull())
    for k in keys:
        rows = rows.filter(F.col(k).isNotNull())

    bounds = rows.groupBy(*keys).agg(
        F.count("_v").alias("_n"),
        _bracket_columns(ps, accuracy).alias("_edges"),
    )
    if keys:
        placed = rows.join(bounds, keys)
    else:
        placed = rows.withColumn(
            "_b", bounds.select(F.struct("_n", "_edges")).scalar()
        ).select("_v", "_b.*")

    inside = F.lit(False)
    for i in range(len(ps)):
        low, high = F.col("_edges")[2 * i], F.col("_edges")[2 * i + 1]
        inside = inside | F.col("_v").between(low, high)
    edge = F.col("_edges")
    below = F.greatest(*[F.when(edge[i] < F.col("_v"), edge[i]) for i in range(2 * len(ps))])
    counts = (
        placed.select(
            *keys,
            "_n",
            F.when(inside, F.col("_v")).otherwise(below).alias("_at"),
            (~inside).alias("_gap"),
            "_v",
        )
        .groupBy(*keys, "_n", "_at", "_gap")
        .agg(F.count("*").alias("_c"), F.min("_v").alias("_first"), F.max("_v").alias("_last"))
    )

    # A wanted rank is inside a bracket or, for groups too small for the slack
    # to reach one row, the row next to it: the first or last of a gap.
    w = Window.partitionBy(*keys, "_n").orderBy(F.col("_at").asc_nulls_first(), "_gap").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    ranked = counts.withColumn("_end", F.sum("_c").over(w))
    start = F.col("_end") - F.col("_c")
    parts = []
    for i, p in enumerate(ps):
        rank = F.lit(p) * (F.col("_n") - 1)
        for tag, r in (("lo", F.floor(rank)), ("hi", F.ceil(rank))):
            here = (
                F.when(~F.col("_gap") | (r == start), F.col("_first"))
                .when(r == F.col("_end") - 1, F.col("_last"))
                .otherwise(F.raise_error(F.lit("quantile bracket missed its rank")))
            )
            parts.append(
                F.max(F.when((r >= start) & (r < F.col("_end")), here)).alias(f"_{tag}{i}")
            )
    picked = ranked.groupBy(*keys, "_n").agg(*parts)
    quantiles = []
    for i, p in enumerate(ps):
        lo, hi = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        rank = F.lit(p) * (F.col("_n") - 1)
        quantiles.append(lo + (hi - lo) * (rank - F.floor(rank)))
    result = picked.select(*keys, F.col("_n").alias("n"), F.array(*quantiles).alias("q"))
    if keys:
        return result
    # an empty column still answers with one row
    return result.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"), F.max("q").alias("q"))
