"""Consecutive numbers over a whole table without one big task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.session import shared_dir

_POSITION_BITS = 33  # monotonically_increasing_id keeps the row position in the low bits


def global_row_number(
    df: DataFrame,
    order: Sequence[str | Column] | None = None,
    name: str = "row_index",
    start: int = 0,
    partitions: int | None = None,
) -> DataFrame:
    """Add ``start, start+1, ...`` in the given order (or in arrival order).

    The rows are range-partitioned on all order columns, so a hot leading
    value is split by the later ones, and each partition is sorted on its own.
    Only the partition sizes (one small row per partition) are summed up.  The
    placed rows are checkpointed: both uses see the same placement even if an
    executor is lost in between.
    """
    if order:
        shared_dir(df.sparkSession)
        n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        df = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    else:
        shared_dir(df.sparkSession)
    placed = (
        df.withColumn("_id", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_id", _POSITION_BITS))
        .withColumn("_pos", F.col("_id").bitwiseAND(F.lit((1 << _POSITION_BITS) - 1)))
        .drop("_id")
        .checkpoint()
    )
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_offset"))
    return (
        placed.join(offsets, "_part")
        .withColumn(name, F.col("_offset") + F.col("_pos") + start)
        .drop("_part", "_pos", "_offset")
    )
