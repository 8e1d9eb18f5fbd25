"""Top and bottom rows, ranking, per-group top-N."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions.numbering import global_row_number
from tallyframe.operators.aggregate import group_by, group_totals


def top_n(df: DataFrame, keys: Sequence[str], column: str, n: int = 10, op: str = "sum",
          name: str = "value") -> DataFrame:
    return group_by(df, keys, column, op, n, False, name)


def bottom_n(df: DataFrame, keys: Sequence[str], column: str, n: int = 10, op: str = "sum",
             name: str = "value") -> DataFrame:
    return group_by(df, keys, column, op, n, True, name)


def ranking(
    df: DataFrame,
    keys: Sequence[str],
    column: str,
    op: str = "sum",
    limit: int | None = None,
    ascending: bool = False,
    name: str = "value",
) -> DataFrame:
    """Groups with their place, 1 first.

    With a limit the numbering runs over the kept rows only.  Without one every
    group is numbered through a range-partitioned sort.
    """
    totals = group_totals(df, keys, column, op, name)
    order = [F.col(name).asc() if ascending else F.col(name).desc(), *[F.col(k) for k in keys]]
    if limit is None:
        return global_row_number(totals, order, "place", 1)
    head = totals.orderBy(*order).limit(limit)
    return head.withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("long"))


def partitioned_top_n(
    df: DataFrame,
    container: str,
    item: str,
    column: str,
    n: int = 3,
    op: str = "sum",
    ascending: bool = False,
    name: str = "value",
) -> DataFrame:
    """The ``n`` best items inside each container.

    Spark keeps only ``n`` rows per container and map task before the shuffle.
    """
    totals = group_totals(df, [container, item], column, op, name)
    order = F.col(name).asc() if ascending else F.col(name).desc()
    w = Window.partitionBy(container).orderBy(order, item)
    return (
        totals.withColumn("place", F.row_number().over(w))
        .filter(F.col("place") <= n)
        .withColumn("label", F.concat_ws(" → ", F.col(container).cast("string"),
                                         F.col(item).cast("string")))
    )


def winner(df: DataFrame, key: str, column: str, highest: bool = True, name: str = "value") -> DataFrame:
    """The best (or worst) group by sum; the first key wins a tie."""
    totals = group_totals(df, [key], column, "sum", name)
    order = F.col(name).desc() if highest else F.col(name).asc()
    return totals.orderBy(order, key).limit(1)
