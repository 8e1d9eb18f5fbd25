"""The sales view over normalised tables.

A question rarely needs every dimension, and an inner join that adds no column
is not removed by the optimizer, so the caller names what it needs.  Joins
carry no broadcast hint: size statistics and adaptive execution decide, and a
hot join key is split by the adaptive skew join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.sources.tables import table

_SALES = "l_extendedprice * (1 - l_discount)"
_COST = "l_extendedprice * 0.6D + l_quantity"
MEASURES = {
    "sales": _SALES,
    "cost": _COST,
    "profit": f"{_SALES} - ({_COST})",
    "target_sales": "l_extendedprice * 0.95D",
    "quantity": "l_quantity",
    "discount": "l_discount",
}
LINE_COLUMNS = {
    "order_id": "l_orderkey",
    "product_id": "l_partkey",
    "supplier_id": "l_suppkey",
    "line_number": "l_linenumber",
    "return_flag": "l_returnflag",
    "line_status": "l_linestatus",
    "is_returned": "l_returnflag = 'R'",
    "delivery_date": "to_date(l_shipdate)",
}
ORDER_COLUMNS = {
    "customer_id": "o_custkey",
    "order_date": "to_date(o_orderdate)",
    "order_status": "o_orderstatus",
    "priority": "o_orderpriority",
}
CUSTOMER_COLUMNS = {"segment": "c_mktsegment", "nation_id": "c_nationkey"}
NATION_COLUMNS = {"country": "n_name"}
REGION_COLUMNS = {"region": "r_name"}
PART_COLUMNS = {"category": "p_type", "brand": "p_brand", "product": "p_name"}


def _named(columns: dict[str, str]) -> list[Column]:
    return [F.expr(text).alias(name) for name, text in columns.items()]


def line_facts(spark: SparkSession, folder: str) -> DataFrame:
    """Measures and attributes of the order lines alone: no join at all."""
    return table(spark, folder, "lineitem").select(
        *_named({**LINE_COLUMNS, **MEASURES})
    )


def _dims(columns: Sequence[str]) -> dict[str, bool]:
    wanted = set(columns)
    region = bool(wanted & set(REGION_COLUMNS))
    nation = region or bool(wanted & set(NATION_COLUMNS))
    customer = nation or bool(wanted & set(CUSTOMER_COLUMNS))
    return {
        "order": customer or bool(wanted & set(ORDER_COLUMNS)),
        "customer": customer,
        "nation": nation,
        "region": region,
        "part": bool(wanted & set(PART_COLUMNS)),
    }


def _attach(spark: SparkSession, folder: str, facts: DataFrame, columns: Sequence[str]) -> DataFrame:
    need = _dims(columns)
    if need["order"]:
        orders = table(spark, folder, "orders").select(
            F.col("o_orderkey").alias("order_id"), *_named(ORDER_COLUMNS)
        )
        facts = facts.join(orders, "order_id")
    if need["customer"]:
        people = table(spark, folder, "customer").select(
            F.col("c_custkey").alias("customer_id"),
            *_named(CUSTOMER_COLUMNS),
        )
        if need["nation"]:
            nations = table(spark, folder, "nation").select(
                F.col("n_nationkey").alias("nation_id"),
                F.col("n_regionkey").alias("region_id"),
                *_named(NATION_COLUMNS),
            )
            if need["region"]:
                regions = table(spark, folder, "region").select(
                    F.col("r_regionkey").alias("region_id"),
                    *_named(REGION_COLUMNS),
                )
                nations = nations.join(regions, "region_id")
            people = people.join(nations, "nation_id")
        facts = facts.join(people, "customer_id")
    if need["part"]:
        parts = table(spark, folder, "part").select(
            F.col("p_partkey").alias("product_id"), *_named(PART_COLUMNS)
        )
        facts = facts.join(parts, "product_id")
    return facts


def sales_fact(spark: SparkSession, folder: str, columns: Sequence[str]) -> DataFrame:
    """One row per order line with just the named columns (and joins)."""
    wide = _attach(spark, folder, line_facts(spark, folder), columns)
    return wide.select(*columns)


def sales_rollup(
    spark: SparkSession, folder: str, by: Sequence[str], measures: Sequence[str] = ("sales",)
) -> DataFrame:
    """Sums of the measures per ``by`` columns, for operators over sums.

    The order lines are first summed per join key (with map-side combine, so a
    key that holds a third of all rows becomes one row per map task), and only
    the sums are joined to the dimensions.  The exchange on the join key serves
    both the sum and the join.
    """
    by = list(by)
    need = _dims(by)
    line = line_facts(spark, folder)
    keys = [c for c in by if c in LINE_COLUMNS]
    if need["order"] and "order_id" not in keys:
        keys.append("order_id")
    if need["part"] and "product_id" not in keys:
        keys.append("product_id")
    sums = [F.sum(m).alias(m) for m in measures]
    rolled = line.groupBy(*keys).agg(*sums)
    if set(keys) == set(by):
        return rolled
    return _attach(spark, folder, rolled, by).groupBy(*by).agg(*sums)
