"""Registry of queries: a Spark function and the SQL text it is checked against."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SparkQuery = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    run: SparkQuery
    sql: str | None


REGISTRY: dict[str, Entry] = {}


def query(name: str, sql: str | None = None) -> Callable[[SparkQuery], SparkQuery]:
    def register(fn: SparkQuery) -> SparkQuery:
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        REGISTRY[name] = Entry(fn, sql)
        return fn

    return register


def rounded(df: DataFrame, places: int = 4, **special: int) -> DataFrame:
    """Round every double column; other columns pass unchanged."""
    out: list[Column] = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if field.dataType.typeName() == "double":
            c = F.round(c, special.get(field.name, places))
        out.append(c.alias(field.name))
    return df.select(*out)


# The order lines as the oracle sees them.
LINE = """
select l_orderkey as order_id, l_partkey as product_id, l_suppkey as supplier_id,
       l_linenumber as line_number, l_returnflag as return_flag, l_linestatus as line_status,
       l_returnflag = 'R' as is_returned, cast(l_shipdate as date) as delivery_date,
       l_extendedprice * (1 - l_discount) as sales,
       l_extendedprice * 0.6 + l_quantity as cost,
       l_extendedprice * (1 - l_discount) - (l_extendedprice * 0.6 + l_quantity) as profit,
       l_extendedprice * 0.95 as target_sales, l_quantity as quantity, l_discount as discount
from lineitem
"""
STAR = f"""
select l.*, o_custkey as customer_id, cast(o_orderdate as date) as order_date,
       o_orderstatus as order_status, o_orderpriority as priority, c_mktsegment as segment,
       n_name as country, r_name as region, p_type as category, p_brand as brand, p_name as product
from ({LINE}) l
join orders on o_orderkey = l.order_id
join customer on c_custkey = o_custkey
join nation on n_nationkey = c_nationkey
join region on r_regionkey = n_regionkey
join part on p_partkey = l.product_id
"""
