"""Queries that filter, sort, search and page rows, and the star join."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.operators import facts, filters
from tallyframe.plans.base import STAR, query, rounded
from tallyframe.sources.tables import table

_ORDER_COLS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority"


def _orders(spark, folder):
    return table(spark, folder, "orders").select(*_ORDER_COLS.split(", "))


@query("filter_eq_ci", f"""
select {_ORDER_COLS} from orders where lower(trim(o_orderpriority)) = '1-urgent'""")
def filter_eq_ci(spark, folder):
    df = _orders(spark, folder)
    return df.filter(filters.equals(df, "o_orderpriority", "  1-Urgent "))


_NULLABLE_STATUS = "case when o_orderstatus = 'P' then null else o_orderstatus end"


@query("filter_ne_nullsafe", f"""
select o_orderkey, {_NULLABLE_STATUS} as status from orders
where {_NULLABLE_STATUS} is null or lower({_NULLABLE_STATUS}) <> 'f'""")
def filter_ne_nullsafe(spark, folder):
    df = _orders(spark, folder).select(
        "o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("status")
    )
    return df.filter(filters.differs(df, "status", "F"))


@query("filter_numeric_cmp", f"""
select {_ORDER_COLS} from orders where o_totalprice >= 450000.5""")
def filter_numeric_cmp(spark, folder):
    return filters.where_all(_orders(spark, folder), [("o_totalprice", ">=", 450000.5)])


@query("filter_conjunction", f"""
select {_ORDER_COLS} from orders
where lower(trim(o_orderstatus)) = 'f' and o_totalprice > 100000 and o_totalprice <= 200000
  and lower(trim(o_orderpriority)) <> '5-low'""")
def filter_conjunction(spark, folder):
    return filters.where_all(
        _orders(spark, folder),
        [
            ("o_orderstatus", "==", "f"),
            ("o_totalprice", ">", 100000),
            ("o_totalprice", "<=", 200000),
            ("o_orderpriority", "!=", "5-LOW"),
        ],
    )


@query("filter_date_after", """
select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as order_day from orders
where cast(o_orderdate as date) > date '2001-01-01'""")
def filter_date_after(spark, folder):
    df = filters.after_date(table(spark, folder, "orders"), "o_orderdate", "2001-01-01")
    return df.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("order_day"))


@query("kpi_date_window", """
select count(*) as n_rows, round(coalesce(sum(o_totalprice), 0), 2) as total,
       strftime(min(o_orderdate), '%Y-%m-%d') as first_day,
       strftime(max(o_orderdate), '%Y-%m-%d') as last_day
from orders
where cast(o_orderdate as date) between date '1997-01-01' and date '1997-03-31'""")
def kpi_date_window(spark, folder):
    df = filters.between_dates(
        table(spark, folder, "orders"), "o_orderdate", "1997-01-01", "1997-03-31"
    )
    return rounded(
        df.agg(
            F.count("*").alias("n_rows"),
            F.coalesce(F.sum("o_totalprice"), F.lit(0.0)).alias("total"),
            F.date_format(F.min("o_orderdate"), "yyyy-MM-dd").alias("first_day"),
            F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias("last_day"),
        ),
        2,
    )


@query("op_filter_rows", f"""
select {_ORDER_COLS} from orders where o_totalprice < 5000 and lower(o_orderstatus) = 'o'""")
def op_filter_rows(spark, folder):
    return filters.where_all(
        _orders(spark, folder), [("o_totalprice", "<", 5000), ("o_orderstatus", "==", "O")]
    )


@query("op_sort_rows", """
select c_custkey, c_mktsegment, c_acctbal from customer
order by c_acctbal desc, c_custkey""")
def op_sort_rows(spark, folder):
    df = table(spark, folder, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    return filters.sort_rows(df, F.col("c_acctbal").desc(), "c_custkey")


@query("search_any_column", """
select * from part
where contains(lower(p_name), 'brand#1') or contains(lower(p_brand), 'brand#1')
   or contains(lower(p_type), 'brand#1') or contains(cast(p_size as varchar), 'brand#1')
   or contains(cast(p_partkey as varchar), 'brand#1')
   or contains(cast(p_retailprice as varchar), 'brand#1')""")
def search_any_column(spark, folder):
    return filters.search_any(table(spark, folder, "part"), "Brand#1")


@query("page_slice", f"""
select {_ORDER_COLS} from orders order by o_totalprice desc, o_orderkey limit 20 offset 40""")
def page_slice(spark, folder):
    return filters.page(
        _orders(spark, folder), [F.col("o_totalprice").desc(), F.col("o_orderkey")], 3, 20
    )


@query("page_after_key", f"""
select {_ORDER_COLS} from orders where o_orderkey > 1000 order by o_orderkey limit 20""")
def page_after_key(spark, folder):
    """The page that follows a key (a page is what the operator is for)."""
    return filters.page_after(_orders(spark, folder), "o_orderkey", 1000, 20)


@query("preview_sample", """
select coalesce(cast(doc_id as varchar), '') as doc_id, coalesce(lang, '') as lang,
       coalesce(source, '') as source, coalesce(text, '') as text,
       coalesce(cast(long_text as varchar), '') as long_text
from (select doc_id, lang, source, text, case when n_chars > 1000 then n_chars end as long_text
      from documents order by doc_id limit 100)""")
def preview_sample(spark, folder):
    df = table(spark, folder, "documents").select(
        "doc_id", "lang", "source", "text", F.when(F.col("n_chars") > 1000, F.col("n_chars")).alias("long_text")
    )
    return filters.preview(df, ["doc_id"], 100)


@query("sales_fact", f"""
select region, category, line_status, count(*) as n_rows, round(sum(sales), 4) as sales,
       round(sum(profit), 4) as profit, round(sum(quantity), 4) as quantity
from ({STAR}) group by all""")
def sales_fact(spark, folder):
    df = facts.sales_fact(
        spark, folder, ["region", "category", "line_status", "sales", "profit", "quantity"]
    )
    return rounded(
        df.groupBy("region", "category", "line_status").agg(
            F.count("*").alias("n_rows"),
            F.sum("sales").alias("sales"),
            F.sum("profit").alias("profit"),
            F.sum("quantity").alias("quantity"),
        )
    )
