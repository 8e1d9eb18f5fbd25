"""Queries for business rates, contributions and multi-step questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.operators import business as biz
from tallyframe.operators import facts
from tallyframe.plans.base import LINE, STAR, query, rounded
from tallyframe.sources.tables import table

# O, F, P of the orders table as status words
_STATUS = "case o_orderstatus when 'F' then 'Delivered' when 'P' then 'Cancelled' else 'Shipped' end"


def _line(spark, folder):
    return facts.line_facts(spark, folder)


def _status(spark, folder):
    return table(spark, folder, "orders").select(F.expr(_STATUS).alias("status"))


@query("rate_return", f"""
select count(*) filter (where is_returned) as returned_orders, count(*) as total_orders,
       round(100.0 * count(*) filter (where is_returned) / count(*), 6)::double as rate_percentage
from ({LINE})""")
def rate_return(spark, folder):
    return rounded(biz.return_rate(_line(spark, folder), flag="is_returned"), 6)


def _rate(name, word, fn):
    column = f"{word.lower()}_orders"

    @query(name, f"""
select count(*) filter (where s = '{word}') as {column}, count(*) as total_orders,
       round(100.0 * count(*) filter (where s = '{word}') / count(*), 6)::double as rate_percentage
from (select {_STATUS} as s from orders)""")
    def run(spark, folder):
        return rounded(fn(_status(spark, folder), "status"), 6)

    return run


_rate("rate_cancellation", "Cancelled", biz.cancellation_rate)
_rate("rate_delivery", "Delivered", biz.delivery_rate)


@query("profit_margin", f"""
select round(sum(profit), 2) as total_profit, round(sum(sales), 2) as total_sales,
       round(sum(profit) / sum(sales) * 100, 6) as profit_margin_percentage from ({LINE})""")
def profit_margin(spark, folder):
    out = biz.profit_margin(_line(spark, folder), "profit", "sales")
    return rounded(out, 2, profit_margin_percentage=6)


@query("average_order_value", f"""
select round(sum(sales), 2) as total_sales, count(distinct order_id) as total_orders,
       round(sum(sales) / count(distinct order_id), 4) as average_order_value from ({LINE})""")
def average_order_value(spark, folder):
    out = biz.average_order_value(_line(spark, folder), "sales", "order_id")
    return rounded(out, 2, average_order_value=4)


@query("pct_contribution", f"""
select k as segment, round(v, 2) as value, round(v / t * 100, 6) as percentage
from (select case when brand = 'Brand#7' then null else brand end as k, sum(sales) as v,
             sum(sum(sales)) over () as t from ({STAR}) group by 1)
where k is not null""")
def pct_contribution(spark, folder):
    df = facts.sales_rollup(spark, folder, ["brand"]).select(
        F.when(F.col("brand") != "Brand#7", F.col("brand")).alias("segment"), "sales"
    )
    return rounded(biz.contribution(df, "segment", "sales"), 2, percentage=6)


@query("group_difference", f"""
with t as (select coalesce(sum(sales) filter (where region = 'ASIA'), 0) as a,
                  coalesce(sum(sales) filter (where region = 'EUROPE'), 0) as b from ({STAR}))
select 'asia' as group_a, 'europe' as group_b, round(a, 2) as total_a, round(b, 2) as total_b,
       round(a - b, 2) as absolute_difference, round((a - b) / b * 100, 6) as percentage_difference
from t""")
def group_difference(spark, folder):
    df = facts.sales_rollup(spark, folder, ["region"])
    out = biz.group_difference(df, "region", "sales", ["asia", "europe"])
    return rounded(out, 2, percentage_difference=6)


@query("group_difference_top_two", f"""
with t as (select return_flag as k, sum(sales) as v, row_number() over (order by sum(sales) desc) as n
           from ({LINE}) group by 1),
     p as (select max(k) filter (where n = 1) as ka, max(k) filter (where n = 2) as kb,
                  max(v) filter (where n = 1) as a, max(v) filter (where n = 2) as b from t)
select ka as group_a, kb as group_b, round(a, 2) as total_a, round(b, 2) as total_b,
       round(a - b, 2) as absolute_difference, round((a - b) / b * 100, 6) as percentage_difference
from p""")
def group_difference_top_two(spark, folder):
    out = biz.group_difference(_line(spark, folder), "return_flag", "sales")
    return rounded(out, 2, percentage_difference=6)


@query("actual_vs_target", f"""
select round(sum(sales), 2) as actual, round(sum(target_sales), 2) as target,
       round(sum(sales) - sum(target_sales), 2) as variance,
       round(sum(sales) / sum(target_sales) * 100, 6) as attainment_percentage from ({LINE})""")
def actual_vs_target(spark, folder):
    out = biz.actual_vs_target(_line(spark, folder), "sales", "target_sales")
    return rounded(out, 2, attainment_percentage=6)


@query("top_n_contribution", f"""
with g as (select product_id, sum(sales) as v from ({LINE}) group by 1),
     t as (select * from g order by v desc, product_id limit 3)
select product_id, round(v, 2) as value, round((select sum(v) from g), 2) as overall_total,
       round(sum(v) over (), 2) as top_total,
       round(sum(v) over () / (select sum(v) from g) * 100, 6) as percentage_contribution
from t""")
def top_n_contribution(spark, folder):
    out = biz.top_n_contribution(_line(spark, folder), "product_id", "sales", 3)
    return rounded(out, 2, percentage_contribution=6)


@query("above_average", """
with g as (select o_custkey, sum(o_totalprice) as v from orders group by 1),
     m as (select avg(v) as m, count(*) as n from g)
select o_custkey, round(v, 2) as value, round(m, 4) as average_threshold,
       (select count(*) from g, m where v > m) as qualifying_count, n as total_count
from g, m where v > m""")
def above_average(spark, folder):
    out = biz.above_average(table(spark, folder, "orders"), "o_custkey", "o_totalprice")
    return rounded(out, 2, average_threshold=4)


@query("extreme_combination", f"""
with g as (select product_id as k, sum(sales) as s, sum(profit) as p, sum(profit) / sum(sales) * 100 as m
           from ({LINE}) group by 1 having sum(sales) <> 0),
     a as (select avg(s) as s, avg(m) as m from g),
     b as (select * from g order by s desc, k limit 1),
     w as (select * from g order by m, k limit 1)
select cast(b.k as varchar) as highest_sales_item, round(b.s, 2) as highest_sales,
       round(b.m, 6) as highest_sales_margin, cast(w.k as varchar) as lowest_margin_item,
       round(w.m, 6) as lowest_margin, round(w.s, 2) as lowest_margin_sales,
       (select count(*) from g, a where g.s > a.s and g.m < a.m) as niche_count
from b, w""")
def extreme_combination(spark, folder):
    out = biz.extreme_combination(_line(spark, folder), "product_id", "sales", "profit")
    return rounded(out, 6, highest_sales=2, lowest_margin_sales=2)


_MONTHS = f"""
months as (select max(m) filter (where m = date '1998-02-01') as now,
                  max(m) filter (where m < date '1998-02-01') as before
           from (select date_trunc('month', delivery_date)::date as m from ({LINE}))),
f as (select l.*, date_trunc('month', delivery_date)::date as m from ({LINE}) l)"""


@query("drop_total", f"""
with {_MONTHS},
t as (select coalesce(sum(sales) filter (where m = now), 0) as a,
             coalesce(sum(sales) filter (where m = before), 0) as b,
             any_value(now) as now, any_value(before) as before
      from f, months where m = now or m = before)
select strftime(now, '%Y-%m') as period, strftime(before, '%Y-%m') as previous_period,
       round(a, 2) as total, round(b, 2) as previous_total, round(a - b, 2) as change,
       round(case when b > 0 then (a - b) / b * 100 else 0 end, 6) as change_pct
from t""")
def drop_total(spark, folder):
    out = biz.drop_total(_line(spark, folder), "delivery_date", "sales", "1998-02")
    return rounded(out, 2, change_pct=6)


@query("drop_drivers", f"""
with {_MONTHS},
c as (select d.dimension, d.item,
             coalesce(sum(sales) filter (where m = before), 0) as previous_total,
             coalesce(sum(sales) filter (where m = now), 0) as total
      from f, months, lateral (values ('return_flag', return_flag), ('line_status', line_status),
           ('supplier_id', cast(supplier_id as varchar))) d(dimension, item)
      where m = now or m = before group by 1, 2),
r as (select *, total - previous_total as change,
             row_number() over (partition by dimension order by total - previous_total, item) as n from c)
select dimension, item, round(previous_total, 2) as previous_total, round(total, 2) as total,
       round(change, 2) as change from r where n = 1 and change < 0""")
def drop_drivers(spark, folder):
    out = biz.drop_drivers(
        _line(spark, folder), "delivery_date", "sales", "1998-02",
        ["return_flag", "line_status", "supplier_id"],
    )
    return rounded(out, 2)


@query("drop_full_outer", """
with m as (select o_custkey, sum(o_totalprice) filter (where o_orderdate < timestamp '1996-01-01') as a,
                  sum(o_totalprice) filter (where o_orderdate >= timestamp '1996-01-01') as b,
                  count(*) as n
           from orders where o_orderdate < timestamp '1997-01-01' group by 1)
select o_custkey, round(coalesce(a, 0), 2) as previous_total, round(coalesce(b, 0), 2) as total,
       round(coalesce(b, 0) - coalesce(a, 0), 2) as change from m""")
def drop_full_outer(spark, folder):
    orders = table(spark, folder, "orders")
    before = orders.filter("o_orderdate < timestamp_ntz '1996-01-01'")
    now = orders.filter(
        "o_orderdate >= timestamp_ntz '1996-01-01' and o_orderdate < timestamp_ntz '1997-01-01'"
    )
    return rounded(biz.compare_groups_full_outer(before, now, "o_custkey", "o_totalprice"), 2)


@query("revenue_total", f"select round(sum(sales), 2) as revenue from ({LINE})")
def revenue_total(spark, folder):
    return rounded(biz.total(_line(spark, folder), "sales", "revenue"), 2)


@query("profit_total", f"select round(sum(profit), 2) as profit from ({LINE})")
def profit_total(spark, folder):
    return rounded(biz.total(_line(spark, folder), "profit", "profit"), 2)


@query("conversion_rate", """
with u as (select user_id, max(case when event_type = 'view' then 1 else 0 end) as s,
                  max(case when event_type = 'purchase' then 1 else 0 end) as g
           from events group by 1)
select sum(s)::bigint as source_users, sum(s * g)::bigint as goal_users,
       round(100.0 * sum(s * g) / sum(s), 6)::double as rate_percentage from u""")
def conversion_rate(spark, folder):
    return rounded(biz.conversion_rate(table(spark, folder, "events"), "user_id", "event_type"), 6)


@query("ctr", """
select count(*) filter (where event_type = 'click') as clicks,
       count(*) filter (where event_type = 'view') as views,
       round(100.0 * count(*) filter (where event_type = 'click')
             / count(*) filter (where event_type = 'view'), 6)::double as rate_percentage
from events""")
def ctr(spark, folder):
    return rounded(biz.click_through_rate(table(spark, folder, "events"), "event_type"), 6)


@query("customer_growth", """
with f as (select o_custkey, date_trunc('month', min(o_orderdate))::date as m from orders group by 1),
     g as (select m, count(*) as c from f group by 1),
     spine as (select cast(unnest(generate_series((select min(m) from g)::timestamp,
                 (select max(m) from g)::timestamp, interval '1 month')) as date) as p),
     s as (select p, coalesce(c, 0)::double as total from spine left join g on m = p)
select strftime(p, '%Y-%m') as period, total as new_customers,
       round(case when lag(total) over (order by p) <> 0
             then (total - lag(total) over (order by p)) / lag(total) over (order by p) * 100 end, 6)
         as growth_pct from s""")
def customer_growth(spark, folder):
    out = biz.customer_growth(table(spark, folder, "orders"), "o_custkey", "o_orderdate")
    return rounded(out.drop("period_start"), 6)
