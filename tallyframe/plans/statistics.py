"""Queries for single-table statistics, grouped aggregates and rankings."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.operators import aggregate, facts, filters, rank
from tallyframe.plans.base import LINE, STAR, query, rounded
from tallyframe.sources.tables import table


def _line(spark, folder):
    return facts.line_facts(spark, folder)


def _metric(name, sql, op, column="sales", places=4):
    @query(name, f"select {sql} as value from ({LINE})")
    def run(spark, folder):
        return rounded(aggregate.metric(_line(spark, folder), op, column), places)

    return run


_metric("agg_sum", "round(coalesce(sum(sales), 0), 2)", "sum", places=2)
_metric("agg_mean", "round(avg(sales), 4)", "mean")
_metric("agg_median", "round(quantile_cont(sales, 0.5), 4)", "median")
_metric("agg_min", "round(min(profit), 4)", "min", "profit")
_metric("agg_max", "round(max(profit), 4)", "max", "profit")
_metric("agg_nunique", "count(distinct product_id)", "nunique", "product_id")
_metric("agg_std", "round(stddev_samp(sales), 4)", "std")
_metric("agg_variance", "round(var_samp(sales), 0)", "variance", places=0)


@query("agg_min_max_text", "select min(p_name) as lo, max(p_name) as hi from part")
def agg_min_max_text(spark, folder):
    return table(spark, folder, "part").agg(F.min("p_name").alias("lo"), F.max("p_name").alias("hi"))


@query("agg_count", """
select count(case when l_discount > 0 then l_discount end) as discounted, count(*) as n_rows
from lineitem""")
def agg_count(spark, folder):
    df = table(spark, folder, "lineitem").select(
        F.when(F.col("l_discount") > 0, F.col("l_discount")).alias("d")
    )
    return df.agg(F.count("d").alias("discounted"), F.count(F.lit(1)).alias("n_rows"))


@query("agg_distinct_values", """
select value, (select count(distinct p_name) from part) as distinct_count
from (select distinct p_name as value from part)""")
def agg_distinct_values(spark, folder):
    return aggregate.distinct_values(table(spark, folder, "part"), "p_name")


@query("agg_percentile", f"select round(quantile_cont(sales, 0.9), 4) as value from ({LINE})")
def agg_percentile(spark, folder):
    return rounded(aggregate.percentile(_line(spark, folder), "sales", 90))


@query("agg_quartile", f"""
select round(quantile_cont(sales, 0.25), 4) as q1, round(quantile_cont(sales, 0.5), 4) as q2,
       round(quantile_cont(sales, 0.75), 4) as q3 from ({LINE})""")
def agg_quartile(spark, folder):
    return rounded(aggregate.quartiles(_line(spark, folder), "sales"))


@query("distribution_summary", """
select round(avg(o_totalprice), 4) as mean, round(quantile_cont(o_totalprice, 0.5), 4) as median,
       round(stddev_samp(o_totalprice), 4) as std_dev, round(var_samp(o_totalprice), 0) as variance,
       round(min(o_totalprice), 4) as min, round(quantile_cont(o_totalprice, 0.25), 4) as p25,
       round(quantile_cont(o_totalprice, 0.5), 4) as p50,
       round(quantile_cont(o_totalprice, 0.75), 4) as p75, round(max(o_totalprice), 4) as max,
       round(skewness(o_totalprice), 6) as skewness
from orders""")
def distribution_summary(spark, folder):
    out = aggregate.distribution(table(spark, folder, "orders"), "o_totalprice")
    return rounded(out, 4, variance=0, skewness=6)


@query("agg_correlation", f"select round(corr(sales, quantity), 6) as value from ({LINE})")
def agg_correlation(spark, folder):
    return rounded(aggregate.correlation(_line(spark, folder), "sales", "quantity"), 6)


@query("agg_covariance", f"select round(covar_samp(profit, sales), 0) as value from ({LINE})")
def agg_covariance(spark, folder):
    return rounded(aggregate.covariance(_line(spark, folder), "profit", "sales"), 0)


@query("outliers_iqr", """
with q as (select quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.75) as q3 from events),
     b as (select q1 - 1.5 * (q3 - q1) as lo, q3 + 1.5 * (q3 - q1) as hi from q)
select count(*) filter (where value < lo or value > hi) as outlier_count,
       round(any_value(lo), 4) as lower_bound, round(any_value(hi), 4) as upper_bound,
       count(*) as total_records
from events, b""")
def outliers_iqr(spark, folder):
    return rounded(aggregate.outliers(table(spark, folder, "events"), "value"))


def _pair(name, op, sql, places=2, scale=1.0):
    @query(name, f"""
select round(({sql}) / {scale!r}, {places}) as value
from (select sum(sales) as a, sum(cost) as b from ({LINE}))""")
    def run(spark, folder):
        out = aggregate.column_totals(_line(spark, folder), "sales", "cost", op)
        return rounded(out.select((F.col("value") / scale).alias("value")), places)

    return run


_pair("col_addition", "addition", "a + b")
_pair("col_difference", "difference", "a - b")
_pair("col_multiplication", "multiplication", "a * b", 4, 1e12)
_pair("col_ratio", "ratio", "case when b <> 0 then a / b else 0 end", 8)
_pair("col_pct_difference", "percentage_difference",
      "case when b <> 0 then (a - b) / b * 100 else 0 end", 6)


@query("col_formula", f"""
select round(100 * (sum(sales) - sum(cost)) / sum(sales) - avg(discount), 6) as value
from ({LINE})""")
def col_formula(spark, folder):
    totals = {"s": F.sum("sales"), "c": F.sum("cost"), "d": F.avg("discount")}
    return rounded(aggregate.formula(_line(spark, folder), totals, "100 * (s - c) / s - d"), 6)


@query("group_sum", f"""
select brand, round(sum(sales), 2) as value from ({STAR})
group by brand order by 2 desc, 1""")
def group_sum(spark, folder):
    df = facts.sales_rollup(spark, folder, ["brand"])
    return rounded(aggregate.group_by(df, ["brand"], "sales"), 2)


@query("group_mean", f"""
select supplier_id, round(avg(sales), 4) as value from ({LINE})
group by supplier_id order by avg(sales) desc, 1""")
def group_mean(spark, folder):
    return rounded(aggregate.group_by(_line(spark, folder), ["supplier_id"], "sales", "mean"))


@query("group_count", """
select o_orderpriority, count(o_totalprice) as value from orders
group by 1 order by 2 desc, 1""")
def group_count(spark, folder):
    return aggregate.group_by(
        table(spark, folder, "orders"), ["o_orderpriority"], "o_totalprice", "count"
    )


@query("group_median", f"""
select supplier_id, round(quantile_cont(sales, 0.5), 3) as value from ({LINE})
group by 1 order by quantile_cont(sales, 0.5) desc, 1""")
def group_median(spark, folder):
    return rounded(aggregate.group_by(_line(spark, folder), ["supplier_id"], "sales", "median"), 3)


@query("group_multi_key", f"""
select return_flag, line_status, return_flag || ' - ' || line_status as label,
       round(sum(sales), 2) as value
from ({LINE}) group by 1, 2 order by 4, 1, 2""")
def group_multi_key(spark, folder):
    keys = ["return_flag", "line_status"]
    out = aggregate.group_by(_line(spark, folder), keys, "sales", ascending=True)
    return rounded(out.withColumn("label", aggregate.label(keys)), 2)


_GROUPED = ("min", "max", "nunique")


@query("group_extremes", f"""
select supplier_id, round(min(sales), 4) as min, round(max(sales), 4) as max, count(distinct sales) as nunique
from ({LINE}) group by 1""")
def group_extremes(spark, folder):
    """Least, largest and number of different sales of each supplier, each an operator by itself."""
    line = _line(spark, folder)
    parts = [aggregate.group_totals(line, ["supplier_id"], "sales", op, op) for op in _GROUPED]
    return rounded(parts[0].join(parts[1], "supplier_id").join(parts[2], "supplier_id"))


@query("rank_winner", f"""
with t as (select return_flag, sum(sales) as value from ({LINE}) group by 1)
select 'highest' as side, arg_max(return_flag, value) as name, round(max(value), 2) as value from t
union all
select 'lowest', arg_min(return_flag, value), round(min(value), 2) from t""")
def rank_winner(spark, folder):
    line = _line(spark, folder)
    ends = [
        rank.winner(line, "return_flag", "sales", side == "highest").select(
            F.lit(side).alias("side"), F.col("return_flag").alias("name"), "value"
        )
        for side in ("highest", "lowest")
    ]
    return rounded(ends[0].unionByName(ends[1]), 2)


@query("top_n", f"""
select country, round(sum(sales), 2) as value from ({STAR})
group by 1 order by sum(sales) desc, 1 limit 5""")
def top_n(spark, folder):
    return rounded(rank.top_n(facts.sales_rollup(spark, folder, ["country"]), ["country"], "sales", 5), 2)


@query("top_n_filtered", f"""
select product_id, round(sum(sales), 2) as value from ({LINE})
where quantity >= 10 and is_returned group by 1 order by sum(sales) desc, 1 limit 10""")
def top_n_filtered(spark, folder):
    df = filters.where_all(
        _line(spark, folder), [("quantity", ">=", 10), ("is_returned", "==", "True")]
    )
    return rounded(rank.top_n(df, ["product_id"], "sales"), 2)


@query("bottom_n", f"""
select product_id, round(sum(sales), 2) as value from ({LINE})
group by 1 order by sum(sales), 1 limit 10""")
def bottom_n(spark, folder):
    return rounded(rank.bottom_n(_line(spark, folder), ["product_id"], "sales"), 2)


@query("ranking", f"""
select customer_id, round(v, 2) as value, row_number() over (order by v desc, customer_id) as place
from (select o_custkey as customer_id, sum(o_totalprice) as v from orders group by 1)
order by v desc, customer_id limit 10""")
def ranking(spark, folder):
    df = table(spark, folder, "orders").withColumnRenamed("o_custkey", "customer_id")
    return rounded(rank.ranking(df, ["customer_id"], "o_totalprice", limit=10), 2)


@query("ranking_all", """
select customer_id, round(v, 2) as value, row_number() over (order by v desc, customer_id) as place
from (select o_custkey as customer_id, sum(o_totalprice) as v from orders group by 1)""")
def ranking_all(spark, folder):
    df = table(spark, folder, "orders").withColumnRenamed("o_custkey", "customer_id")
    return rounded(rank.ranking(df, ["customer_id"], "o_totalprice"), 2)


def _inside(name, ascending):
    side = "" if ascending else "desc"

    @query(name, f"""
select region, brand, region || ' → ' || brand as label, round(v, 2) as value, place
from (select *, row_number() over (partition by region order by v {side}, brand) as place
      from (select region, brand, sum(sales) as v from ({STAR}) group by 1, 2))
where place <= 3""")
    def run(spark, folder):
        df = facts.sales_rollup(spark, folder, ["region", "brand"])
        return rounded(
            rank.partitioned_top_n(df, "region", "brand", "sales", 3, ascending=ascending), 2
        )

    return run


_inside("partitioned_top_n", False)
_inside("partitioned_bottom_n", True)
