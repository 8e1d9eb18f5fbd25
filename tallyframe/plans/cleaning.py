"""Queries of the cleaning pipeline.

The dirty columns are derived from clean ones with the same expression on both
sides; parsing and repair are then done independently.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.functions import columns as fn
from tallyframe.operators import clean
from tallyframe.plans.base import query, rounded
from tallyframe.sources.tables import table

_PRICE = """case o_orderkey % 8
 when 0 then '$' || cast(o_totalprice as string)
 when 1 then '₹' || cast(cast(floor(o_totalprice / 1000) as bigint) as string) || ','
      || lpad(cast(cast(floor(o_totalprice) as bigint) % 1000 as string), 3, '0')
 when 2 then cast(cast(floor(o_totalprice / 1000) as bigint) as string) || 'K'
 when 3 then cast(o_orderkey % 90 + 10 as string) || '.5m'
 when 4 then ' N/A '
 when 5 then cast(o_orderkey % 100 as string) || '%'
 when 6 then 'abc'
 else '  ' || cast(o_totalprice as string) end"""
_PRIORITY = """case when o_orderpriority = '1-URGENT' then ' n/a' when o_orderpriority = '2-HIGH' then '?'
 when o_orderpriority = '5-LOW' then '' else '  ' || o_orderpriority || ' ' end"""


def _day(spark_side: bool) -> str:
    def f(java: str, c: str) -> str:
        return f"date_format(o_orderdate, '{java}')" if spark_side else f"strftime(o_orderdate, '{c}')"

    return f"""case o_orderkey % 6 when 0 then {f('yyyy/MM/dd', '%Y/%m/%d')}
      when 1 then {f('dd-MM-yyyy', '%d-%m-%Y')} when 2 then {f('MM/dd/yyyy', '%m/%d/%Y')}
      when 3 then {f('yyyy-MM-dd HH:mm:ss', '%Y-%m-%d %H:%M:%S')} when 4 then 'invalid_date'
      else {f('yyyy-MM-dd', '%Y-%m-%d')} end"""


_PARSED = r"""case when regexp_matches(b, '^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)[kKmMbB]?$')
  then try_cast(regexp_replace(b, '[kKmMbB]$', '') as double)
       * case lower(right(b, 1)) when 'k' then 1e3 when 'm' then 1e6 when 'b' then 1e9 else 1 end
  when regexp_matches(b, '^[+-]?[0-9.]+(%|pct)$')
  then try_cast(regexp_replace(b, '(%|pct)$', '') as double) end"""
_BARE = r"regexp_replace(trim({t}), '[₹$€£,\s]', '', 'g')"


@query("parse_currency", f"""
select o_orderkey, round({_PARSED}, 4) as value
from (select o_orderkey, {_BARE.format(t='t')} as b from (select o_orderkey, {_PRICE} as t from orders))""")
def parse_currency(spark, folder):
    df = table(spark, folder, "orders").select("o_orderkey", F.expr(_PRICE).alias("t"))
    return rounded(df.select("o_orderkey", fn.parse_number("t").alias("value")))


@query("clean_null_tokens", f"""
select o_orderkey, case when lower(trim(t)) in ('', 'nan', 'null', 'none', 'n/a', '#n/a', 'na', '?')
                   then null else trim(t) end as priority
from (select o_orderkey, {_PRIORITY} as t from orders)""")
def clean_null_tokens(spark, folder):
    df = table(spark, folder, "orders").select("o_orderkey", F.expr(_PRIORITY).alias("priority"))
    return clean.null_tokens(df)


@query("clean_dedupe", """
select distinct md5(text) as digest, lang, n_chars from documents""")
def clean_dedupe(spark, folder):
    df = table(spark, folder, "documents").select("text", "lang", "n_chars")
    return clean.dedupe(df).select(F.md5("text").alias("digest"), "lang", "n_chars")


@query("clean_numeric_coerce", f"""
select o_orderkey, t as mostly_text, round({_PARSED}, 4) as price
from (select o_orderkey, case when o_orderkey % 2 = 0 then '5k' else 'word' end as t,
             {_BARE.format(t='p')} as b
      from (select o_orderkey, case when o_orderkey % 8 in (4, 6) and o_orderkey % 3 > 0
                   then '7.5' else {_PRICE} end as p from orders))""")
def clean_numeric_coerce(spark, folder):
    df = table(spark, folder, "orders").select(
        "o_orderkey",
        F.expr("case when o_orderkey % 2 = 0 then '5k' else 'word' end").alias("mostly_text"),
        F.expr(
            f"case when o_orderkey % 8 in (4, 6) and o_orderkey % 3 > 0 then '7.5' else {_PRICE} end"
        ).alias("price"),
    )
    return rounded(clean.to_numbers(df, clean.numeric_text_columns(df, ["o_orderkey"])))


@query("clean_dates", f"""
select o_orderkey, strftime(try_strptime(t, ['%Y-%m-%d', '%Y/%m/%d', '%d-%m-%Y', '%m/%d/%Y',
       '%Y-%m-%d %H:%M:%S']), '%Y-%m-%d') as order_date
from (select o_orderkey, {_day(False)} as t from orders)""")
def clean_dates(spark, folder):
    df = table(spark, folder, "orders").select("o_orderkey", F.expr(_day(True)).alias("order_date"))
    out = clean.to_dates(df, ["order_date"])
    return out.withColumn("order_date", F.date_format("order_date", "yyyy-MM-dd"))


@query("clean_dates_invalid", f"""
select 'order_date' as "column", count(*) filter (where o_orderkey % 6 = 4) as invalid_dates
from orders""")
def clean_dates_invalid(spark, folder):
    df = table(spark, folder, "orders").select(F.expr(_day(True)).alias("order_date"))
    return clean.invalid_dates(df, ["order_date"])


@query("chronology_check", """
select 'order_date' as earlier, 'delivery_date' as later,
       count(*) filter (where o_orderdate > l_shipdate) as anomalies
from lineitem join orders on o_orderkey = l_orderkey
union all
select 'delivery_date', 'return_date', count(*) filter (where l_returnflag = 'R'
       and l_shipdate > o_orderdate + interval '60 day')
from lineitem join orders on o_orderkey = l_orderkey""")
def chronology_check(spark, folder):
    line = table(spark, folder, "lineitem").select("l_orderkey", "l_shipdate", "l_returnflag")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderdate")
    df = line.join(orders, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.to_date("o_orderdate").alias("order_date"),
        F.to_date("l_shipdate").alias("delivery_date"),
        F.when(F.col("l_returnflag") == "R", F.date_add("o_orderdate", 60)).alias("return_date"),
    )
    return clean.chronology(df, clean.date_pairs(df.columns))


_GAPS = {
    "discount": "case when l_quantity < 10 then null else l_discount end",
    "price": "case when l_quantity < 10 then null else l_extendedprice end",
    "flag": "case when l_quantity < 10 then null else l_returnflag end",
    "returned": "case when l_quantity < 10 then null else l_returnflag = 'R' end",
}


def _gaps(spark, folder, *names):
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", *[F.expr(_GAPS[n]).alias(n) for n in names]
    )


@query("impute_zero", f"""
select l_orderkey, l_linenumber, coalesce({_GAPS['discount']}, 0) as discount from lineitem""")
def impute_zero(spark, folder):
    return clean.impute(_gaps(spark, folder, "discount"), with_nulls=["discount"])


@query("impute_median", f"""
select l_orderkey, l_linenumber,
       coalesce({_GAPS['price']}, (select round(median({_GAPS['price']}), 2) from lineitem)) as price
from lineitem""")
def impute_median(spark, folder):
    return clean.impute(_gaps(spark, folder, "price"), with_nulls=["price"])


@query("impute_unknown", f"""
select l_orderkey, l_linenumber, coalesce({_GAPS['flag']}, 'Unknown') as flag from lineitem""")
def impute_unknown(spark, folder):
    return clean.impute(_gaps(spark, folder, "flag"), with_nulls=["flag"])


@query("impute_false", f"""
select l_orderkey, l_linenumber, coalesce({_GAPS['returned']}, false) as returned from lineitem""")
def impute_false(spark, folder):
    return clean.impute(_gaps(spark, folder, "returned"), with_nulls=["returned"])


# A dirty table with copies: every low-priority order stands twice.
_DIRTY = {
    "order_code": "cast(o_orderkey as string)",
    "order_date": None,
    "price": "case when o_orderkey % 8 in (4, 6) and o_orderkey % 3 > 0 then '7.5' else " + _PRICE + " end",
    "priority": _PRIORITY,
    "tax": "case when o_orderkey % 4 = 0 then null else o_totalprice * 0.1e0 end",
    "weight": "case when o_orderkey % 5 = 0 then null else o_totalprice / 2 end",
    "return_date": "case when o_orderkey % 9 = 0 then '2000-01-01' end",
    "delivery_date": "case when o_orderkey % 7 = 0 then '1999-01-01' else '2002-01-01' end",
}


def dirty(spark, folder):
    orders = table(spark, folder, "orders")
    both = orders.unionAll(orders.filter("o_orderpriority = '5-LOW'"))
    return both.select(*[F.expr(e or _day(True)).alias(n) for n, e in _DIRTY.items()])


_DIRTY_SQL = (
    "dirty as (select "
    + ", ".join(f"{e or _day(False)} as {n}" for n, e in _DIRTY.items())
    + " from (select * from orders union all select * from orders where o_orderpriority = '5-LOW')),\n"
    + f"""texts as (select order_code, order_date as order_text, price as price_text,
        case when lower(trim(priority)) in ('', 'nan', 'null', 'none', 'n/a', '#n/a', 'na', '?') then null
             else trim(priority) end as priority, tax, weight, return_date, delivery_date,
        case when trim(price) = 'N/A' then null else {_BARE.format(t='price')} end as b
        from (select distinct * from dirty)),
typed as (select order_code, order_text, b, priority, tax, weight,
        try_strptime(return_date, '%Y-%m-%d') as return_date,
        try_strptime(delivery_date, '%Y-%m-%d') as delivery_date,
        try_strptime(order_text, ['%Y-%m-%d', '%Y/%m/%d', '%d-%m-%Y', '%m/%d/%Y',
                                  '%Y-%m-%d %H:%M:%S']) as order_date,
        {_PARSED} as price,
        trim(price_text) as raw_price from texts)"""
)
_REPORT_SQL = f"""{_DIRTY_SQL},
m as (select
  (select count(*) from dirty) as rows_before,
  (select sum((tax is null)::int + (weight is null)::int + (return_date is null)::int) from dirty) as missing_before,
  (select count(*) from dirty) - (select count(*) from typed) as duplicates_removed,
  (select count(*) from typed) as rows_after,
  (select sum((order_date is null)::int + (price is null)::int + (priority is null)::int
     + (tax is null)::int + (weight is null)::int + (return_date is null)::int
     + (delivery_date is null)::int) from typed) as missing_values_fixed,
  (select count(*) from typed where order_date is null) as invalid_dates,
  (select count(*) from typed where price is not null and try_cast(raw_price as double) is null) as numbers_sanitized,
  (select count(*) filter (where order_date > delivery_date) + count(*) filter (where delivery_date > return_date)
     from typed) as chronology_anomalies)"""
_METRICS = ["rows_before", "missing_before", "duplicates_removed", "rows_after",
            "missing_values_fixed", "invalid_dates", "numbers_sanitized", "chronology_anomalies"]
_SCORE = """greatest(0.0, least(100.0, round(100.0 - 100.0 * (missing_before + 8 * duplicates_removed
  + invalid_dates + numbers_sanitized + chronology_anomalies) / (rows_before * 8), 1)))::double"""


@query("quality_report", f"""
with {_REPORT_SQL}
select unnest({_METRICS + ['quality_score']!r}) as metric,
       unnest([{', '.join(c + '::double' for c in _METRICS)}, {_SCORE}]) as value from m""")
def quality_report(spark, folder):
    return clean.quality_report(dirty(spark, folder))


@query("quality_score", f"with {_REPORT_SQL} select {_SCORE} as quality_score from m")
def quality_score(spark, folder):
    out = clean.quality_report(dirty(spark, folder)).filter("metric = 'quality_score'")
    return out.select(F.col("value").alias("quality_score"))


@query("quality_badge", """
select c_custkey, case when c_acctbal / 100 >= 90 then 'Excellent' when c_acctbal / 100 >= 75
       then 'Moderate' else 'Needs Attention' end as badge from customer""")
def quality_badge(spark, folder):
    return table(spark, folder, "customer").select(
        "c_custkey", fn.quality_badge(F.col("c_acctbal") / 100).alias("badge")
    )


_FILLS = {
    "order_code": ("string", "Unknown"), "order_date": ("date", None), "price": ("double", "median"),
    "priority": ("string", "Unknown"), "tax": ("double", "0"), "weight": ("double", "median"),
    "return_date": ("date", None), "delivery_date": ("date", None),
}


@query("column_actions", f"with {_DIRTY_SQL}\n" + "\nunion all\n".join(
    f"""select '{c}' as "column", '{kind}' as dtype, count(*) - count({c}) as missing_before,
       {'count(*) - count(' + c + ')' if fill is None else '0::bigint'} as missing_after,
       case when count(*) = count({c}) then 'clean'
            else '{'preserved' if fill is None else 'filled with ' + fill}' end as action from typed"""
    for c, (kind, fill) in _FILLS.items()))
def column_actions(spark, folder):
    return clean.column_actions(dirty(spark, folder))


@query("clean_pipeline", f"""
with {_DIRTY_SQL}
select order_code, strftime(order_date, '%Y-%m-%d') as order_date,
       round(coalesce(price, (select round(median(price), 2) from typed)), 4) as price,
       coalesce(priority, 'Unknown') as priority, round(coalesce(tax, 0), 4) as tax,
       round(coalesce(weight, (select round(median(weight), 2) from typed)), 4) as weight,
       strftime(return_date, '%Y-%m-%d') as return_date,
       strftime(delivery_date, '%Y-%m-%d') as delivery_date
from typed""")
def clean_pipeline(spark, folder):
    out = clean.clean(dirty(spark, folder))
    for c in ("order_date", "return_date", "delivery_date"):
        out = out.withColumn(c, F.date_format(c, "yyyy-MM-dd"))
    return rounded(out)
