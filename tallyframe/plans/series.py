"""Queries over time series."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.operators import timeseries as ts
from tallyframe.plans.base import query, rounded
from tallyframe.sources.tables import table

_TRUNC = "date_trunc('{g}', cast({d} as date))::date"
_STEP = {"day": "1 day", "week": "7 day", "month": "1 month", "quarter": "3 month", "year": "1 year"}
_LABEL = {
    "day": "strftime(p, '%Y-%m-%d')",
    "week": "strftime(p + 6, '%Y-%m-%d')",
    "month": "strftime(p, '%Y-%m')",
    "quarter": "year(p) || 'Q' || quarter(p)",
    "year": "strftime(p, '%Y')",
}


def _series_sql(grain, source="orders", date="o_orderdate", value="o_totalprice"):
    """Calendar spine left-joined to the sums, as CTEs ending in ``s(p, period, total)``."""
    t = _TRUNC.format(g=grain, d=date)
    return f"""
with g as (select {t} as p, coalesce(sum({value}), 0) as v from {source}
           where {date} is not null group by 1),
     spine as (select cast(unnest(generate_series((select min(p) from g)::timestamp,
                 (select max(p) from g)::timestamp, interval '{_STEP[grain]}')) as date) as p),
     s as (select spine.p, {_LABEL[grain]} as period, coalesce(v, 0) as total
           from (select p from spine) spine left join (select p as gp, v from g) on gp = spine.p)"""


def _orders(spark, folder):
    return table(spark, folder, "orders")


def _trend(grain):
    @query(f"ts_trend_{grain}", f"{_series_sql(grain)} select period, round(total, 2) as total from s")
    def run(spark, folder):
        out = ts.resample(_orders(spark, folder), "o_orderdate", "o_totalprice", grain)
        return rounded(out.select("period", "total"), 2)

    return run


for _grain in _STEP:
    _trend(_grain)


# sparse input: most days have no such order, so the gaps are real
_SPARSE = "(select * from orders where o_totalprice > 495000 and o_orderstatus = 'P')"


@query("ts_gap_filled_day", f"""{_series_sql('day', _SPARSE)}
select period, round(total, 2) as total from s""")
def ts_gap_filled_day(spark, folder):
    df = _orders(spark, folder).filter("o_totalprice > 495000 and o_orderstatus = 'P'")
    return rounded(ts.resample(df, "o_orderdate", "o_totalprice", "day").select("period", "total"), 2)


@query("ts_month_present_only", f"""
select strftime(date_trunc('month', o_orderdate), '%Y-%m') as period,
       round(avg(o_totalprice), 4) as total
from {_SPARSE} group by 1""")
def ts_month_present_only(spark, folder):
    df = _orders(spark, folder).filter("o_totalprice > 495000 and o_orderstatus = 'P'")
    out = ts.present_periods(df, "o_orderdate", "o_totalprice", "month", "mean")
    return rounded(out.select("period", "total"))


def _growth_sql(lag):
    return f"""case when lag(total, {lag}) over (order by p) <> 0
      then (total - lag(total, {lag}) over (order by p)) / lag(total, {lag}) over (order by p) * 100 end"""


@query("ts_mom_growth", f"""{_series_sql('month')}
select period, round(total, 2) as total, round({_growth_sql(1)}, 6) as growth_pct from s""")
def ts_mom_growth(spark, folder):
    out = ts.growth(_orders(spark, folder), "o_orderdate", "o_totalprice")
    return rounded(out.drop("period_start"), 2, growth_pct=6)


@query("ts_yoy_growth", f"""{_series_sql('month')}
select period, round(total, 2) as total, round({_growth_sql(12)}, 6) as growth_pct from s""")
def ts_yoy_growth(spark, folder):
    out = ts.year_over_year(_orders(spark, folder), "o_orderdate", "o_totalprice")
    return rounded(out.drop("period_start"), 2, growth_pct=6)


@query("ts_best_growth_period", f"""{_series_sql('month')},
gr as (select p, period, {_growth_sql(1)} as g from s)
select period as highest_growth_period, round(g, 6) as highest_growth_value
from gr where g is not null order by g desc, p limit 1""")
def ts_best_growth_period(spark, folder):
    return rounded(ts.best_growth(_orders(spark, folder), "o_orderdate", "o_totalprice"), 6)


@query("ts_period_comparison", f"""{_series_sql('year')}
select period, round(total, 2) as total, round(coalesce({_growth_sql(1)}, 0), 6) as growth_pct
from s""")
def ts_period_comparison(spark, folder):
    out = ts.period_comparison(_orders(spark, folder), "o_orderdate", "o_totalprice", "year")
    return rounded(out.drop("period_start"), 2, growth_pct=6)


@query("ts_current_vs_previous", f"""{_series_sql('quarter')}
select * from (
  select period, round(total, 2) as total, lag(period) over (order by p) as previous_period,
         round(lag(total) over (order by p), 2) as previous_total,
         round({_growth_sql(1)}, 6) as growth_pct
  from s order by p desc limit 1)""")
def ts_current_vs_previous(spark, folder):
    out = ts.current_vs_previous(_orders(spark, folder), "o_orderdate", "o_totalprice", "quarter")
    return rounded(out, 2, growth_pct=6)


@query("ts_moving_average", f"""{_series_sql('week', 'events', 'ts', 'value')}
select period, round(total, 2) as total,
       round(case when row_number() over (order by p) < 3 then 0
             else avg(total) over (order by p rows between 2 preceding and current row) end, 4)
         as moving_average from s""")
def ts_moving_average(spark, folder):
    out = ts.moving_average(table(spark, folder, "events"), "ts", "value", "week", 3)
    return rounded(out.drop("period_start"), 2, moving_average=4)


@query("ts_cumulative", f"""{_series_sql('day', 'events', 'ts', 'value')}
select period, round(total, 2) as total,
       round(sum(total) over (order by p rows unbounded preceding), 2) as running_total from s""")
def ts_cumulative(spark, folder):
    out = ts.cumulative(table(spark, folder, "events"), "ts", "value", "day")
    return rounded(out.drop("period_start"), 2)


@query("ts_dirty_dates", """
select strftime(date_trunc('quarter', d), '%Y') || 'Q' || quarter(d) as period,
       round(sum(o_totalprice), 2) as total
from (select try_strptime(t, ['%Y-%m-%d', '%Y/%m/%d']) as d, o_totalprice
      from (select case o_orderkey % 4 when 0 then 'unknown' when 1 then strftime(o_orderdate, '%Y/%m/%d')
                   else strftime(o_orderdate, '%Y-%m-%d') end as t, o_totalprice from orders))
where d is not null group by 1, quarter(d)""")
def ts_dirty_dates(spark, folder):
    from tallyframe.functions.columns import parse_date

    text = F.expr(
        "case o_orderkey % 4 when 0 then 'unknown' when 1 then date_format(o_orderdate, 'yyyy/MM/dd')"
        " else date_format(o_orderdate, 'yyyy-MM-dd') end"
    )
    df = _orders(spark, folder).select(parse_date(text).alias("d"), "o_totalprice")
    return rounded(ts.resample(df, "d", "o_totalprice", "quarter").select("period", "total"), 2)
