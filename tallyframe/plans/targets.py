"""Queries for KPI targets and alerts.

KPI definitions are derived from the supplier table, snapshots and the alert
log from the events table.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.functions.columns import recipient_list
from tallyframe.operators import alerts, kpi
from tallyframe.plans.base import query
from tallyframe.sources.tables import table

_HOW = ["sum", "average", "median", "min", "max", "count", "RATE", "other"]
_METRIC = ["o_totalprice", "o_custkey", "o_orderpriority", "absent_column"]


def _pick(words: list[str], index: str, spark_side: bool) -> str:
    listed = ", ".join(f"'{w}'" for w in words)
    at = f"cast({index} as int)"
    return f"element_at(array({listed}), {at})" if spark_side else f"list_extract([{listed}], {at})"


def _definitions_text(spark_side: bool) -> dict[str, str]:
    day = "cast(date_add(date '1995-01-01', cast((s_suppkey * 37) % 2400 as int){extra}) as string)"
    if not spark_side:
        day = "strftime(date '1995-01-01' + cast((s_suppkey * 37) % 2400 as int){extra}, '%Y-%m-%d')"
    start, end = day.format(extra=""), day.format(extra=" + 45")
    return {
        "id": "'kpi_' || cast(s_suppkey as string)",
        "dataset_id": "case when s_suppkey % 3 = 0 then null else 'ds_' || cast(s_suppkey % 3 as string) end",
        "kpi_name": "s_name",
        "metric_column": _pick(_METRIC, "s_suppkey / 8 % 4 + 1" if spark_side else "s_suppkey // 8 % 4 + 1", spark_side),
        "calculation": "case when s_suppkey % 16 = 15 then null else "
        + _pick(_HOW, "s_suppkey % 8 + 1", spark_side) + " end",
        "target_value": "case when s_suppkey % 20 = 19 then 0e0 else round(abs(s_acctbal) * 100) end",
        "start_date": f"case when s_suppkey % 10 = 1 then null else {start} end",
        "end_date": f"case when s_suppkey % 10 in (1, 2) then null else {end} end",
        "alert_threshold_pct": "case when s_suppkey % 4 = 0 then null else 5e0 + s_suppkey % 7 end",
        "recipients": "case when s_suppkey % 5 = 0 then null when s_suppkey % 5 = 1 then 'nobody'"
        " else 'a' || cast(s_suppkey as string) || '@x.org, bad, b@y.org' end",
        "status": "case when s_suppkey % 6 = 5 then 'PAUSED' when s_suppkey % 6 = 4 then null else 'ACTIVE' end",
    }


def definitions(spark, folder):
    df = table(spark, folder, "supplier")
    text = dict(_definitions_text(True))
    text["metric_column"] = _pick(_METRIC, "floor(s_suppkey / 8) % 4 + 1", True)
    return df.select(*[F.expr(e).alias(n) for n, e in text.items()])


_KPIS_SQL = (
    "defs as (select " + ", ".join(f"{e} as {n}" for n, e in _definitions_text(False).items())
    + """ from supplier),
kpis as (select id, dataset_id, kpi_name, metric_column, upper(coalesce(calculation, 'SUM')) as calculation,
        target_value, 'Monthly' as period, start_date, end_date,
        coalesce(alert_threshold_pct, 10.0) as alert_threshold_pct,
        coalesce(recipients, '') as recipients, coalesce(status, 'ACTIVE') as status from defs)"""
)


def _r(text: str, n: int = 2, digits: int = 15) -> str:
    """Decimal rounding, so that halves round the same way on both sides."""
    return f"cast(round(cast({text} as decimal(38, {digits})), {n}) as double)"


@query("kpi_definitions_normalize", f"with {_KPIS_SQL} select * from kpis")
def kpi_definitions_normalize(spark, folder):
    return kpi.normalize_definitions(definitions(spark, folder))


@query("kpi_scope", f"""
with {_KPIS_SQL}
select id, dataset_id from kpis where (dataset_id = 'ds_1' or dataset_id is null) and status = 'ACTIVE'""")
def kpi_scope(spark, folder):
    kpis = kpi.normalize_definitions(definitions(spark, folder))
    return kpi.in_scope(kpis, "ds_1").select("id", "dataset_id")


_RATED = f"""
v as (select *, {_r('actual_value - target_value')} as variance,
        {_r('case when target_value <> 0 then actual_value / target_value * 100 else 0 end')} as achievement_pct
      from x),
p as (select *, {_r('case when target_value <> 0 then variance / target_value * 100 else 0 end')} as variance_pct,
        case when try_cast(end_date as date) > try_cast(start_date as date)
          then {_r('''least(100.0, greatest(0, date_diff('day', try_cast(start_date as date), as_of))
             / date_diff('day', try_cast(start_date as date), try_cast(end_date as date))::double * 100)''')}
          else 100.0 end::double as expected_progress_pct from v),
g as (select *, achievement_pct as actual_progress_pct,
        {_r('achievement_pct - expected_progress_pct')} as performance_gap from p),
rated as (select * exclude (status), case when achievement_pct >= 100 then 'EXCEEDED'
        when performance_gap >= 0 or achievement_pct >= 100 - alert_threshold_pct then 'ON TRACK'
        when performance_gap >= -15 or achievement_pct >= 70 then 'AT RISK' else 'CRITICAL' end as status from g)"""


@query("kpi_evaluate_all", f"""
with {_KPIS_SQL},
active as (select * from kpis where status = 'ACTIVE'),
f as (select a.id, case a.metric_column when 'o_totalprice' then o_totalprice
             when 'o_custkey' then o_custkey::double else 0 end as v
      from active a join orders o
        on a.metric_column <> 'absent_column'
       and cast(o_orderdate as date) >= coalesce(cast(a.start_date as date), date '0001-01-01')
       and cast(o_orderdate as date) <= coalesce(cast(a.end_date as date), date '9999-12-31')),
s as (select id, sum(v) as s, avg(v) as a, median(v) as m, min(v) as lo, max(v) as hi, count(*) as n
      from f group by 1),
x as (select k.*, date '1998-06-15' as as_of,
             case when k.metric_column = 'absent_column' then null else
             {_r('''coalesce(case calculation when 'AVERAGE' then a when 'RATE' then a when 'MEDIAN' then m
               when 'MIN' then lo when 'MAX' then hi when 'COUNT' then n::double else s end, 0)''', digits=9)} end as actual_value
      from active k left join s using (id)),
{_RATED}
select id as kpi_id, kpi_name, metric_column, calculation, target_value, actual_value,
       variance, case when actual_value is not null then variance_pct end as variance_pct,
       case when actual_value is not null then achievement_pct end as achievement_pct,
       case when actual_value is not null then expected_progress_pct end as expected_progress_pct,
       case when actual_value is not null then actual_progress_pct end as actual_progress_pct,
       case when actual_value is not null then performance_gap end as performance_gap,
       case when actual_value is null then 'ERROR' else status end as status, recipients
from rated""")
def kpi_evaluate_all(spark, folder):
    orders = table(spark, folder, "orders")
    return kpi.evaluate(
        definitions(spark, folder), orders, "1998-06-15",
        ["o_totalprice", "o_custkey", "o_orderpriority"], "o_orderdate",
    )


# Snapshots: one event is one evaluation of the KPI named after the user.
_SNAP = {
    "id": "cast(event_id as string)",
    "kpi_id": "'kpi_' || cast(user_id as string)",
    "kpi_name": "'KPI ' || cast(user_id as string)",
    "snapshot_time": "ts",
    "actual_value": "cast(round(value * 4, 2) as double)",
    "target_value": "80.7e0 + (user_id % 40) * 1.3e0",
    "recipients": "case when user_id % 3 = 0 then '' when user_id % 3 = 1 then 'x@y.org, z'"
    " else null end",
    "alert_threshold_pct": "10e0",
}


def _snap_dates(spark_side: bool) -> dict[str, str]:
    if spark_side:
        return {
            "start_date": "cast(date_add(date '2024-01-01', cast(user_id % 10 as int)) as string)",
            "end_date": "cast(date_add(date '2024-01-01', cast(user_id % 10 + user_id % 31 as int)) as string)",
        }
    return {
        "start_date": "strftime(date '2024-01-01' + cast(user_id % 10 as int), '%Y-%m-%d')",
        "end_date": "strftime(date '2024-01-01' + cast(user_id % 10 + user_id % 31 as int), '%Y-%m-%d')",
    }


def snapshots(spark, folder):
    text = {**_SNAP, **_snap_dates(True)}
    df = table(spark, folder, "events").select(*[F.expr(e).alias(n) for n, e in text.items()])
    return kpi.with_status(kpi.progress(kpi.variance(df), F.to_date("snapshot_time")))


_SNAP_SQL = (
    "x as (select " + ", ".join(f"{e} as {n}" for n, e in {**_SNAP, **_snap_dates(False)}.items())
    + ", cast(ts as date) as as_of, '' as status from events)," + _RATED
)


@query("kpi_variance", f"""
with {_SNAP_SQL} select id, variance, variance_pct, achievement_pct from rated""")
def kpi_variance(spark, folder):
    return snapshots(spark, folder).select("id", "variance", "variance_pct", "achievement_pct")


@query("kpi_progress", f"""
with {_SNAP_SQL} select id, expected_progress_pct, actual_progress_pct, performance_gap from rated""")
def kpi_progress(spark, folder):
    return snapshots(spark, folder).select(
        "id", "expected_progress_pct", "actual_progress_pct", "performance_gap"
    )


@query("kpi_status", f"with {_SNAP_SQL} select id, status from rated")
def kpi_status(spark, folder):
    return snapshots(spark, folder).select("id", "status")


_LATEST_SQL = f"""{_SNAP_SQL},
last as (select * from (select *, row_number() over (partition by kpi_id order by snapshot_time desc, id desc) as rn
         from rated) where rn = 1),
k as (select 'kpi_' || c_custkey as id, c_name as kpi_name from customer)"""
_STAMP = "%Y-%m-%d %H:%M:%S"


def _customers_as_kpis(spark, folder):
    return table(spark, folder, "customer").select(
        F.concat(F.lit("kpi_"), F.col("c_custkey").cast("string")).alias("id"),
        F.col("c_name").alias("kpi_name"),
    )


@query("kpi_latest_left_join", f"""
with {_LATEST_SQL}
select k.id, k.kpi_name, last.actual_value, last.achievement_pct, last.expected_progress_pct,
       last.actual_progress_pct, last.performance_gap, last.status as latest_status,
       strftime(last.snapshot_time, '{_STAMP}') as last_evaluated_at
from k left join last on last.kpi_id = k.id""")
def kpi_latest_left_join(spark, folder):
    out = kpi.with_latest(_customers_as_kpis(spark, folder), snapshots(spark, folder))
    return out.withColumn("last_evaluated_at", F.date_format("last_evaluated_at", "yyyy-MM-dd HH:mm:ss"))


@query("kpi_dashboard_counts", f"""
with {_LATEST_SQL}
select count(*) as total_kpis, count(*) filter (where s = 'ON TRACK') as on_track,
       count(*) filter (where s = 'AT RISK') as at_risk, count(*) filter (where s = 'CRITICAL') as critical,
       count(*) filter (where s = 'EXCEEDED') as exceeded, count(*) filter (where s is null) as unmonitored
from (select last.status as s from k left join last on last.kpi_id = k.id)""")
def kpi_dashboard_counts(spark, folder):
    return kpi.dashboard_counts(
        kpi.with_latest(_customers_as_kpis(spark, folder), snapshots(spark, folder))
    )


@query("kpi_history", f"""
with {_SNAP_SQL}
select id, strftime(snapshot_time, '{_STAMP}') as snapshot_time, actual_value, status from rated
where kpi_id = 'kpi_7' order by rated.snapshot_time desc, id desc limit 30""")
def kpi_history(spark, folder):
    out = alerts.snapshot_history(snapshots(spark, folder), "kpi_7", 30)
    return out.select(
        "id", F.date_format("snapshot_time", "yyyy-MM-dd HH:mm:ss").alias("snapshot_time"),
        "actual_value", "status",
    )


_ALERTS_SQL = f"""{_SNAP_SQL},
al as (select *, case status when 'CRITICAL' then 'CRITICAL' when 'AT RISK' then 'AT_RISK'
                 else 'TARGET_EXCEEDED' end as alert_type,
              case status when 'CRITICAL' then 'CRITICAL' when 'AT RISK' then 'WARNING'
                 else 'INFO' end as severity from rated where status <> 'ON TRACK')"""


@query("alert_rules", f"with {_ALERTS_SQL} select id, kpi_id, alert_type, severity from al")
def alert_rules(spark, folder):
    return alerts.alerts_from(snapshots(spark, folder)).select("id", "kpi_id", "alert_type", "severity")


def _one(x: str) -> str:
    return f"cast(cast(round(cast({x} as decimal(38, 9)), 1) as decimal(18, 1)) as varchar)"


def _money(x: str) -> str:
    return f"format('{{:,.2f}}', {x})"


@query("alert_message", f"""
with {_ALERTS_SQL}
select id, case status
  when 'CRITICAL' then 'Far behind plan, ' || kpi_name || ': ' || {_one('achievement_pct')} || '% done ('
    || {_money('actual_value')} || ' / ' || {_money('target_value')} || '), '
    || case when performance_gap < 0 then '-' else '+' end || {_one('abs(performance_gap)')} || '% to plan'
  when 'AT RISK' then 'Behind plan, ' || kpi_name || ': ' || {_one('achievement_pct')} || '% done, short by '
    || {_one('abs(performance_gap)')} || '%'
  else 'Beyond target, ' || kpi_name || ': ' || {_one('achievement_pct')} || '% done ('
    || {_money('actual_value')} || ' / ' || {_money('target_value')} || ')' end as message
from al""")
def alert_message(spark, folder):
    return alerts.alerts_from(snapshots(spark, folder)).select("id", "message")


@query("alert_recipients", f"""
with {_KPIS_SQL}
select id, array_to_string(list_filter(list_transform(string_split(recipients, ','), lambda x: trim(x)),
       lambda x: contains(x, '@')), ';') as recipients from kpis""")
def alert_recipients(spark, folder):
    kpis = kpi.normalize_definitions(definitions(spark, folder))
    return kpis.select("id", F.array_join(recipient_list("recipients"), ";").alias("recipients"))


def _alert_log(spark, folder):
    return alerts.alerts_from(snapshots(spark, folder)).withColumn("triggered_at", F.col("snapshot_time"))


_PREVIOUS_SQL = f"""{_ALERTS_SQL},
c as (select *, lag(snapshot_time) over (partition by kpi_id, alert_type, severity
              order by snapshot_time, id) as previous_at from al),
cd as (select *, coalesce(snapshot_time - previous_at <= interval '24 hour', false) as suppressed from c)"""


@query("alert_cooldown", f"with {_PREVIOUS_SQL} select id, kpi_id, suppressed from cd")
def alert_cooldown(spark, folder):
    return alerts.cooldown(_alert_log(spark, folder)).select("id", "kpi_id", "suppressed")


@query("alert_notify", f"""
with {_PREVIOUS_SQL}
select id, not suppressed and coalesce(contains(recipients, '@'), false) as notify,
       case when suppressed then 'Same alert within the last 24 hours'
            when not coalesce(contains(recipients, '@'), false) then 'No recipient' end as reason,
       case when contains(recipients, '@') then 'x@y.org' end as send_to
from cd""")
def alert_notify(spark, folder):
    out = alerts.notify(alerts.cooldown(_alert_log(spark, folder)))
    return out.select("id", "notify", "reason", "send_to")


@query("alert_sessions", f"""
with {_PREVIOUS_SQL},
n as (select *, sum(case when suppressed then 0 else 1 end) over (partition by kpi_id, alert_type, severity
        order by snapshot_time, id rows unbounded preceding) as sid from cd)
select kpi_id, alert_type, severity, strftime(min(snapshot_time), '{_STAMP}') as first_at,
       strftime(max(snapshot_time), '{_STAMP}') as last_at, count(*) as n_alerts
from n group by kpi_id, alert_type, severity, sid""")
def alert_sessions(spark, folder):
    out = alerts.sessions(_alert_log(spark, folder))
    for c in ("first_at", "last_at"):
        out = out.withColumn(c, F.date_format(c, "yyyy-MM-dd HH:mm:ss"))
    return out


@query("alert_history_topk", f"""
with {_ALERTS_SQL}
select id, kpi_id, severity, strftime(snapshot_time, '{_STAMP}') as triggered_at
from al where severity = 'WARNING' order by al.snapshot_time desc, id desc limit 100""")
def alert_history_topk(spark, folder):
    out = alerts.history(_alert_log(spark, folder), 100, "warning")
    return out.select("id", "kpi_id", "severity",
                      F.date_format("triggered_at", "yyyy-MM-dd HH:mm:ss").alias("triggered_at"))


@query("alert_latest_five", f"""
with {_ALERTS_SQL}
select id, kpi_id, severity, strftime(snapshot_time, '{_STAMP}') as triggered_at
from al order by al.snapshot_time desc, id desc limit 5""")
def alert_latest_five(spark, folder):
    out = alerts.history(_alert_log(spark, folder), 5, "ALL")
    return out.select("id", "kpi_id", "severity",
                      F.date_format("triggered_at", "yyyy-MM-dd HH:mm:ss").alias("triggered_at"))


@query("kpi_delete_anti", f"""
with {_KPIS_SQL}, gone as (select id from kpis where status = 'PAUSED'),
{_ALERTS_SQL}
select 'kpi_definitions' as source, count(*) as kept from kpis where id not in (select id from gone)
union all
select 'kpi_snapshots', count(*) from rated where kpi_id not in (select id from gone)
union all
select 'alert_log', count(*) from al where kpi_id not in (select id from gone)""")
def kpi_delete_anti(spark, folder):
    from tallyframe.sources.catalog import without_kpis

    kpis = kpi.normalize_definitions(definitions(spark, folder))
    gone = kpis.filter("status = 'PAUSED'").select("id")
    parts = [
        without_kpis(kpis, gone, "id").agg(F.lit("kpi_definitions").alias("source"), F.count("*").alias("kept")),
        without_kpis(snapshots(spark, folder), gone).agg(
            F.lit("kpi_snapshots").alias("source"), F.count("*").alias("kept")
        ),
        without_kpis(_alert_log(spark, folder), gone).agg(F.lit("alert_log").alias("source"), F.count("*").alias("kept")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
