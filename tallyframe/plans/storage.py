"""Queries for sources, sinks, catalog, file sync and streams.

They write below the shared folder of the session and read back what they wrote.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.plans.base import REGISTRY, query, rounded
from tallyframe.plans.targets import definitions
from tallyframe.session import scratch_path, staged
from tallyframe.sources import catalog, files, records
from tallyframe.sources.tables import table
from tallyframe.streaming import live, sync


@query("csv_roundtrip_scan", """
select o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority from orders""")
def csv_roundtrip_scan(spark, folder):
    path = scratch_path(spark, "orders-csv")
    orders = table(spark, folder, "orders")
    # headers with blanks around them, as they come in practice
    files.write_csv(orders.toDF(*[f" {c} " for c in orders.columns]), path)
    return files.read_csv(spark, path)


def _events_with_nulls(spark, folder):
    return table(spark, folder, "events").select(
        "event_id", "ts", "user_id", "event_type",
        F.when(F.col("value") >= 1, F.col("value")).alias("value"), "props",
    )


@query("rows_to_json", """
select 'events' as dataset_id, row_number() over (order by event_id) - 1 as row_index,
       '{"event_id":' || event_id || ',"ts":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '","user_id":' || user_id
       || ',"event_type":"' || event_type || '","value":' || coalesce(case when value >= 1 then value::varchar end, 'null')
       || ',"props":"' || replace(props, '"', '\\"') || '"}' as record_json
from events""")
def rows_to_json(spark, folder):
    return records.to_documents(_events_with_nulls(spark, folder), "events", ["event_id"])


@query("json_to_rows", """
select event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') as ts, user_id, event_type,
       case when value >= 1 then value end as value, props from events""")
def json_to_rows(spark, folder):
    df = _events_with_nulls(spark, folder)
    docs = df.select(F.to_json(F.struct(*df.columns), records._WRITE).alias("record_json"))
    back = records.from_documents(docs, df.schema)
    return back.withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


@query("json_field_counts", """
select cast(json_extract_string(props, '$.k') as bigint) as k, count(*) as n from events group by 1""")
def json_field_counts(spark, folder):
    k = F.get_json_object("props", "$.k").try_cast("long")
    return table(spark, folder, "events").groupBy(k.alias("k")).agg(F.count("*").alias("n"))


# Uploads: one order is one upload of the dataset named after the customer.
_UPLOAD = {
    "id": "'ds_' || cast(o_custkey as string)",
    "uploaded_at": "o_orderdate",
    "row_count": "o_orderkey",
    "filepath": "case when o_orderkey % 5 = 0 then '' when o_orderkey % 7 = 0 then null"
    " else '/data/' || cast(o_orderkey as string) || '.csv' end",
    "auto_monitor": "cast(case when o_orderstatus = 'P' then 0 else 1 end as int)",
}


def _uploads(spark, folder):
    return table(spark, folder, "orders").select(*[F.expr(e).alias(n) for n, e in _UPLOAD.items()])


_UPLOADS_SQL = "u as (select " + ", ".join(f"{e} as {n}" for n, e in _UPLOAD.items()) + " from orders)"


@query("catalog_upsert", f"""
with {_UPLOADS_SQL},
v as (select *, case when uploaded_at >= timestamp '1998-01-01' then 1 else 0 end as fresh from u),
r as (select *, row_number() over (partition by id order by fresh desc, uploaded_at desc, row_count desc) as n from v)
select id, strftime(uploaded_at, '%Y-%m-%d') as uploaded_at, row_count, filepath, auto_monitor from r where n = 1""")
def catalog_upsert(spark, folder):
    u = _uploads(spark, folder)
    old = catalog.latest_per_id(u.filter("uploaded_at < timestamp_ntz '1998-01-01'"), "id",
                                ["uploaded_at", "row_count"])
    new = u.filter("uploaded_at >= timestamp_ntz '1998-01-01'")
    out = catalog.upsert(old, new)
    return out.withColumn("uploaded_at", F.date_format("uploaded_at", "yyyy-MM-dd"))


@query("catalog_monitored", f"""
with {_UPLOADS_SQL}
select id, strftime(uploaded_at, '%Y-%m-%d') as uploaded_at, filepath from u
where auto_monitor = 1 and filepath is not null and filepath <> ''""")
def catalog_monitored(spark, folder):
    return catalog.monitored(_uploads(spark, folder)).select(
        "id", F.date_format("uploaded_at", "yyyy-MM-dd").alias("uploaded_at"), "filepath"
    )


@query("catalog_latest", f"""
with {_UPLOADS_SQL}
select id, strftime(uploaded_at, '%Y-%m-%d') as uploaded_at from u order by u.uploaded_at desc, id limit 1""")
def catalog_latest(spark, folder):
    return catalog.latest(_uploads(spark, folder)).select(
        "id", F.date_format("uploaded_at", "yyyy-MM-dd").alias("uploaded_at")
    )


@query("snapshot_replace", """
select c_custkey, c_name, c_acctbal from customer where c_acctbal > 0""")
def snapshot_replace(spark, folder):
    root = scratch_path(spark, "clean-records")
    df = table(spark, folder, "customer").select("c_custkey", "c_name", "c_acctbal")
    for version in (df, df.filter("c_acctbal > 0")):
        docs = records.to_documents(version, "customers", ["c_custkey"])
        records.replace_snapshot(docs, root, "customers")
    return records.from_documents(records.read_snapshot(spark, root, "customers"), df.schema)


@query("append_log", """
select event_type, count(*) as n, round(sum(value), 2) as total from events group by 1""")
def append_log(spark, folder):
    path = scratch_path(spark, "alert-log")
    df = table(spark, folder, "events").select("event_id", "event_type", "value")
    catalog.append(df.filter("event_type <> 'error'"), path)
    catalog.append(df.filter("event_type = 'error'"), path)
    log = catalog.read_log(spark, path, "event_id long, event_type string, value double")
    return rounded(log.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")), 2)


# The files of the folder that the tables are from, found by the rows of one of them.
_FILES = """
home as (select regexp_extract(file_name, '^(.*)/', 1) as dir
         from parquet_file_metadata('/root/testdata/sf*/lineitem.parquet')
         where num_rows = (select count(*) from lineitem)),
files as (select regexp_extract(filename, '([^/]+)$', 1) as file, size::bigint as length, last_modified, content
          from read_blob('/root/testdata/sf*/*.parquet')
          where regexp_extract(filename, '^(.*)/', 1) in (select dir from home))"""


def _name():
    return F.regexp_extract("path", "([^/]+)$", 1).alias("file")


@query("file_fingerprint", f"""
with {_FILES}
select file, sha256(content) as sha256, length, floor(epoch(last_modified))::bigint as mtime from files""")
def file_fingerprint(spark, folder):
    out = files.fingerprints(spark, f"{folder}/*.parquet")
    return out.select(_name(), "sha256", "length", F.floor("mtime").cast("long").alias("mtime"))


@query("file_fingerprint_tree", f"""
with {_FILES}
select file, case when length <= 10000 then sha256(content) else
         sha256(unhex(list_aggregate(list_transform(range(0, length, 10000), lambda i :
           sha256(unhex(substr(hex(content), 2 * i + 1, 20000)))), 'string_agg', ''))) end as sha256
from files where length <= 500000""")
def file_fingerprint_tree(spark, folder):
    """The same with ranges of 10,000 bytes, for files that plain SQL can cut."""
    small = files.file_times(spark, f"{folder}/*.parquet").filter("length <= 500000")
    return files.digests(small, 10_000).select(_name(), "sha256")


@query("file_change_detect", f"""
with {_FILES}
select file, length between 50000 and 499999 as changed, length < 500000 as opened from files""")
def file_change_detect(spark, folder):
    """Against a catalog in which small files have an older time, middling ones another
    hash, too, and large ones the time they have; so these are never opened, here or there."""
    now = files.file_times(spark, f"{folder}/*.parquet")
    small = files.digests(now.filter("length < 50000")).select("path", F.col("mtime") - 60, "sha256")
    middling = now.filter("length between 50000 and 499999").select("path", F.col("mtime") - 90, F.lit("stale"))
    large = now.filter("length >= 500000").select("path", "mtime", F.lit("not looked at"))
    known = small.union(middling).union(large).toDF("path", "mtime", "sha256")
    return files.check_files(spark, f"{folder}/*.parquet", known).select(_name(), "changed", "opened")


_SYNC = {
    "Order_ID": "o_orderkey",
    "Status": "case when o_orderkey % 7 = 0 then 'n/a' else o_orderstatus end",
    "Amount": "case when o_orderkey % 5 = 0 then null else o_totalprice end",
    "Discount": "case when o_orderkey % 3 = 0 then null else o_orderkey % 10 end",
}


@query("sync_job", f"""
with raw as (select {', '.join(f'{e} as "{n}"' for n, e in _SYNC.items())} from orders),
m as (select round(median("Amount"), 2) as m from raw)
select "Order_ID", case when "Status" = 'n/a' then 'Unknown' else "Status" end as "Status",
       round(coalesce("Amount", (select m from m)), 4) as "Amount",
       coalesce("Discount", 0)::integer as "Discount" from raw""")
def sync_job(spark, folder):
    path, root = scratch_path(spark, "watched"), scratch_path(spark, "clean-records")
    raw = table(spark, folder, "orders").select(*[F.expr(e).alias(n) for n, e in _SYNC.items()])
    # every row twice: the sync must not store duplicates
    files.write_csv(raw.unionAll(raw), path)
    done = sync.sync_dataset(spark, path, "orders", root)
    out = sync.load_dataset(spark, root, done)
    return rounded(out.withColumn("Order_ID", F.col("Order_ID").cast("long")))


@query("stream_kpi", REGISTRY["kpi_evaluate_all"].sql)
def stream_kpi(spark, folder):
    """Orders arrive in three triggers; each adds its days to what is kept, and KPIs are evaluated from that."""
    path, check, source = (scratch_path(spark, n) for n in ("kpis", "checkpoint", "orders"))
    orders = table(spark, folder, "orders")
    orders.repartition(3, F.xxhash64("o_orderkey")).write.parquet(source)
    stream = live.file_stream(spark, source, orders.schema, files_per_trigger=1)
    live.live_kpis(stream, definitions(spark, folder), path, check, "1998-06-15",
                   ["o_totalprice", "o_custkey", "o_orderpriority"], "o_orderdate", once=True).awaitTermination()
    return live.newest_snapshots(spark, path)


_AT = "1998-06-15 08:00:00"


@query("monitor_cycle", f"""
with ev as ({REGISTRY["kpi_evaluate_all"].sql}),
al as (select *, case status when 'CRITICAL' then 'CRITICAL' when 'AT RISK' then 'AT_RISK' else 'TARGET_EXCEEDED' end as alert_type,
              case status when 'CRITICAL' then 'CRITICAL' when 'AT RISK' then 'WARNING' else 'INFO' end as severity,
              list_filter(list_transform(string_split(recipients, ','), lambda x: trim(x)), lambda x: contains(x, '@')) as to_whom
       from ev where status in ('CRITICAL', 'AT RISK', 'EXCEEDED')),
cd as (select al.*, coalesce(s_suppkey % 40 <= 24, false) as suppressed
       from al left join supplier on kpi_id = 'kpi_' || s_suppkey and s_suppkey % 3 <> 0)
select kpi_id, alert_type, severity, suppressed, not suppressed and coalesce(len(to_whom) > 0, false) as notify,
       case when suppressed then 'Same alert within the last 24 hours'
            when not coalesce(len(to_whom) > 0, false) then 'No recipient' end as reason,
       case when len(to_whom) > 0 then array_to_string(to_whom, ',') end as send_to,
       (select count(*) from supplier where s_suppkey % 3 <> 0) * 3 + count(*) over () as log_rows
from cd""")
def monitor_cycle(spark, folder):
    """One cycle: evaluate all KPIs, derive alerts, hold them against the log, and add them to it.

    The log has an alert of each type for two KPIs of three, up to 39 hours old.
    """
    path = scratch_path(spark, "alert-log")
    kinds = F.expr("inline(array(struct('CRITICAL', 'CRITICAL'), struct('AT_RISK', 'WARNING'), struct('TARGET_EXCEEDED', 'INFO')))")
    old = table(spark, folder, "supplier").filter("s_suppkey % 3 <> 0").select(
        F.expr("'kpi_' || cast(s_suppkey as string)").alias("kpi_id"), kinds.alias("alert_type", "severity"),
        F.expr(f"timestamp '{_AT}' - make_interval(0, 0, 0, 0, cast(s_suppkey % 40 as int))").alias("triggered_at"),
    )
    catalog.append(old, path)
    schema = "kpi_id string, alert_type string, severity string, triggered_at timestamp"
    _, raised = sync.monitor_cycle(
        definitions(spark, folder), table(spark, folder, "orders"), catalog.read_log(spark, path, schema),
        "1998-06-15", _AT, ["o_totalprice", "o_custkey", "o_orderpriority"], "o_orderdate",
    )
    raised = staged(raised)
    catalog.append(raised.select("kpi_id", "alert_type", "severity", "triggered_at"), path)
    return raised.select("kpi_id", "alert_type", "severity", "suppressed", "notify", "reason", "send_to").withColumn(
        "log_rows", catalog.read_log(spark, path, schema).agg(F.count("*")).scalar()
    )


@query("stream_tumbling", """
select strftime(date_trunc('day', ts), '%Y-%m-%d') as day, event_type, round(sum(value), 2) as total,
       count(*) as n_rows from events group by all""")
def stream_tumbling(spark, folder):
    """Events arrive in order of time, in three triggers; a window that two of them change is replaced."""
    path, check, source = (scratch_path(spark, n) for n in ("windows", "checkpoint", "events"))
    events = table(spark, folder, "events")
    third, two = events.approxQuantile("event_id", [1 / 3, 2 / 3], 0.01)
    for part in (F.col("event_id") <= third, (F.col("event_id") > third) & (F.col("event_id") <= two), F.col("event_id") > two):
        events.filter(part).coalesce(1).write.mode("append").parquet(source)
    stream = live.file_stream(spark, source, events.schema, files_per_trigger=1)
    live.upsert_windows(live.window_totals(stream, "ts", "value", ["event_type"]), path, check, once=True).awaitTermination()
    out = live.newest_windows(spark, path, ["event_type"])
    return rounded(out.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type",
                              "total", "n_rows"), 2)


@query("stream_sessions", """
with c as (select *, coalesce(ts - lag(ts) over (partition by user_id order by ts, event_id) <= interval '24 hour', false) as near
           from events),
n as (select *, sum(case when near then 0 else 1 end) over (partition by user_id order by ts, event_id rows unbounded preceding) as sid from c)
select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as first_at, strftime(max(ts), '%Y-%m-%d %H:%M:%S') as last_at,
       count(*) as n_alerts, max(ts) + interval '24 hour' < (select max(ts) - interval '1 hour' from events) as closed
from n group by user_id, sid""")
def stream_sessions(spark, folder):
    """The events arrive shuffled, in three triggers; runs that can still grow are reported as open."""
    path, check, source = (scratch_path(spark, n) for n in ("sessions", "checkpoint", "events"))
    events = table(spark, folder, "events")
    events.repartition(3, F.xxhash64("event_id")).write.parquet(source)
    stream = live.file_stream(spark, source, events.schema, files_per_trigger=1)
    live.live_sessions(stream, ["user_id"], path, check, "ts", once=True).awaitTermination()
    out = live.session_report(spark, path, ["user_id"])
    for c in ("first_at", "last_at"):
        out = out.withColumn(c, F.date_format(c, "yyyy-MM-dd HH:mm:ss"))
    return out


@query("stream_cooldown", """
select event_id as id, coalesce(ts - lag(ts) over (partition by user_id, event_type order by ts, event_id)
       <= interval '24 hour', false) as suppressed from events""")
def stream_cooldown(spark, folder):
    path, check, source = (scratch_path(spark, n) for n in ("cooldown", "checkpoint", "alerts"))
    events = table(spark, folder, "events")
    # the alerts arrive shuffled, in several files and triggers
    events.repartition(4, F.xxhash64("event_id")).write.parquet(source)
    stream = live.file_stream(spark, source, events.schema, files_per_trigger=1)
    log = stream.withColumnRenamed("event_id", "id")
    live.live_cooldown(log, ["user_id", "event_type"], path, check, "ts", once=True).awaitTermination()
    return live.cooldown_verdicts(spark, path)
