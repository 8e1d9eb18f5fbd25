import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import alerts
from tallyframe.session import scratch_path
from tallyframe.sources import catalog, files, records
from tallyframe.streaming import live, sync


def write(path, text):
    with open(path, "w") as f:
        f.write(text)


def touch(path, seconds):
    s = os.stat(path)
    os.utime(path, (s.st_atime, s.st_mtime + seconds))


def datasets(spark, path):
    r = files.fingerprints(spark, str(path)).first()
    row = ("d1", "n", "f", dt.datetime(2026, 1, 1), 0, 0, 0.0, "{}", "{}", r["path"], r["sha256"], r["mtime"], 1)
    return spark.createDataFrame([row], catalog.DATASETS)


def test_unchanged_touched_and_edited(spark, tmp_path):
    p = tmp_path / "x.csv"
    write(p, "X\n1\n2\n3\n")
    known = datasets(spark, p)
    root = scratch_path(spark, "records")
    assert sync.sync_changed(spark, known, root)[0] == []
    touch(p, 60)
    assert sync.sync_changed(spark, known, root)[0] == []
    write(p, "X\n1\n2\n9\n")
    touch(p, 120)
    done, after = sync.sync_changed(spark, known, root)
    assert [d.row_count for d in done] == [3]
    assert after.first()["row_count"] == 3 and after.first()["file_hash"] != known.first()["file_hash"]
    assert sync.sync_changed(spark, after, root)[0] == []


def test_append_and_edit_and_duplicates(spark, tmp_path):
    p = tmp_path / "orders.csv"
    root = scratch_path(spark, "records")
    write(p, " ID , Metric\n1,100\n2,200\n")
    first = sync.sync_dataset(spark, str(p), "d", root)
    df = sync.load_dataset(spark, root, first)
    assert df.columns == ["ID", "Metric"] and df.agg(F.sum("Metric")).first()[0] == 300
    write(p, "ID,Metric\n1,500\n2,500\n3,7\n3,7\n3,7\n")
    again = sync.sync_dataset(spark, str(p), "d", root)
    assert again.row_count == 3
    assert sync.load_dataset(spark, root, again).agg(F.sum("Metric")).first()[0] == 1007


def test_json_round_trip_is_exact(spark):
    rows = [(1, 1.5, dt.datetime(2026, 1, 1, 1, 2, 3, 456789), dt.date(2026, 1, 2), None, 'a"b\n'), (2, None, None, None, True, "é")]
    df = spark.createDataFrame(rows, "ID long, Val double, at timestamp, d date, b boolean, s string")
    docs = records.to_documents(df, "x", ["ID"])
    assert [r["row_index"] for r in docs.orderBy("row_index").collect()] == [0, 1]
    assert sorted(records.from_documents(docs, df.schema).collect()) == sorted(df.collect())


def test_empty_snapshot_clears_the_dataset(spark):
    root = scratch_path(spark, "records")
    df = spark.range(3).toDF("ID")
    records.replace_snapshot(records.to_documents(df, "a", ["ID"]), root, "a")
    records.replace_snapshot(records.to_documents(df, "b", ["ID"]), root, "b")
    records.replace_snapshot(records.to_documents(df.filter("false"), "a", ["ID"]), root, "a")
    assert records.read_snapshot(spark, root, "a").count() == 0
    assert records.read_snapshot(spark, root, "b").count() == 3


def test_upsert(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int")
    new = spark.createDataFrame([("b", 1), ("c", 5)], "id string, v int")
    assert sorted(map(tuple, catalog.upsert(old, new).collect())) == [("a", 1), ("b", 1), ("c", 5)]


def test_monitor_cycle(spark):
    facts = spark.createDataFrame([(50000.0,), (-40000.0,)], "Profit double")
    defs = spark.createDataFrame([("k", "K", "Profit", "SUM", 100000.0, None, None, "a@x.org")],
                                 "id string, kpi_name string, metric_column string, calculation string, target_value double, start_date string, end_date string, recipients string")
    snaps, first = sync.monitor_cycle(defs, facts, None, "2026-01-01", "2026-01-01 10:00:00")
    row = first.first()
    assert (snaps.first()["actual_value"], row["severity"], row["notify"]) == (10000.0, "CRITICAL", True)
    _, second = sync.monitor_cycle(defs, facts, first, "2026-01-01", "2026-01-02 09:00:00")
    assert (second.first()["suppressed"], second.first()["notify"]) == (True, False)


def test_stream_in_many_triggers_equals_batch(spark, folder):
    events = spark.read.parquet(f"{folder}/events.parquet")
    source = scratch_path(spark, "events")
    for i in range(4):
        events.filter(F.col("event_id") % 4 == i).coalesce(1).write.mode("append").parquet(source)
    stream = live.file_stream(spark, source, events.schema, files_per_trigger=1)
    out = scratch_path(spark, "out")
    live.run_to_end(live.window_totals(stream, "ts", "value", ["event_type"]), out, scratch_path(spark, "cp"), "complete")
    key = lambda df: sorted((r["window_start"], r["event_type"], round(r["total"], 4), r["n_rows"]) for r in df.collect())
    assert key(spark.read.parquet(out)) == key(live.window_totals(events, "ts", "value", ["event_type"]))


def test_live_kpis_from_batches_alone(spark, monkeypatch):
    """Seven batches, merged after each two, one of them repeated; late days and medians included."""
    from tallyframe.operators import kpi

    monkeypatch.setattr(live, "COMPACT", 2)
    first = dt.date(2026, 1, 1)
    rows = [(i, None if i % 11 == 0 else first + dt.timedelta(days=i * 7 % 30), float(i * 37 % 101), "4" if i % 3 else "x") for i in range(300)]
    facts = spark.createDataFrame(rows, "i long, day date, v double, t string")
    defs = spark.createDataFrame(
        [(f"{m}{h}{s}", m, m, h, 100.0, s, e, "") for m in ("v", "t", "gone") for h in ("SUM", "MEDIAN", "MIN", "COUNT", "RATE")
         for s, e in ((None, None), ("2026-01-05", "2026-01-20"), (None, "2026-01-09"))],
        "id string, kpi_name string, metric_column string, calculation string, target_value double, start_date string, end_date string, recipients string")
    folder = scratch_path(spark, "kpis")
    states = live.DayStates(folder, ["v", "t"], ["v", "t"], "day")
    for batch in (0, 1, 2, 3, 3, 4, 5, 6, 6):
        states.add(facts.filter(F.col("i") % 7 == batch), batch)
    key = lambda df: sorted(map(tuple, df.collect()))
    want = key(kpi.evaluate(defs, facts, "2026-01-15", ["v", "t"], "day"))
    assert key(kpi.evaluate_days(defs, *states.upto(spark, 6), "2026-01-15", ["v", "t"])) == want


def _alert_files(spark, hours, order):
    """One file per alert, written in the given order."""
    source = scratch_path(spark, "alerts")
    base = dt.datetime(2026, 1, 1)
    schema = "id long, kpi_id string, alert_type string, severity string, triggered_at timestamp"
    for i in order:
        row = [(i, "k", "CRITICAL", "CRITICAL", base + dt.timedelta(hours=hours[i]))]
        spark.createDataFrame(row, schema).coalesce(1).write.mode("append").parquet(source)
    return live.file_stream(spark, source, spark.read.parquet(source).schema, files_per_trigger=1)


@pytest.mark.parametrize("order", [(0, 1, 2, 3), (3, 2, 1, 0), (2, 0, 3, 1)])
def test_live_cooldown_in_any_order(spark, order):
    stream, out = _alert_files(spark, (0, 20, 40, 70), order), scratch_path(spark, "out")
    live.live_cooldown(stream, alerts.ALERT_KEY, out, scratch_path(spark, "cp"), once=True).awaitTermination()
    got = [r["suppressed"] for r in live.cooldown_verdicts(spark, out).orderBy("id").collect()]
    assert got == [False, True, True, False]


def test_live_log_lies_by_day(spark):
    """Only the wanted days are opened; a repeated batch writes the same place again."""
    stream, out = _alert_files(spark, (0, 20, 40, 70), (0, 1, 2, 3)), scratch_path(spark, "out")
    live.live_cooldown(stream, alerts.ALERT_KEY, out, scratch_path(spark, "cp"), once=True).awaitTermination()
    schema = spark.read.parquet(f"{out}/log").schema
    first = (dt.date(2026, 1, 1) - dt.date(1970, 1, 1)).days
    assert sorted(r["id"] for r in live.log_days(spark, out, schema, [first]).collect()) == [0, 1]
    files = live.log_days(spark, out, schema, [first + 1, first + 2, first + 9]).inputFiles()
    assert len(files) == 2 and not any(f"day={first}/" in f for f in files)


def test_sessions_report_open_runs(spark, monkeypatch):
    """Batches in any order, one of them repeated, some empty; merged after each two."""
    monkeypatch.setattr(live, "COMPACT", 2)
    base = dt.datetime(2026, 1, 1)
    stamps = [(i, i % 3, base + dt.timedelta(hours=i * 31 % 400, seconds=i)) for i in range(90)] + [(90, 0, None)]
    log = spark.createDataFrame(stamps, "id long, k int, triggered_at timestamp")
    folder = scratch_path(spark, "runs")
    for batch in (0, 1, 2, 3, 3, 4, 5, 5):
        live.keep_hours(log.filter(F.col("id") % 5 == (4 - batch) % 7), batch, ["k"], folder)
    got = sorted(tuple(r) for r in live.session_report(spark, folder, ["k"], 5).collect())
    last = max(t for _, _, t in stamps if t)
    want = [(*r, r["last_at"] + dt.timedelta(hours=5) < last - dt.timedelta(hours=1))
            for r in alerts.sessions(log.filter("triggered_at is not null"), 5, ["k"]).collect()]
    assert got == sorted(want)
    assert any(not r[-1] for r in got) and any(r[-1] for r in got)


def test_closed_sessions_of_a_watermark(spark):
    stream, out = _alert_files(spark, (0, 20, 70, 71, 200), range(5)), scratch_path(spark, "out")
    live.run_to_end(live.alert_sessions(stream, alerts.ALERT_KEY), out, scratch_path(spark, "cp"))
    assert sorted(r["n_alerts"] for r in spark.read.parquet(out).collect()) == [2, 2]


def test_fixed_cooldown(spark):
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream, out = _alert_files(spark, (0, 20, 40, 70), range(4)), scratch_path(spark, "out")
        live.run_to_end(live.fixed_cooldown(stream, alerts.ALERT_KEY), out, scratch_path(spark, "cp"))
        assert [r["suppressed"] for r in spark.read.parquet(out).orderBy("id").collect()] == [False, True, False, False]
    finally:
        spark.conf.set(provider, before)



def test_tree_digest_of_ranges(spark, tmp_path):
    """Files of one and of many ranges, odd names included; Spark lists no empty file."""
    import hashlib

    data = {"empty": b"", "one": b"x" * 10, "edge": b"y" * 1000, "more": bytes(range(256)) * 13, "a b é%20.csv": b"z" * 2501}
    for name, content in data.items():
        (tmp_path / name).write_bytes(content)
    times = files.file_times(spark, str(tmp_path))
    got = {os.path.basename(r["path"]): r["sha256"] for r in files.digests(times, 1000).collect()}

    def want(content):
        parts = [hashlib.sha256(content[i : i + 1000]).digest() for i in range(0, max(len(content), 1), 1000)]
        return parts[0].hex() if len(parts) == 1 else hashlib.sha256(b"".join(parts)).hexdigest()

    assert got == {n: want(c) for n, c in data.items() if c}


def test_file_of_over_two_gigabytes(spark, tmp_path):
    import hashlib

    with open(tmp_path / "huge", "wb") as f:
        f.truncate((2 << 30) + 5)
        f.seek((2 << 30) + 4)
        f.write(b"!")
    row = files.fingerprints(spark, str(tmp_path)).first()
    blank = hashlib.sha256(bytes(files.RANGE)).digest()
    last = hashlib.sha256(bytes(4) + b"!").digest()
    assert row["length"] == (2 << 30) + 5
    assert row["sha256"] == hashlib.sha256(blank * ((2 << 30) // files.RANGE) + last).hexdigest()


def test_unmoved_files_are_not_opened(spark, tmp_path):
    for name in ("same", "touched", "edited"):
        write(tmp_path / name, name)
    known = spark.createDataFrame(files.fingerprints(spark, str(tmp_path)).drop("length").collect())
    # a hash that no content has: only a file that is opened can differ from it
    known = known.withColumn("sha256", F.when(F.col("path").endswith("same"), F.lit("never")).otherwise(F.col("sha256")))
    touch(tmp_path / "touched", 60)
    write(tmp_path / "edited", "other")
    touch(tmp_path / "edited", 60)
    got = {os.path.basename(r["path"]): (r["changed"], r["opened"]) for r in files.check_files(spark, str(tmp_path), known).collect()}
    assert got == {"same": (False, False), "touched": (False, True), "edited": (True, True)}
    plan = files.check_files(spark, str(tmp_path), known)._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan


def test_a_job_that_dies_before_the_switch_leaves_the_old_rows(spark, monkeypatch):
    root = scratch_path(spark, "records")
    rows = lambda n: records.to_documents(spark.range(n).toDF("ID"), "d", ["ID"])
    assert records.read_snapshot(spark, root, "d").count() == 0
    records.replace_snapshot(rows(3), root, "d")
    pinned = records.read_snapshot(spark, root, "d")

    def dies(*_):
        raise RuntimeError("killed")

    with monkeypatch.context() as m:
        m.setattr(records, "_commit", dies)
        with pytest.raises(RuntimeError):
            records.replace_snapshot(rows(5), root, "d")
    assert records.read_snapshot(spark, root, "d").count() == 3
    records.replace_snapshot(rows(7), root, "d")
    assert (pinned.count(), records.read_snapshot(spark, root, "d").count()) == (3, 7)
    kept = [records.replace_snapshot(rows(n), root, "d") for n in (1, 2, 4)]
    assert [os.path.isdir(p) for p in kept] == [False, True, True]
    assert records.read_snapshot(spark, root, "d").count() == 4


def test_closed_windows_leave_the_state(spark, folder):
    events = spark.read.parquet(f"{folder}/events.parquet")
    source, out, check = (scratch_path(spark, n) for n in ("events", "out", "cp"))
    cuts = [events.agg(F.expr(f"percentile(event_id, {p})")).first()[0] for p in (0.0, 0.3, 0.6, 1.0)]
    for low, high in zip(cuts, cuts[1:]):
        part = events.filter((F.col("event_id") > low - (low == cuts[0])) & (F.col("event_id") <= high))
        part.coalesce(1).write.mode("append").parquet(source)
    stream = live.file_stream(spark, source, events.schema, files_per_trigger=1)
    query = live.upsert_windows(live.window_totals(stream, "ts", "value", ["event_type"]), out, check, once=True)
    query.awaitTermination()
    key = lambda df: sorted((r["window_start"], r["event_type"], round(r["total"], 4), r["n_rows"]) for r in df.collect())
    want = key(live.window_totals(events, "ts", "value", ["event_type"]))
    assert key(live.newest_windows(spark, out, ["event_type"])) == want
    held = query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"]
    assert 0 < held < len(want) / 2
