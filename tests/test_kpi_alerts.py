import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import alerts, kpi

FIELDS = "id string, kpi_name string, metric_column string, calculation string, target_value double, start_date string, end_date string, recipients string"


def kpis(spark, *rows):
    full = [(f"k{i}", f"K{i}", *r, *([None] * (5 - len(r))), "a@x.org") for i, r in enumerate(rows)]
    return spark.createDataFrame(full, FIELDS)


def run(spark, defs, df, as_of="2026-09-16", **kw):
    return {r["kpi_id"]: r for r in kpi.evaluate(defs, df, as_of, **kw).collect()}


def test_variance(spark):
    df = spark.createDataFrame([(v,) for v in (100.0, 200.0, 300.0, 400.0)], "Sales double")
    r = run(spark, kpis(spark, ("Sales", "SUM", 1200.0)), df)["k0"]
    assert (r["actual_value"], r["variance"], r["achievement_pct"]) == (1000.0, -200.0, 83.33)


def test_elapsed_time(spark):
    df = spark.createDataFrame([(300000.0,)], "Sales double")
    r = run(spark, kpis(spark, ("Sales", "SUM", 1e6, "2026-09-01", "2026-09-30")), df)["k0"]
    assert (r["achievement_pct"], r["expected_progress_pct"], r["status"]) == (30.0, 51.72, "CRITICAL")
    assert r["performance_gap"] < -20


@pytest.mark.parametrize("value,status", [(1500.0, "EXCEEDED"), (950.0, "ON TRACK"), (750.0, "AT RISK"), (500.0, "CRITICAL")])
def test_status(spark, value, status):
    df = spark.createDataFrame([(value,)], "Sales double")
    assert run(spark, kpis(spark, ("Sales", "SUM", 1000.0)), df)["k0"]["status"] == status


def test_future_window(spark):
    d = dt.date
    rows = [(d(2026, 12, 10), 5000.0), (d(2026, 12, 20), 5000.0)]
    defs = kpis(spark, ("Revenue", "SUM", 20000.0, "2027-01-01", "2027-01-31"))
    df = spark.createDataFrame(rows, "Order_Date date, Revenue double")
    assert run(spark, defs, df)["k0"]["actual_value"] == 0.0
    more = spark.createDataFrame(rows + [(d(2027, 1, 5), 12000.0), (d(2027, 1, 15), 8000.0)], df.schema)
    r = run(spark, defs, more)["k0"]
    assert (r["actual_value"], r["achievement_pct"], r["status"]) == (20000.0, 100.0, "EXCEEDED")


def test_all_calculations_against_one_by_one(spark):
    rng = random.Random(5)
    rows = [(dt.date(2026, 9, rng.randint(1, 30)) if rng.random() > 0.1 else None,
             rng.choice([None, 1.0, 2.5, 7.0, 9.0]), rng.choice(["4", "x", None, "6"])) for _ in range(300)]
    df = spark.createDataFrame(rows, "Order_Date date, v double, t string").repartition(5)
    calcs = ["SUM", "average", "MEAN", "COUNT", "MIN", "MAX", "MEDIAN", "RATE", "PERCENTAGE", "odd"]
    windows = [(None, None), ("2026-09-05", "2026-09-20"), ("2026-09-05", None), (None, "2026-09-03"), ("bad", None)]
    specs = [(m, c, 10.0, s, e) for m in ("v", "t") for c in calcs for s, e in windows]
    got = run(spark, kpis(spark, *specs), df, metrics=["v", "t"])
    import numpy as np

    for i, (m, c, _, s, e) in enumerate(specs):
        lo = dt.date.fromisoformat(s) if s and s != "bad" else None
        hi = dt.date.fromisoformat(e) if e else None
        keep = [r for r in rows if (not lo or (r[0] and r[0] >= lo)) and (not hi or (r[0] and r[0] <= hi))]
        raw = [r[1 if m == "v" else 2] for r in keep]
        if m == "v":
            nums = [x for x in raw if x is not None]
        else:
            nums = [float(x) if x and x.isdigit() else 0.0 for x in raw]
        f = {"SUM": sum, "COUNT": None, "MIN": min, "MAX": max, "MEDIAN": np.median}.get(c.upper())
        if c == "COUNT":
            want = len([x for x in raw if x is not None])
        elif c == "odd":
            want = sum(nums)
        else:
            want = (f or np.mean)(nums)
        assert got[f"k{i}"]["actual_value"] == pytest.approx(round(float(want), 2), abs=0.011), specs[i]


def test_absent_metric_is_an_error_row(spark):
    df = spark.createDataFrame([(100.0, 5.0), (400.0, 15.0)], "Sales double, Units double")
    got = run(spark, kpis(spark, ("Sales", "SUM", 500.0), ("Units", "SUM", 20.0), ("Nope", "SUM", 1.0)), df)
    assert [got[k]["status"] for k in ("k0", "k1", "k2")] == ["EXCEEDED", "EXCEEDED", "ERROR"]


def log(spark, stamps, key="k"):
    rows = [(str(i), key, "CRITICAL", "CRITICAL", t) for i, t in enumerate(stamps)]
    return spark.createDataFrame(rows, "id string, kpi_id string, alert_type string, severity string, triggered_at timestamp")


def test_cooldown_boundary(spark):
    t, out = dt.datetime(2026, 1, 1), []
    for gap in (0, 24 * 3600 - 1, 24 * 3600, 24 * 3600 + 1):
        t += dt.timedelta(seconds=gap)
        out.append(t)
    got = [r["suppressed"] for r in alerts.cooldown(log(spark, out)).orderBy("triggered_at").collect()]
    assert got == [False, True, True, False]
    again = alerts.cooldown(log(spark, [out[0], out[0]])).orderBy("id").collect()
    assert [r["suppressed"] for r in again] == [False, True]


def test_cooldown_and_sessions_against_a_loop(spark):
    rng = random.Random(9)
    t, stamps = dt.datetime(2026, 1, 1), []
    for _ in range(400):
        t += dt.timedelta(minutes=rng.choice([0, 1, 30, 600, 1441, 3000]))
        stamps.append(t)
    want = [i == 0 or b - a > dt.timedelta(hours=24) for i, (a, b) in enumerate(zip([stamps[0], *stamps], stamps))]
    df = log(spark, stamps).repartition(6)
    got = sorted(alerts.cooldown(df).collect(), key=lambda r: int(r["id"]))
    assert [not r["suppressed"] for r in got] == want
    runs = alerts.sessions(df).collect()
    assert len(runs) == sum(want) and sum(r["n_alerts"] for r in runs) == 400


def test_no_task_sees_a_whole_key(spark):
    """All alerts of one key: the ordering windows work per key and hour."""
    stamps = [dt.datetime(2026, 1, 1) + dt.timedelta(minutes=i) for i in range(6000)]
    plan = alerts.cooldown(log(spark, stamps))._jdf.queryExecution().optimizedPlan().toString()
    lines = [x for x in plan.splitlines() if "Window [lag(triggered_at" in x]
    assert lines and all("_hour" in x for x in lines)


def test_new_alerts_against_the_log(spark):
    old = log(spark, [dt.datetime(2026, 1, 1, 10)])
    new = log(spark, [dt.datetime(2026, 1, 2, 9)])
    assert alerts.cooldown_against(new, old).first()["suppressed"]
    assert not alerts.cooldown_against(new, old, 5).first()["suppressed"]


def test_messages_and_rules(spark):
    rows = [("k", "Profit", "CRITICAL", 10000.0, 100000.0, 10.0, -41.66), ("k", "Profit", "ON TRACK", 1.0, 1.0, 99.0, 0.0),
            ("k", "Profit", "EXCEEDED", 1234567.891, 1000.0, 123.45, 3.0), ("k", "Profit", "AT RISK", 7.0, 10.0, 70.0, -9.95)]
    df = spark.createDataFrame(rows, "kpi_id string, kpi_name string, status string, actual_value double, target_value double, achievement_pct double, performance_gap double")
    got = {r["alert_type"]: (r["severity"], r["message"]) for r in alerts.alerts_from(df).collect()}
    assert set(got) == {"CRITICAL", "TARGET_EXCEEDED", "AT_RISK"}
    assert got["CRITICAL"] == ("CRITICAL", "Far behind plan, Profit: 10.0% done (10,000.00 / 100,000.00), -41.7% to plan")
    assert "1,234,567.89 / 1,000.00" in got["TARGET_EXCEEDED"][1]
    assert got["AT_RISK"][0] == "WARNING"


def test_latest_snapshot_and_counts(spark):
    t = dt.datetime
    snaps = spark.createDataFrame([("1", "a", t(2026, 1, 1), "CRITICAL"), ("2", "a", t(2026, 1, 2), "ON TRACK"), ("3", "b", t(2026, 1, 1), "EXCEEDED")],
                                  "id string, kpi_id string, snapshot_time timestamp, status string")
    for c in ("actual_value", "achievement_pct", "expected_progress_pct", "actual_progress_pct", "performance_gap"):
        snaps = snaps.withColumn(c, F.lit(1.0))
    defs = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    row = kpi.dashboard_counts(kpi.with_latest(defs, snaps)).first()
    assert (row["total_kpis"], row["on_track"], row["critical"], row["exceeded"], row["unmonitored"]) == (3, 1, 0, 1, 1)


def test_windows_of_many_kpis_meet_no_days(spark):
    """10,000 days and 100,000 windows: a few look-ups each, not a billion pairs."""
    import numpy as np

    days, many, rng = 10_000, 100_000, np.random.default_rng(3)
    value = rng.integers(0, 1000, days).astype(float)
    value[7] = 1e15  # a large day elsewhere costs no digits
    first = dt.date(1990, 1, 1)
    facts = spark.createDataFrame([(first + dt.timedelta(days=i), float(v)) for i, v in enumerate(value)], "day date, v double")
    ends = np.sort(rng.integers(0, days, (many, 2)), axis=1)
    ends[: many // 3] = (0, days - 1)  # a third of all KPIs have one window
    start = F.lit(first)
    pairs = spark.createDataFrame([(i, int(a), int(b)) for i, (a, b) in enumerate(ends)], "n long, a int, b int")
    how = F.element_at(F.array(*map(F.lit, ["SUM", "MIN", "MAX", "COUNT", "AVERAGE"])), (F.col("n") % 5 + 1).cast("int"))
    defs = pairs.select(
        F.col("n").cast("string").alias("id"), F.lit("v").alias("metric_column"), how.alias("calculation"),
        F.date_add(start, "a").cast("string").alias("start_date"), F.date_add(start, "b").cast("string").alias("end_date"),
    )
    got = {int(r[0]): r[1] for r in kpi.actuals(defs, facts, ["v"], "day").collect()}
    assert len(got) == many
    for i in range(0, many, 7):
        a, b = ends[i]
        part = value[a : b + 1]
        want = [lambda: part.sum(), part.min, part.max, lambda: float(len(part)), part.mean][i % 5]()
        assert got[i] == pytest.approx(float(want), rel=1e-12, abs=0.0051), (i, a, b)


def test_medians_of_many_windows(spark, monkeypatch):
    from tallyframe.operators import day_windows

    rng = random.Random(11)
    first = dt.date(2020, 1, 1)
    rows = [(None if rng.random() < 0.05 else first + dt.timedelta(days=rng.randint(0, 99)),
             rng.choice([1.0, 1.0, rng.random(), -rng.random(), None]), float(rng.randint(0, 9))) for _ in range(3000)]
    facts = spark.createDataFrame(rows, "day date, v double, w double").repartition(3)
    windows = [(m, *sorted((rng.randint(-3, 103), rng.randint(-3, 103)))) for m in ("v", "w") for _ in range(40)]
    defs = [(f"k{i}", m, "median", str(first + dt.timedelta(days=a)), str(first + dt.timedelta(days=b))) for i, (m, a, b) in enumerate(windows)]
    defs += [("all", "v", "median", None, None), ("from", "v", "MEDIAN", "2020-02-01", None), ("none", "v", "MEDIAN", "2030-01-01", "2030-02-01"),
             ("back", "v", "MEDIAN", "2020-02-01", "2020-01-01")]
    kpis_ = spark.createDataFrame(defs, "id string, metric_column string, calculation string, start_date string, end_date string")
    for bits in (2, 8):
        monkeypatch.setattr(day_windows, "BITS", bits)
        got = {r[0]: r[1] for r in kpi.actuals(kpis_, facts, ["v", "w"], "day").collect()}
        for i, m, _, s, e in defs:
            low, high = (dt.date.fromisoformat(x) if x else None for x in (s, e))
            col = 1 if m == "v" else 2
            part = sorted(r[col] for r in rows if r[col] is not None and (not low or (r[0] and r[0] >= low)) and (not high or (r[0] and r[0] <= high)))
            n = len(part)
            want = (part[(n - 1) // 2] + part[n // 2]) / 2 if part else 0.0
            assert got[i] == pytest.approx(want, abs=0.0051), i


def test_no_join_on_the_metric_alone(spark):
    """Windows and days meet by equal keys that include the day or its block."""
    facts = spark.createDataFrame([(dt.date(2020, 1, 1), 1.0)], "day date, v double")
    plan = kpi.actuals(kpis(spark, ("v", "SUM", 1.0)), facts, ["v"], "day")._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert joins and all(line.count(" = ") + line.count("<=>") >= 2 for line in joins)
