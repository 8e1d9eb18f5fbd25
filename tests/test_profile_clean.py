import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyframe.functions import columns as fn
from tallyframe.operators import clean, profile


def roles_of(df):
    return {c.column: c.role for c in profile.profile(df).columns}


def test_sparse_business_table(spark):
    df = spark.createDataFrame(
        [("C1", dt.date(2024, 1, 1), "Pen", 3, 9.5), ("C2", dt.date(2024, 1, 2), "Cup", 1, 4.0),
         ("C3", dt.date(2024, 1, 3), "Pen", 2, 6.0)],
        "Customer_ID string, Order_Date date, Product string, Quantity long, Sales double")
    assert roles_of(df) == {"Customer_ID": "identifier", "Order_Date": "date", "Product": "categorical",
                            "Quantity": "numeric", "Sales": "numeric"}


def test_identifiers(spark):
    names = ["Customer_ID", "OrderID", "Employee_ID", "Student_Id", "TransactionID"]
    df = spark.createDataFrame([(1, 2, 3, 4, 5, 10.0), (6, 7, 8, 9, 10, 20.0)],
                               ", ".join(f"{n} long" for n in names) + ", Sales double")
    info = profile.profile(df)
    assert info.identifiers == names and info.numerics == ["Sales"]


def test_other_roles(spark):
    df = spark.createDataFrame(
        [(1, "Yes", "2024-01-01", 5.0, 0.5, None, i) for i in range(3)] +
        [(0, "No", "2024/02/01", 6.0, 0.7, None, 9)],
        "flag int, answer string, created string, target_sales double, margin double, empty string, ref_index long")
    assert roles_of(df) == {"flag": "boolean", "answer": "boolean", "created": "date",
                            "target_sales": "target", "margin": "kpi", "empty": "boolean",
                            "ref_index": "identifier"}
    assert profile.profile(df).numerics == ["target_sales", "margin"]


def test_sensor_table(spark):
    t = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([("d1", t, "temp", 1.5, "ok"), ("d2", t, "temp", 2.5, "ok"), ("d3", t, "hum", 3.5, "bad")],
                               "Device_ID string, Timestamp timestamp, Sensor_Type string, Reading double, Status string")
    r = roles_of(df)
    assert (r["Device_ID"], r["Reading"], r["Sensor_Type"], r["Timestamp"]) == ("identifier", "numeric", "categorical", "date")


def test_wide_table_matches_narrow_statistics(spark):
    narrow = spark.range(200).selectExpr("cast(id % 2 as decimal(10,2)) as flag", "id as n", "'x' as only")
    wide = narrow.selectExpr("*", *[f"n * {i} as c{i}" for i in range(1, 60)])
    few = {r["column"]: r.asDict() for r in profile.column_stats(narrow).collect()}
    many = {r["column"]: r.asDict() for r in profile.column_stats(wide).collect()}
    assert len(many) == 62 and all(many[c] == few[c] for c in few)
    roles = [{c.column: c.role for c in profile.profile(df).columns} for df in (narrow, wide)]
    assert roles[0]["flag"] == roles[1]["flag"] == "boolean"


def test_exact_distinct_of_all_kinds(spark, monkeypatch):
    nan, n = float("nan"), 5000
    rows = [(i % 7, i * 3, float(i % 1900) / 3 if i % 5 else None, [nan, 0.0, -0.0, 1.5][i % 4], None, i % 2 == 0,
             f"x{i % 11}" if i % 3 else None, dt.date(2024, 1, 1 + i % 28)) for i in range(n)]
    names = ["few", "it's `many`", "third", "zeros", "none", "flag", "text", "day"]
    kinds = ["short", "long", "double", "float", "int", "boolean", "string", "date"]
    df = spark.createDataFrame(rows, ", ".join(f"c{i} {k}" for i, k in enumerate(kinds))).toDF(*names).repartition(5)
    want = {c: len({str(r[i]) for r in rows if r[i] is not None and r[i] == r[i]}) for i, c in enumerate(names)}
    assert want["zeros"] == 3 and want["none"] == 0
    whole = profile.column_stats(df.toDF(*[c.replace("`", "") for c in names]), distinct="exact").collect()
    assert {r["column"]: r["n_distinct"] for r in whole} == {c.replace("`", ""): k for c, k in want.items()}
    # values that are sent on many times, in many rows, are counted once
    monkeypatch.setattr(profile, "HELD", 4096)
    monkeypatch.setattr(profile, "ROW_VALUES", 3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        got = profile.exact_distinct(df, names).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r["column"]: r["n_distinct"] for r in got} == {c: k for c, k in want.items() if k}
    assert profile.exact_distinct(df.limit(0), names).collect() == []


def test_numbers_in_one_pass_equal_aggregates(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, 0, 5.0, nan, None, -inf, 1.0), (None, 1, 5.0, -0.0, None, 2.0, nan), (-3, 0, None, 0.0, None, nan, 1.0)]
    kinds = "sales_a long, flag byte, cost_b double, price float, age int, count_c double, one double"
    for data in (rows * 9, rows[:1], []):
        df = spark.createDataFrame(data, kinds).repartition(4)
        exact, plain = ({r["column"]: r.asDict() for r in profile.column_stats(df, distinct=d).collect()} for d in ("exact", "none"))
        assert all(r.pop("n_distinct") is not None for r in exact.values())
        assert exact == {c: {k: v for k, v in r.items() if k != "n_distinct"} for c, r in plain.items()}


def test_numbers_travel_packed(spark):
    df = spark.range(1000).selectExpr("id", *[f"id * {i} * 1e0 as c{i}" for i in range(1, 61)])
    plan = profile.exact_distinct(df, df.columns)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Generate inline" not in plan  # no row for each value
    rows = spark.createDataFrame([(1.0, "a"), (None, "a")], "x double, y string")
    assert {r["column"]: r["n_distinct"] for r in profile.exact_distinct(rows, ["x", "y"]).collect()} == {"x": 1, "y": 1}


def test_empty_inputs(spark):
    assert profile.profile(spark.createDataFrame([], "struct<>")).columns == []
    none = spark.createDataFrame([], "a long, b string")
    assert [c.n_rows for c in profile.profile(none).columns] == [0, 0]
    assert clean.clean(none).count() == 0


def test_audit(spark):
    df = spark.createDataFrame([(1, "a", None), (1, "a", None), (2, None, -5.0)], "ref long, k string, price double")
    got = {r["metric"]: r["value"] for r in profile.audit(df).collect()}
    assert got["missing_values"] == 3 and got["missing_columns"] == 2 and got["duplicate_rows"] == 1
    assert got["quality_score"] == 100 - 10 - 2
    assert [(r["column"], r["n_negative"]) for r in profile.negatives(df).collect()] == [("price", 1)]
    dup = {r["column"]: r["duplicates"] for r in profile.duplicate_ids(df, ["ref", "k"]).collect()}
    assert dup == {"ref": 1, "k": 1}


def test_null_positions_matter_for_duplicates(spark):
    df = spark.createDataFrame([(None, "a"), ("a", None), (None, "a")], "x string, y string")
    assert profile.duplicate_rows(df).first()[0] == 1


def test_domain_without_hit(spark):
    h = spark.createDataFrame([("t", "zzz")], "table_id string, header string")
    row = profile.detect_domains(h).first()
    assert (row["primary_domain"], row["secondary_domains"], row["confidence"]) == ("General Analytics", "", 0.5)


@pytest.mark.parametrize("text,want", [
    ("₹50,000", 50000.0), ("$120.50", 120.5), ("15K", 15000.0), ("1.2M", 1200000.0), ("2b", 2e9),
    ("20%", 20.0), ("20pct", 20.0), ("abc", None), ("", None), (None, None), ("inf", None), ("nan", None),
    ("1e3", 1000.0), (" 7 ", 7.0), ("-3.5", -3.5), ("1d", None), ("1e999", None), (".5", 0.5), ("k", None),
    ("1 000", 1000.0), ("%", None),
])
def test_parse_number(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(fn.parse_number("t")).first()[0] == want


@pytest.mark.parametrize("text,want", [
    ("2026/09/01", "2026-09-01"), ("01-09-2026", "2026-09-01"), ("invalid_date", None),
    ("2026-09-05", "2026-09-05"), ("09/25/2026", "2026-09-25"), ("2026-02-30", None),
    ("2026-09-05 10:11:12", "2026-09-05"), ("2026-09-05 25:11:12", None), (None, None), ("2026-9-5", None),
])
def test_parse_date(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    got = df.select(fn.parse_date("t")).first()[0]
    assert (got.isoformat() if got else None) == want


def test_invalid_date_count(spark):
    df = spark.createDataFrame([("2026/09/01",), ("01-09-2026",), ("invalid_date",), ("2026-09-05",)], "Order_Date string")
    assert clean.invalid_dates(df, ["Order_Date"]).first()["invalid_dates"] == 1
    assert clean.to_dates(df, ["Order_Date"]).first()[0] == dt.date(2026, 9, 1)


def test_duplicates(spark):
    rows = [(101, "a", 1.0), (102, "b", 2.0), (101, "a", 1.0), (103, "c", 3.0)]
    df = spark.createDataFrame(rows, "Order_ID long, Product string, Sales double")
    report = {r["metric"]: r["value"] for r in clean.quality_report(df).collect()}
    assert report["duplicates_removed"] == 1 and clean.clean(df).count() == 3


def test_currency_column(spark):
    df = spark.createDataFrame([("₹50,000",), ("$120.50",), ("15K",), ("1.2M",)], "Price string")
    assert sorted(r["Price"] for r in clean.clean(df).collect()) == [120.5, 15000.0, 50000.0, 1200000.0]


def test_imputation(spark):
    df = spark.createDataFrame([("A", 5.0, 100.0, True), (None, None, None, None), ("B", 10.0, 300.0, False)],
                               "Category string, Discount double, Units double, Is_Active boolean")
    row = clean.impute(df).filter("Category = 'Unknown'").first()
    assert (row["Discount"], row["Units"], row["Is_Active"]) == (0.0, 200.0, False)


def test_chronology(spark):
    d = dt.date
    df = spark.createDataFrame([(d(2026, 9, 5), d(2026, 9, 1)), (d(2026, 9, 1), d(2026, 9, 3)), (None, d(2026, 9, 3))],
                               "Order_Date date, Delivery_Date date")
    assert clean.chronology(df, clean.date_pairs(df.columns)).first()["anomalies"] == 1


def test_clean_table_scores_100(spark):
    df = spark.createDataFrame([(1, "X"), (2, "Y"), (3, "Z")], "A long, B string")
    report = {r["metric"]: r["value"] for r in clean.quality_report(df).collect()}
    assert report["quality_score"] == 100.0


def test_ratio_rule_keeps_text_columns(spark):
    df = spark.createDataFrame([("5k",), ("alpha",), ("beta",)], "t string")
    assert clean.numeric_text_columns(df) == []
    assert clean.numeric_text_columns(df, any_rule=True) == ["t"]
