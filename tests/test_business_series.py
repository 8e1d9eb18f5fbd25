import datetime as dt

import pandas as pd
import pytest

from tallyframe.operators import business as biz
from tallyframe.operators import timeseries as ts

DAY = dt.date


def series(spark):
    rows = [(DAY(2024, 1, 5), 10.0), (DAY(2024, 1, 20), 5.0), (DAY(2024, 4, 1), 30.0), (None, 99.0), (DAY(2024, 5, 31), None)]
    return spark.createDataFrame(rows, "d date, v double")


@pytest.mark.parametrize("grain,freq", [("day", "D"), ("week", "W"), ("month", "ME"), ("quarter", "QE"), ("year", "YE")])
def test_resample_matches_pandas(spark, grain, freq):
    df = series(spark)
    got = [r["total"] for r in ts.resample(df, "d", "v", grain).orderBy("period_start").collect()]
    pdf = df.toPandas().dropna(subset=["d"])
    pdf["d"] = pd.to_datetime(pdf["d"])
    assert got == pdf.set_index("d").resample(freq)["v"].sum().tolist()


def test_week_carries_its_sunday(spark):
    df = spark.createDataFrame([(DAY(2024, 1, 1), 1.0), (DAY(2024, 1, 7), 2.0), (DAY(2024, 1, 8), 4.0)], "d date, v double")
    got = {r["period"]: r["total"] for r in ts.resample(df, "d", "v", "week").collect()}
    assert got == {"2024-01-07": 3.0, "2024-01-14": 4.0}


def test_growth_from_zero_has_no_rate(spark):
    out = {r["period"]: r["growth_pct"] for r in ts.growth(series(spark), "d", "v").collect()}
    assert out == {"2024-01": None, "2024-02": -100.0, "2024-03": None, "2024-04": None, "2024-05": -100.0}
    assert ts.best_growth(series(spark), "d", "v").first()["highest_growth_period"] == "2024-02"


def test_running_values(spark):
    ma = [r["moving_average"] for r in ts.moving_average(series(spark), "d", "v").orderBy("period").collect()]
    assert ma == [0.0, 0.0, 5.0, 10.0, 10.0]
    cum = [r["running_total"] for r in ts.cumulative(series(spark), "d", "v").orderBy("period").collect()]
    assert cum == [15.0, 15.0, 15.0, 45.0, 45.0]


def test_year_over_year_lags_twelve_months(spark):
    df = spark.createDataFrame([(DAY(2023, 1, 1), 10.0), (DAY(2024, 1, 1), 15.0)], "d date, v double")
    out = {r["period"]: r["growth_pct"] for r in ts.year_over_year(df, "d", "v").collect()}
    assert out["2024-01"] == 50.0 and len(out) == 13


def test_rates(spark):
    df = spark.createDataFrame([("Yes", "Returned"), ("no", "delivered"), (None, "CANCELLED"), ("1", None)], "r string, s string")
    assert biz.return_rate(df, flag="r").first()["rate_percentage"] == 50.0
    assert biz.return_rate(df, status="s").first()["rate_percentage"] == 25.0
    assert biz.cancellation_rate(df, "s").first()["cancelled_orders"] == 1
    assert biz.delivery_rate(df.filter("false"), "s").first()["rate_percentage"] == 0.0


def test_contribution_counts_rows_without_a_key(spark):
    df = spark.createDataFrame([("a", 25.0), ("b", 25.0), (None, 50.0)], "k string, v double")
    assert [(r["k"], r["percentage"]) for r in biz.contribution(df, "k", "v").collect()] == [("a", 25.0), ("b", 25.0)]


def test_group_difference(spark):
    df = spark.createDataFrame([("North", 30.0), ("South", 20.0), ("East", 5.0)], "k string, v double")
    row = biz.group_difference(df, "k", "v", ["north", "SOUTH"]).first()
    assert (row["absolute_difference"], row["percentage_difference"]) == (10.0, 50.0)
    top = biz.group_difference(df, "k", "v").first()
    assert (top["group_a"], top["group_b"]) == ("North", "South")
    assert biz.group_difference(df, "k", "v", ["north", "west"]).first()["percentage_difference"] == 0.0


def test_above_average_and_extremes(spark):
    df = spark.createDataFrame([("a", 100.0, 1.0), ("b", 10.0, 5.0), ("c", 10.0, 8.0), ("z", 0.0, 3.0)], "k string, s double, p double")
    above = biz.above_average(df, "k", "s").collect()
    assert [(r["k"], r["average_threshold"], r["qualifying_count"], r["total_count"]) for r in above] == [("a", 30.0, 1, 4)]
    row = biz.extreme_combination(df, "k", "s", "p").first()
    assert (row["highest_sales_item"], row["lowest_margin_item"], row["niche_count"]) == ("a", "a", 1)


def test_drop_compares_with_the_previous_month_that_has_rows(spark):
    rows = [(DAY(2024, 1, 3), "x", "n", 100.0), (DAY(2024, 1, 4), "y", "s", 50.0), (DAY(2024, 3, 1), "x", "n", 20.0),
            (DAY(2024, 3, 2), "w", "n", 60.0), (DAY(2024, 4, 1), "x", "n", 500.0)]
    df = spark.createDataFrame(rows, "d date, product string, region string, v double")
    total = biz.drop_total(df, "d", "v", "2024-03").first()
    assert (total["period"], total["previous_period"], total["change"]) == ("2024-03", "2024-01", -70.0)
    drivers = {r["dimension"]: (r["item"], r["change"]) for r in biz.drop_drivers(df, "d", "v", "2024-03", ["product", "region"]).collect()}
    assert drivers == {"product": ("x", -80.0), "region": ("s", -50.0)}
    gone = biz.drop_total(df, "d", "v", "2024-02").first()
    assert (gone["period"], gone["previous_period"], gone["change"]) == (None, "2024-01", -150.0)
    none = biz.drop_total(df, "d", "v", "2023-05").first()
    assert (none["period"], none["previous_period"], none["total"], none["change_pct"]) == (None, None, 0.0, 0.0)
    assert biz.drop_drivers(df, "d", "v", "2023-05", ["product"]).count() == 0


def test_drop_reads_the_range_of_its_months(spark, tmp_path):
    rows = [(DAY(2024, m, 3), "x", 1.0) for m in range(1, 10)]
    spark.createDataFrame(rows, "d date, product string, v double").write.parquet(str(tmp_path / "t"))
    plan = biz.drop_drivers(spark.read.parquet(str(tmp_path / "t")), "d", "v", "2024-05", ["product"])
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(d,2024-04-01)" in text and "LessThan(d,2024-06-01)" in text


def test_profit_and_orders(spark):
    df = spark.createDataFrame([(1, 10.0, 2.0), (1, 20.0, 3.0), (2, 30.0, 5.0)], "o long, s double, p double")
    assert biz.average_order_value(df, "s", "o").first()["average_order_value"] == 30.0
    assert biz.average_order_value(df, "s").first()["average_order_value"] == 20.0
    assert biz.profit_margin(df, "p", "s").first()["profit_margin_percentage"] == pytest.approx(100 / 6)
    row = biz.top_n_contribution(df, "o", "s", 1).first()
    assert (row["value"], row["percentage_contribution"]) == (30.0, 50.0)
