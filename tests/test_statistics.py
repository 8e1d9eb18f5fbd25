import math
import random
import statistics

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyframe.functions.numbering import global_row_number
from tallyframe.functions.quantiles import exact_quantiles
from tallyframe.operators import aggregate, filters, rank
from tallyframe.plans.base import rounded


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 7, 10, 101, 5000])
@pytest.mark.parametrize("accuracy", [20, 100_000])
def test_quantiles_match_numpy(spark, n, accuracy):
    rng = random.Random(n)
    values = [round(rng.lognormvariate(3, 2), rng.choice([0, 2, 6])) for _ in range(n)]
    ps = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99, 1.0]
    df = frame(spark, [(v,) for v in values] + [(None,)], "v double").repartition(4)
    row = exact_quantiles(df, "v", ps, accuracy=accuracy).first()
    assert row["n"] == n
    for got, want in zip(row["q"], np.quantile(values, ps)):
        assert got == pytest.approx(want, rel=1e-12)


def test_quantiles_with_one_hot_value(spark):
    values = [5.0] * 4000 + [float(i) for i in range(2000)] + [-1e300, 1e300]
    df = frame(spark, [(v,) for v in values], "v double").repartition(8)
    ps = [0.01, 0.3, 0.5, 0.7, 0.999]
    got = exact_quantiles(df, "v", ps, accuracy=50).first()["q"]
    assert got == pytest.approx(list(np.quantile(values, ps)))


def test_quantiles_per_key(spark):
    rng = random.Random(1)
    rows = [(rng.choice("aaab") if rng.random() > 0.1 else None, rng.gauss(0, 1)) for _ in range(900)]
    got = {r["k"]: r["q"] for r in exact_quantiles(frame(spark, rows, "k string, v double"), "v", [0.5, 0.9], ["k"]).collect()}
    assert set(got) == {"a", "b"}
    for k, q in got.items():
        assert q == pytest.approx(list(np.quantile([v for kk, v in rows if kk == k], [0.5, 0.9])))


def test_quantiles_of_nothing(spark):
    row = exact_quantiles(frame(spark, [(None,)], "v double"), "v", [0.5]).collect()
    assert len(row) == 1 and row[0]["n"] == 0 and row[0]["q"] is None


def test_plain_statistics(spark):
    df = frame(spark, [(10,), (20,), (30,), (None,)], "Score long")
    assert aggregate.metric(df, "sum", "Score").first()[0] == 60.0
    assert aggregate.metric(df, "median", "Score").first()[0] == 20.0
    assert aggregate.count_of(df, "Score").first()[0] == 3
    assert aggregate.count_of(df).first()[0] == 4
    assert aggregate.metric(df.filter("Score > 99"), "sum", "Score").first()[0] == 0.0


def test_skew_is_bias_adjusted(spark):
    values = [1.0, 2.0, 3.0, 10.0, 50.0]
    df = frame(spark, [(v,) for v in values], "v double")
    got = aggregate.distribution(df, "v").first()
    s = pd.Series(values)
    assert got["skewness"] == pytest.approx(s.skew())
    assert got["std_dev"] == pytest.approx(statistics.stdev(values))
    assert (got["p25"], got["p75"]) == (s.quantile(0.25), s.quantile(0.75))


def test_correlation_edges(spark):
    df = frame(spark, [(1.0, 2.0), (2.0, 4.0), (3.0, None), (None, 9.0), (4.0, 7.0)], "a double, b double")
    pdf = df.toPandas()
    assert aggregate.correlation(df, "a", "b").first()[0] == pytest.approx(pdf.a.corr(pdf.b))
    flat = frame(spark, [(1.0, 2.0), (2.0, 2.0)], "a double, b double")
    assert aggregate.correlation(flat, "a", "b").first()[0] is None


def test_outliers(spark):
    df = frame(spark, [(float(v),) for v in [1, 2, 3, 4, 100]] + [(None,)], "v double")
    row = aggregate.outliers(df, "v").first()
    assert (row["outlier_count"], row["lower_bound"], row["upper_bound"], row["total_records"]) == (1, -1.0, 7.0, 6)


def test_ratio_by_zero_is_zero(spark):
    df = frame(spark, [(5.0, 0.0)], "a double, b double")
    assert aggregate.column_totals(df, "a", "b", "ratio").first()[0] == 0.0
    assert aggregate.column_totals(df, "a", "b", "percentage").first()[0] == 0.0


def test_groups_honour_the_function_and_drop_null_keys(spark):
    rows = [("a", 1.0), ("a", 3.0), ("a", None), ("b", 7.0), (None, 9.0), ("c", None)]
    df = frame(spark, rows, "k string, v double")
    get = lambda op: {r["k"]: r["value"] for r in aggregate.group_by(df, ["k"], "v", op).collect()}
    assert get("sum") == {"a": 4.0, "b": 7.0, "c": 0.0}
    assert get("median") == {"a": 2.0, "b": 7.0, "c": None}
    assert get("count") == {"a": 2, "b": 1, "c": 0}
    assert get("max") == {"a": 3.0, "b": 7.0, "c": None}


def test_order_of_rows_does_not_matter(spark):
    rng = random.Random(3)
    rows = [(rng.choice("xyz"), rng.choice("pq"), float(rng.randint(0, 50))) for _ in range(400)]
    a = frame(spark, rows, "g string, i string, v double")
    rng.shuffle(rows)
    b = frame(spark, rows, "g string, i string, v double").repartition(7)
    for f in (
        lambda d: rank.partitioned_top_n(d, "g", "i", "v", 1),
        lambda d: rank.ranking(d, ["g"], "v"),
        lambda d: rounded(aggregate.distribution(d, "v"), 9),
    ):
        assert sorted(map(str, f(a).collect())) == sorted(map(str, f(b).collect()))


def test_ranking_with_ties(spark):
    df = frame(spark, [("b", 5.0), ("a", 5.0), ("c", 9.0)], "k string, v double")
    for limit in (10, None):
        got = [(r["k"], r["place"]) for r in rank.ranking(df, ["k"], "v", limit=limit).orderBy("place").collect()]
        assert got == [("c", 1), ("a", 2), ("b", 3)]
    assert rank.winner(df, "k", "v", highest=False).first()["k"] == "a"


def test_row_numbers_are_consecutive_with_a_hot_leading_key(spark):
    df = spark.range(3000).select((F.col("id") % 3).cast("boolean").alias("hot"), "id")
    out = global_row_number(df, ["hot", "id"], partitions=6).orderBy("row_index").collect()
    assert [r["row_index"] for r in out] == list(range(3000))
    keys = [(r["hot"], r["id"]) for r in out]
    assert keys == sorted(keys)
    assert sorted(r["row_index"] for r in global_row_number(df).collect()) == list(range(3000))


def test_filters(spark):
    df = frame(spark, [(1, " North ", 5.0), (2, "south", 7.0), (3, None, None)], "id long, r string, v double")
    ids = lambda d: sorted(r["id"] for r in d.collect())
    assert ids(filters.where_all(df, [("r", "==", "north")])) == [1]
    assert ids(filters.where_all(df, [("r", "!=", "NORTH")])) == [2, 3]
    assert ids(filters.where_all(df, [("v", "==", 5)])) == [1]
    assert ids(filters.where_all(df, [("v", ">", 5), ("v", "<=", 7)])) == [2]
    assert ids(filters.search_any(df, "SOU")) == [2]
    with pytest.raises(ValueError):
        filters.where_all(df, [("nope", "==", 1)])
    low = filters.where_all(df, [("v", "<", 6)])
    high = filters.where_all(df, [("v", ">=", 6)])
    none = df.filter("v is null")
    assert ids(low.union(high).union(none)) == ids(df)


def test_filter_reaches_the_scan(spark, folder):
    df = spark.read.parquet(f"{folder}/orders.parquet")
    plan = filters.after_date(df, "o_orderdate", "2000-01-01").select("o_orderkey")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderdate" in text and "o_totalprice" not in text


def test_pages(spark):
    df = spark.range(25)
    assert [r["id"] for r in filters.page(df, ["id"], 3, 10).collect()] == list(range(20, 25))
    assert [r["id"] for r in filters.page_after(df, "id", 9, 3).collect()] == [10, 11, 12]
    assert math.isclose(filters.preview(df, ["id"], 5).count(), 5)
