"""Business rates, contributions, comparisons, multi-step questions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions.columns import growth_pct, pct0, ratio0, sum0, text_is, truthy
from tallyframe.operators.aggregate import group_totals
from tallyframe.operators.timeseries import growth, period_start


def rate(df: DataFrame, hit: Column, name: str) -> DataFrame:
    """Share of rows that meet a condition, in percent, with both counts."""
    return df.agg(
        F.count_if(hit).alias("hits"), F.count(F.lit(1)).alias("total_orders")
    ).select(
        F.col("hits").alias(f"{name}_orders"),
        "total_orders",
        pct0(F.col("hits").cast("double"), F.col("total_orders").cast("double")).alias(
            "rate_percentage"
        ),
    )


def return_rate(df: DataFrame, flag: str | None = None, status: str | None = None) -> DataFrame:
    """By a yes/no flag if there is one, else by the status text ``returned``."""
    if not flag and not status:
        raise ValueError("name the return flag or the order status column")
    return rate(df, truthy(flag) if flag else text_is(status, "returned"), "returned")


def cancellation_rate(df: DataFrame, status: str, word: str = "cancelled") -> DataFrame:
    return rate(df, text_is(status, word), "cancelled")


def delivery_rate(df: DataFrame, status: str, word: str = "delivered") -> DataFrame:
    return rate(df, text_is(status, word), "delivered")


def total(df: DataFrame, column: str, name: str) -> DataFrame:
    return df.agg(sum0(column).alias(name))


def profit_margin(df: DataFrame, profit: str, sales: str) -> DataFrame:
    return df.agg(sum0(profit).alias("total_profit"), sum0(sales).alias("total_sales")).withColumn(
        "profit_margin_percentage", pct0(F.col("total_profit"), F.col("total_sales"))
    )


def average_order_value(df: DataFrame, sales: str, order: str | None = None) -> DataFrame:
    """Sales per distinct order, or per row without an order column."""
    orders = F.count_distinct(F.col(order)) if order else F.count(F.lit(1))
    return df.agg(sum0(sales).alias("total_sales"), orders.alias("total_orders")).withColumn(
        "average_order_value", ratio0(F.col("total_sales"), F.col("total_orders").cast("double"))
    )


def contribution(df: DataFrame, key: str, column: str, limit: int | None = None) -> DataFrame:
    """Group share of the grand total; rows without a key count in the total.

    The grand total is a scalar subquery over the group sums, so no window pulls
    all groups into one task.
    """
    sums = df.groupBy(key).agg(F.sum(column).alias("value"))
    grand = sums.agg(sum0("value").alias("t")).scalar()
    shares = (
        sums.filter(F.col(key).isNotNull())
        .withColumn("value", F.coalesce("value", F.lit(0.0)))
        .withColumn("percentage", pct0(F.col("value"), grand))
        .orderBy(F.col("percentage").desc(), key)
    )
    return shares if limit is None else shares.limit(limit)


def group_difference(
    df: DataFrame, key: str, column: str, groups: Sequence[str] | None = None
) -> DataFrame:
    """Two group totals side by side; without names the two largest groups.

    Group names match without regard to case.  An absent group counts as 0.
    """
    if groups:
        a, b = groups[0], groups[1]
        hit_a, hit_b = text_is(key, a), text_is(key, b)
        sums = df.filter(hit_a | hit_b).agg(
            F.lit(a).alias("group_a"),
            F.lit(b).alias("group_b"),
            sum0(F.when(hit_a, F.col(column))).alias("total_a"),
            sum0(F.when(hit_b, F.col(column))).alias("total_b"),
        )
    else:
        top = group_totals(df, [key], column).orderBy(F.col("value").desc(), key).limit(2)
        first_two = F.sort_array(
            F.collect_list(F.struct((-F.col("value")).alias("v"), F.col(key).alias("k")))
        )
        sums = top.agg(first_two.alias("s")).select(
            F.get("s", 0)["k"].cast("string").alias("group_a"),
            F.get("s", 1)["k"].cast("string").alias("group_b"),
            (-F.get("s", 0)["v"]).alias("total_a"),
            F.coalesce(-F.get("s", 1)["v"], F.lit(0.0)).alias("total_b"),
        )
    gap = F.col("total_a") - F.col("total_b")
    return sums.withColumn("absolute_difference", gap).withColumn(
        "percentage_difference", pct0(gap, F.col("total_b"))
    )


def actual_vs_target(df: DataFrame, actual: str, target: str) -> DataFrame:
    a, t = F.col("actual"), F.col("target")
    return df.agg(sum0(actual).alias("actual"), sum0(target).alias("target")).select(
        "actual", "target", (a - t).alias("variance"), pct0(a, t).alias("attainment_percentage")
    )


def top_n_contribution(df: DataFrame, key: str, column: str, n: int = 3) -> DataFrame:
    """The ``n`` largest groups with their joint share of the grand total."""
    sums = df.groupBy(key).agg(sum0(column).alias("value"))
    top = sums.filter(F.col(key).isNotNull()).orderBy(F.col("value").desc(), key).limit(n)
    grand = sums.agg(sum0("value").alias("t")).scalar()
    everything = Window.partitionBy()  # n rows only
    joint = F.sum("value").over(everything)
    return (
        top.withColumn("overall_total", grand)
        .withColumn("top_total", joint)
        .withColumn(
            "percentage_contribution",
            F.when(F.col("overall_total") > 0, pct0(F.col("top_total"), F.col("overall_total")))
            .otherwise(0.0),
        )
    )


def above_average(df: DataFrame, key: str, column: str, limit: int | None = None) -> DataFrame:
    """Groups above the mean of all group totals, with threshold and counts."""
    totals = group_totals(df, [key], column)
    mean = totals.agg(F.avg("value").alias("m")).scalar()
    tested = totals.withColumn("average_threshold", mean)
    counts = tested.agg(
        F.struct(
            F.count_if(F.col("value") > F.col("average_threshold")).alias("q"),
            F.count("*").alias("n"),
        ).alias("s")
    ).scalar()
    above = tested.filter(F.col("value") > F.col("average_threshold")).orderBy(F.col("value").desc(), key)
    return (
        (above if limit is None else above.limit(limit))
        .withColumn("_c", counts)
        .select(key, "value", "average_threshold", F.col("_c.q").alias("qualifying_count"),
                F.col("_c.n").alias("total_count"))
    )


def extreme_combination(df: DataFrame, key: str, sales: str, profit: str) -> DataFrame:
    """Best seller, lowest margin, and how many sell above average at a margin
    below average.  Groups without sales are left out."""
    grouped = (
        df.filter(F.col(key).isNotNull())
        .groupBy(key)
        .agg(sum0(sales).alias("sales"), sum0(profit).alias("profit"))
        .withColumn("margin", F.try_divide("profit", "sales") * 100.0)
        .filter(F.col("margin").isNotNull())
    )
    means = grouped.agg(F.struct(F.avg("sales").alias("s"), F.avg("margin").alias("m")).alias("a"))
    # first key on a tie: the largest sales / the least margin, then the least key
    best = F.min_by(F.struct(key, "sales", "margin"), F.struct(-F.col("sales"), F.col(key)))
    worst = F.min_by(F.struct(key, "sales", "margin"), F.struct("margin", key))
    niche = (F.col("sales") > F.col("_m.s")) & (F.col("margin") < F.col("_m.m"))
    return (
        grouped.withColumn("_m", means.scalar())
        .agg(best.alias("b"), worst.alias("w"), F.count_if(niche).alias("niche_count"))
        .select(
            F.col(f"b.{key}").cast("string").alias("highest_sales_item"),
            F.col("b.sales").alias("highest_sales"),
            F.col("b.margin").alias("highest_sales_margin"),
            F.col(f"w.{key}").cast("string").alias("lowest_margin_item"),
            F.col("w.margin").alias("lowest_margin"),
            F.col("w.sales").alias("lowest_margin_sales"),
            "niche_count",
        )
    )


def drop_months(df: DataFrame, date: str, month: str) -> DataFrame:
    """One row: the target month and the latest earlier month that has rows."""
    first = F.to_date(F.lit(f"{month}-01"))
    start = period_start(F.col(date), "month")
    return df.select(start.alias("m")).filter(F.col("m") <= first).agg(
        F.max(F.when(F.col("m") == first, F.col("m"))).alias("now"),
        F.max(F.when(F.col("m") < first, F.col("m"))).alias("before"),
    )


def _two_months(
    df: DataFrame, date: str, column: str, month: str, dims: Sequence[str]
) -> tuple[Column, Column, DataFrame]:
    """Both months, as literals, and their sums per combination of the dimensions.

    The months are found first, from the dates alone.  Between them no month has
    rows, so one range, known before the scan, holds just the rows of both.
    """
    found = drop_months(df, date, month).first()
    now, before = (F.lit(found[c]).cast("date") for c in ("now", "before"))
    there = [m for m in (found["before"], found["now"]) if m]
    if there:
        kept = df.filter((F.col(date) >= F.lit(there[0])) & (F.col(date) < F.add_months(F.lit(there[-1]), 1)))
    else:
        kept = df.filter(F.lit(False))
    m = period_start(F.col(date), "month")
    sums = (
        kept.select(*dims, m.alias("_m"), F.col(column).alias("_v"))
        .groupBy(*dims)
        .agg(
            sum0(F.when(F.col("_m") == before, F.col("_v"))).alias("before"),
            sum0(F.when(F.col("_m") == now, F.col("_v"))).alias("now"),
        )
    )
    return now, before, sums


def drop_total(df: DataFrame, date: str, column: str, month: str) -> DataFrame:
    """Total change of a month against the previous month that has rows."""
    now, before, sums = _two_months(df, date, column, month, [])
    change = F.col("now") - F.col("before")
    return sums.select(
        F.date_format(now, "yyyy-MM").alias("period"),
        F.date_format(before, "yyyy-MM").alias("previous_period"),
        F.col("now").alias("total"),
        F.col("before").alias("previous_total"),
        change.alias("change"),
        F.when(F.col("before") > 0, growth_pct(F.col("now"), F.col("before")))
        .otherwise(0.0)
        .alias("change_pct"),
    )


def drop_drivers(
    df: DataFrame, date: str, column: str, month: str, dims: Sequence[str]
) -> DataFrame:
    """Per dimension the value with the deepest fall between the two months.

    A value present in one month only counts as 0 in the other.
    """
    cells = _two_months(df, date, column, month, dims)[2]
    long = cells.unpivot(["before", "now"], [F.col(d).cast("string").alias(d) for d in dims],
                         "dimension", "item")
    changes = (
        long.filter(F.col("item").isNotNull())
        .groupBy("dimension", "item")
        .agg(F.sum("before").alias("previous_total"), F.sum("now").alias("total"))
        .withColumn("change", F.col("total") - F.col("previous_total"))
    )
    return changes.groupBy("dimension").agg(
        F.min_by(F.struct("item", "previous_total", "total", "change"),
                 F.struct("change", "item")).alias("w")
    ).select("dimension", "w.*").filter(F.col("change") < 0)


def compare_groups_full_outer(
    before: DataFrame, now: DataFrame, key: str, column: str
) -> DataFrame:
    """Group totals of two tables side by side, 0 where a side has none."""
    a = group_totals(before, [key], column, name="previous_total")
    b = group_totals(now, [key], column, name="total")
    zero = F.lit(0.0)
    return (
        a.join(b, key, "full")
        .select(
            key,
            F.coalesce("previous_total", zero).alias("previous_total"),
            F.coalesce("total", zero).alias("total"),
        )
        .withColumn("change", F.col("total") - F.col("previous_total"))
    )


def conversion_rate(
    events: DataFrame, user: str, kind: str, source: str = "view", goal: str = "purchase"
) -> DataFrame:
    """Users with the goal event per user with the source event, in percent."""
    per_user = events.groupBy(user).agg(
        F.max((F.col(kind) == source).cast("int")).alias("s"),
        F.max((F.col(kind) == goal).cast("int")).alias("g"),
    )
    return per_user.filter(F.col(user).isNotNull()).agg(
        F.coalesce(F.sum("s"), F.lit(0)).alias("source_users"),
        F.coalesce(F.sum(F.col("s") * F.col("g")), F.lit(0)).alias("goal_users"),
    ).withColumn(
        "rate_percentage",
        pct0(F.col("goal_users").cast("double"), F.col("source_users").cast("double")),
    )


def click_through_rate(events: DataFrame, kind: str) -> DataFrame:
    return events.agg(
        F.count_if(F.col(kind) == "click").alias("clicks"),
        F.count_if(F.col(kind) == "view").alias("views"),
    ).withColumn(
        "rate_percentage", pct0(F.col("clicks").cast("double"), F.col("views").cast("double"))
    )


def customer_growth(df: DataFrame, customer: str, date: str) -> DataFrame:
    """Customers first seen per month, months without any as 0, and the change."""
    first = df.filter(F.col(customer).isNotNull()).groupBy(customer).agg(F.min(date).alias("_first"))
    return growth(first.withColumn("_one", F.lit(1.0)), "_first", "_one", "month").withColumnRenamed(
        "total", "new_customers"
    )

