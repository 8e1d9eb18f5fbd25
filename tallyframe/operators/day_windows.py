"""Totals and medians of many day windows, without joining windows and days.

A window is (metric, first day, last day) and is answered by look-ups with equal
keys only, a few for each window, whatever its length.

* **Totals.**  The days of a metric are numbered.  For each power of two, blocks of
  that many days keep running totals from their middle outwards, to both sides.
  The first and the last day of a window lie in the two halves of exactly one
  block, so two look-ups give its totals: the left day's and the right day's.
  Sums are added, never subtracted, so large totals elsewhere cost no digits, and
  least and greatest values work in the same way.
* **Medians.**  The (value, day) pairs are numbered in order of their value, and a
  window's median is found digit by digit of that number.  Each pair counts in one block of days per power of two; a
  window is the sum of at most two blocks per power.  In each round the counts of
  the next digit tell where the wanted rank lies.

The size of the tables is days x log(days), or (day, value) pairs x log(days);
it does not depend on the number of windows.  What is numbered by one task are the
days of a metric, which the calendar bounds.  Days that only windows name are
numbered, too, so that every bound of a window is met by an equal key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions.numbering import global_row_number
from tallyframe.session import staged

BITS = 10  # of a digit of the value numbers
_KEY = ["metric_column", "first_day", "last_day", "whole"]
_WITHOUT_DAY = -1  # the level of rows that have no day


def merged(stats: DataFrame) -> DataFrame:
    """Day totals (s, n, filled, lo, hi) added up by metric and day."""
    return stats.groupBy("metric_column", "day").agg(
        F.sum("s").alias("s"), F.sum("n").alias("n"), F.sum("filled").alias("filled"),
        F.min("lo").alias("lo"), F.max("hi").alias("hi"),
    )


def _bits(n: Column) -> Column:
    """Number of binary digits; 0 for 0."""
    return F.when(n > 0, F.length(F.bin(n))).otherwise(0)


def numbered_days(days: DataFrame, windows: DataFrame) -> DataFrame:
    """metric_column, day, pos, top: the days of ``days`` and all bounds of windows, in order.

    2 to the power ``top`` is more than the number of days of the metric.
    """
    bounds = windows.select("metric_column", F.explode(F.array("first_day", "last_day")).alias("day"))
    all_days = days.select("metric_column", "day").filter("day is not null").unionByName(bounds).distinct()
    by_metric = Window.partitionBy("metric_column")
    return staged(all_days.select(
        "metric_column", "day",
        (F.row_number().over(by_metric.orderBy("day")) - 1).cast("long").alias("pos"),
        _bits(F.count("*").over(by_metric)).alias("top"),
    ))


def placed(windows: DataFrame, grid: DataFrame) -> DataFrame:
    """Windows with the positions ``l`` and ``r`` of their first and last day."""
    left = grid.select("metric_column", F.col("day").alias("first_day"), F.col("pos").alias("l"))
    right = grid.select("metric_column", F.col("day").alias("last_day"), F.col("pos").alias("r"), "top")
    return windows.join(left, ["metric_column", "first_day"]).join(right, ["metric_column", "last_day"])


def window_totals(stats: DataFrame, windows: DataFrame, grid: DataFrame) -> DataFrame:
    """The windows (``_KEY``) with s, n, filled, lo, hi; a window without rows has no row.

    A ``whole`` window has the rows without a day, too.
    """
    days = stats.filter("day is not null").join(grid, ["metric_column", "day"])
    levels = days.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("top"))))
    half = F.call_function("shiftright", F.col("pos"), F.greatest(F.col("k") - 1, F.lit(0)))
    # days that only windows name have no totals but must be met by their key
    levels = levels.select("metric_column", "k", "pos", half.alias("half"), "s", "n", "filled", "lo", "hi")
    bare = grid.join(stats.filter("day is not null").select("metric_column", "day"), ["metric_column", "day"], "left_anti")
    none = [F.lit(None).cast(t).alias(c) for c, t in (("s", "double"), ("n", "long"), ("filled", "long"), ("lo", "double"), ("hi", "double"))]
    bare = bare.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("top")))).select("metric_column", "k", "pos", half.alias("half"), *none)
    outwards = F.when(F.col("half") % 2 == 1, F.col("pos")).otherwise(-F.col("pos"))
    run = Window.partitionBy("metric_column", "k", "half").orderBy(outwards).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    # on level 0 each day is a half of its own
    running = levels.unionByName(bare).select(
        "metric_column", "k", "pos",
        *(F.sum(c).over(run).alias(c) for c in ("s", "n", "filled")), F.min("lo").over(run).alias("lo"), F.max("hi").over(run).alias("hi"),
    )
    dayless = stats.filter("day is null").select(
        "metric_column", F.lit(_WITHOUT_DAY).alias("k"), F.lit(0).cast("long").alias("pos"), "s", "n", "filled", "lo", "hi"
    )
    table = running.filter("n is not null").unionByName(dayless)
    k = _bits(F.col("l").bitwiseXOR(F.col("r")))
    at = lambda k, pos: F.struct(k.alias("k"), pos.alias("pos"))
    keys = F.when(F.col("l") == F.col("r"), F.array(at(F.lit(0), F.col("l")))).otherwise(
        F.array(at(k, F.col("l")), at(k, F.col("r")))
    )
    extra = F.when(F.col("whole"), F.array(at(F.lit(_WITHOUT_DAY), F.lit(0).cast("long")))).otherwise(
        F.array().cast("array<struct<k: int, pos: bigint>>")
    )
    asked = placed(windows, grid).select(*_KEY, F.inline(F.concat(keys, extra)))
    return asked.join(table, ["metric_column", "k", "pos"]).groupBy(*_KEY).agg(
        F.sum("s").alias("s"), F.sum("n").alias("n"), F.sum("filled").alias("filled"), F.min("lo").alias("lo"), F.max("hi").alias("hi")
    )


def _blocks() -> Column:
    """The blocks (k, block) of days whose sum is the window from ``l`` to ``r``."""
    k = F.sequence(F.lit(0), F.col("top"))
    shift = lambda c, n: F.call_function("shiftright", c, n)

    def at(n: Column) -> Column:
        # from l and up to r, both rounded inwards to whole blocks of 2^n days
        left = -shift(-F.col("l"), n)
        right = shift(F.col("r") + 1, n)
        named = lambda block: F.named_struct(F.lit("k"), n, F.lit("block"), block)
        one = F.when((left < right) & (left % 2 == 1), named(left))
        two = F.when((left < right) & (right % 2 == 1), named(right - 1))
        return F.array(one, two)

    found = F.filter(F.flatten(F.transform(k, at)), lambda b: b.isNotNull())
    dayless = F.array(F.struct(F.lit(_WITHOUT_DAY).alias("k"), F.lit(0).cast("long").alias("block")))
    return F.when(F.col("whole"), F.concat(found, dayless)).otherwise(found)


def _in_blocks(facts: DataFrame, blocks: DataFrame, grid: DataFrame) -> DataFrame:
    """``facts`` in any of the blocks, with ``levels``: those on which a block holds their day.

    The levels are found for days, not for facts.
    """
    days = grid.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("top"))))
    days = days.withColumn("block", F.call_function("shiftright", F.col("pos"), F.col("k")))
    levels = days.join(blocks, ["metric_column", "k", "block"]).select("metric_column", "pos", "k").unionByName(
        blocks.filter(F.col("k") < 0).select("metric_column", F.lit(None).cast("long").alias("pos"), "k")
    )
    levels = levels.groupBy(F.col("metric_column").alias("m"), F.coalesce("pos", F.lit(-1)).alias("p")).agg(
        F.collect_list("k").alias("levels")
    )
    same = (F.col("metric_column") == F.col("m")) & (F.coalesce("pos", F.lit(-1)) == F.col("p"))
    return facts.join(levels, same).drop("m", "p")


def window_medians(values: DataFrame, windows: DataFrame, grid: DataFrame) -> DataFrame:
    """The windows (``_KEY``) with their median; a window without values has no row.

    ``values``: metric_column, day, v, c (how often the metric has v on the day);
    ``windows`` have n, the number of values in them.
    """
    order = global_row_number(values, ["metric_column", "v", F.col("day").asc_nulls_first()], "place")
    distinct = order.count()
    if not distinct:
        return windows.select(*_KEY, F.lit(0.0).alias("median")).filter("false")
    bits = max(1, (distinct - 1).bit_length())
    rounds = -(-bits // BITS)
    width = -(-bits // rounds)
    middle = [F.floor((F.col("n") - 1) / 2), F.ceil((F.col("n") - 1) / 2)]
    one = [*_KEY, "l", "r", "top", "target"]
    state = (
        placed(windows.filter("n > 0"), grid)
        .select(*_KEY, "l", "r", "top", F.explode(F.array_distinct(F.array(*middle))).alias("target"))
        .withColumn("rank", F.col("target")).withColumn("node", F.lit(0).cast("long"))
    )
    blocks = state.select("metric_column", F.inline(_blocks())).distinct()
    counted = staged(_in_blocks(order.join(grid.drop("top"), ["metric_column", "day"], "left"), blocks, grid).drop("day"))
    for step in range(rounds - 1, -1, -1):
        shift = width * step
        facts = counted.withColumn("digit", F.shiftright("place", shift)).withColumn("node", F.shiftright("place", shift + width))
        if step < rounds - 1:
            facts = facts.join(state.select("metric_column", "node").distinct(), ["metric_column", "node"], "left_semi")
        block = F.when(F.col("k") < 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftright", F.col("pos"), F.col("k")))
        counts = (
            facts.withColumn("k", F.explode("levels")).withColumn("block", block)
            .groupBy("metric_column", "node", "k", "block", "digit").agg(F.sum("c").alias("c"))
        )
        met = state.select(*one, "rank", "node", F.inline(_blocks())).join(counts, ["metric_column", "node", "k", "block"])
        digits = met.groupBy(*one, "rank", "digit").agg(F.sum("c").alias("c"))
        upto = Window.partitionBy(*one).orderBy("digit").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        hit = digits.withColumn("end", F.sum("c").over(upto)).filter("rank < end and rank >= end - c")
        state = hit.select(*one, (F.col("rank") - F.col("end") + F.col("c")).alias("rank"), F.col("digit").alias("node"))
        if step:
            state = staged(state)
    low, high = F.min("v"), F.max("v")
    found = state.join(counted.select("v", F.col("place").alias("node")), "node")
    return found.groupBy(*_KEY).agg((low + (high - low) * 0.5).alias("median"))
