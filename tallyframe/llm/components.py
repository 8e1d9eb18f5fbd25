"""Connected components of an edge table, by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.native import staged


def _stars(edges: DataFrame, smaller: bool) -> DataFrame:
    """Hang the larger (or, if ``smaller``, the smaller) neighbours of each node on its least one.

    Edges (a, b) have the larger node first.  Minima are combined before the shuffle; a node of very many edges meets its
    minimum in a join that adaptive execution may split.
    """
    pair = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    a, b, least = F.col("a"), F.col("b"), F.col("least")
    if smaller:
        sides, hung = edges, F.array(pair(b, least), pair(a, least))
    else:
        sides = edges.select(F.inline(F.array(pair(a, b), pair(b, a))))
        hung = F.when(b > a, F.array(pair(b, least)))
    minima = sides.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
    met = sides.join(minima, "a")
    return staged(met.select(F.inline(hung)).filter("a <> b").distinct())


def components(edges: DataFrame) -> DataFrame:
    """node, component (the least node it reaches) of all nodes of edges (a, b), both long.

    Large-star and small-star steps take turns until the edges no longer change;
    each round is written to the shared folder, so lost executors cost a round at
    most.  Loops are ignored: a node of loops alone is not returned.
    """
    now = staged(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    )
    mark = None
    while True:
        now = _stars(_stars(now, False), True)
        row = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(row) == mark or not row[0]:
            break
        mark = tuple(row)
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
