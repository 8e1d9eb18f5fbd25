"""Helpers of the operators that stay inside DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.session import shared_dir

WORD = r"[^\x20\x09-\x0D]+"
_CHUNK = 65536


def n_words(text: Column) -> Column:
    """Number of blank-separated words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def staged(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, its lineage cut."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def free_name(df: DataFrame, *names: str) -> list[str]:
    """``names``, each lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def numbered(df: DataFrame, count: str, out: str) -> DataFrame:
    """Each row ``count`` times, with ``out`` = 0, 1, ...; none if count is 0.

    Large counts are cut into chunks that are dealt out before they unfold.
    """
    chunk, last = free_name(df, "chunk", "last")
    top = F.floor((F.col(count) - 1) / _CHUNK).cast("long")
    chunks = df.filter(F.col(count) > 0).withColumn(chunk, F.explode(F.sequence(F.lit(0).cast("long"), top)))
    first = F.col(chunk) * _CHUNK
    parts = chunks.repartition(*(F.col(f"`{c}`") for c in chunks.columns)).withColumn(
        last, F.least(first + _CHUNK, F.col(count)) - 1
    )
    return parts.withColumn(out, F.explode(F.sequence(first, F.col(last)))).drop(chunk, last)


def running(df: DataFrame, by: list[str], bucket: str, order: list[str], value: str, out: str) -> DataFrame:
    """Sum of ``value`` over the earlier rows of the same ``by``, without one task per ``by``.

    ``bucket`` must not fall as ``order`` rises.  Sums of buckets are added up
    first; rows are then ordered within their bucket only.
    """
    base, total = free_name(df, "base", "total")
    sums = df.groupBy(*by, bucket).agg(F.sum(value).alias(total))
    before = Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(*by, bucket, F.coalesce(F.sum(total).over(before), F.lit(0)).alias(base))
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in (*by, bucket)]
    joined = df.alias("l").join(bases.alias("r"), same).select("l.*", f"r.{base}")
    inside = Window.partitionBy(*by, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return joined.withColumn(out, F.col(base) + F.coalesce(F.sum(value).over(inside), F.lit(0))).drop(base)


def computed_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column whose expression no later filter or lambda pulls in again.

    It comes out of a generator (of one element), which the optimizer does not
    merge with what stands above it.
    """
    return df.withColumn(name, F.explode_outer(F.array(value)))


def row_hash(docs: DataFrame, of: str = "") -> Column:
    """Hash of all columns, of any type; a null in one column is not a null in another."""
    values = []
    for name, kind in docs.dtypes:
        value = F.col(f"{of}`{name}`")
        values += [value.isNull(), F.to_json(value) if "<" in kind else value]
    return F.xxhash64(*values)
