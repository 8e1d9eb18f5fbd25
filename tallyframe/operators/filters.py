"""Row filters, search, paging."""

from __future__ import annotations

import datetime as dt
import operator
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.functions.columns import as_text

COMPARE = {
    ">": operator.gt,
    "<": operator.lt,
    ">=": operator.ge,
    "<=": operator.le,
}


def equals(df: DataFrame, column: str, value: object) -> Column:
    """Equality: numbers by value, anything else trimmed and case-insensitive."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.NumericType) and isinstance(value, (int, float)):
        return F.col(column) == F.lit(value)
    return as_text(column) == str(value).strip().lower()


def differs(df: DataFrame, column: str, value: object) -> Column:
    """Inequality that keeps nulls."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.NumericType) and isinstance(value, (int, float)):
        return ~F.col(column).eqNullSafe(F.lit(value))
    return ~as_text(column).eqNullSafe(str(value).strip().lower())


def _bound(df: DataFrame, column: str, value: object) -> Column:
    """The literal in the column's own type, so that the scan can use it."""
    kind = df.schema[column].dataType
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        if isinstance(value, str):
            value = dt.date.fromisoformat(value[:10])
        return F.lit(value).cast(kind)
    return F.lit(value)


def condition(df: DataFrame, column: str, op: str, value: object) -> Column:
    """One predicate.  An unknown column or operator is an error, never ignored."""
    if column not in df.columns:
        raise ValueError(f"no column {column!r}; there are {', '.join(df.columns)}")
    if op == "==":
        return equals(df, column, value)
    if op == "!=":
        return differs(df, column, value)
    if op in COMPARE:
        return COMPARE[op](F.col(column), _bound(df, column, value))
    raise ValueError(f"unknown comparison {op!r}")


def where_all(df: DataFrame, filters: Iterable[tuple[str, str, object]]) -> DataFrame:
    """Keep rows that meet every ``(column, op, value)``."""
    tests = [condition(df, c, op, v) for c, op, v in filters]
    return df.filter(reduce(operator.and_, tests)) if tests else df


def after_date(df: DataFrame, column: str, day: str) -> DataFrame:
    """Rows on a later day than ``day``.

    Written as a bound on the bare column (from the next midnight on), so the
    predicate reaches the scan.
    """
    following = dt.date.fromisoformat(day) + dt.timedelta(days=1)
    return df.filter(F.col(column) >= _bound(df, column, following.isoformat()))


def between_dates(
    df: DataFrame, column: str, start: str | None = None, end: str | None = None
) -> DataFrame:
    """Inclusive range of days; either bound may be left open."""
    if start:
        df = df.filter(F.col(column) >= _bound(df, column, start))
    if end:
        following = dt.date.fromisoformat(end[:10]) + dt.timedelta(days=1)
        df = df.filter(F.col(column) < _bound(df, column, following.isoformat()))
    return df


def search_any(df: DataFrame, text: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows where some column, as text, holds ``text`` (case-insensitive)."""
    cols = columns or df.columns
    joined = F.concat_ws("\u0001", *[F.col(c).cast("string") for c in cols])
    return df.filter(F.contains(F.lower(joined), F.lit(text.lower())))


def page(df: DataFrame, order: Sequence[str | Column], number: int, size: int) -> DataFrame:
    """Page ``number`` (from 1) of ``size`` rows in a total order."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def page_after(df: DataFrame, key: str, last: object | None, size: int) -> DataFrame:
    """Next page by key: cost does not grow with the page number."""
    if last is not None:
        df = df.filter(F.col(key) > _bound(df, key, last))
    return df.orderBy(key).limit(size)


def sort_rows(df: DataFrame, *order: str | Column) -> DataFrame:
    return df.orderBy(*order)


def preview(df: DataFrame, order: Sequence[str | Column], n: int = 100) -> DataFrame:
    """First ``n`` rows as text, nulls shown as empty."""
    head = df.orderBy(*order).limit(n)
    return head.select(
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns]
    )
