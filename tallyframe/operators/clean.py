"""Cleaning: dedupe, null tokens, numbers, dates, order of dates, imputation, score."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.functions.columns import needs_sanitizing, null_if_token, parse_date, parse_number
from tallyframe.functions.quantiles import exact_quantiles
from tallyframe.functions.vocabulary import ZERO_FILL_HINTS
from tallyframe.operators.profile import Profile, profile
from tallyframe.session import scratch_path


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def _texts(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def _replace(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    return df.select(*[new.get(c, _q(c)).alias(c) for c in df.columns])


def dedupe(df: DataFrame) -> DataFrame:
    """One copy of every row; nulls are equal."""
    return df.dropDuplicates()


def null_tokens(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Trim text columns and turn null spellings into NULL."""
    return _replace(df, {c: null_if_token(_q(c)) for c in (columns or _texts(df))})


def numeric_text_columns(
    df: DataFrame, skip: Sequence[str] = (), ratio: float = 0.7, any_rule: bool = False
) -> list[str]:
    """Text columns whose values are mostly numbers.  One small aggregate runs.

    ``any_rule`` also takes a column with a single sanitised value, at the price
    of losing its other texts.
    """
    names = [c for c in _texts(df) if c not in skip]
    if not names:
        return []
    aggs = []
    for c in names:
        share = F.avg(F.when(_q(c).isNotNull(), parse_number(_q(c)).isNotNull().cast("int")))
        hit = F.coalesce(share >= ratio, F.lit(False))
        if any_rule:
            hit = hit | (F.count_if(needs_sanitizing(_q(c))) > 0)
        aggs.append(hit.alias(c))
    row = df.agg(*aggs).first()
    return [c for c in names if row[c]]


def to_numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return _replace(df, {c: parse_number(_q(c)) for c in columns})


def to_dates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    new = {}
    for c in columns:
        is_text = isinstance(df.schema[c].dataType, T.StringType)
        new[c] = parse_date(_q(c)) if is_text else F.to_date(_q(c))
    return _replace(df, new)


def invalid_dates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per text column the number of values that are no date."""
    counts = [
        F.count_if(_q(c).isNotNull() & parse_date(_q(c)).isNull()).alias(c) for c in columns
    ]
    return df.agg(*counts).unpivot([], list(columns), "column", "invalid_dates")


def date_pairs(columns: Sequence[str]) -> list[tuple[str, str]]:
    """order <= delivery <= return, for the columns that are there."""
    found = [next((c for c in columns if word in c.lower()), None)
             for word in ("order", "deliv", "return")]
    return [(a, b) for a, b in zip(found, found[1:]) if a and b]


def chronology(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Per pair the number of rows whose first date is after the second."""
    entries = [
        F.struct(
            F.lit(a).alias("earlier"),
            F.lit(b).alias("later"),
            F.count_if(_q(a) > _q(b)).alias("anomalies"),
        )
        for a, b in pairs
    ]
    return df.agg(F.array(*entries).alias("p")).select(F.inline("p"))


def _fill_kind(df: DataFrame, c: str, dates: Sequence[str]) -> str:
    kind = df.schema[c].dataType
    if c in dates or isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "keep"
    if isinstance(kind, T.NumericType):
        return "zero" if any(h in c.lower() for h in ZERO_FILL_HINTS) else "median"
    if isinstance(kind, T.BooleanType):
        return "false"
    return "unknown"


def medians(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row with a map column -> median (2 decimals) of the named columns."""
    pairs = F.array(
        *[F.struct(F.lit(c).alias("c"), _q(c).cast("double").alias("v")) for c in columns]
    )
    q = exact_quantiles(df.select(F.inline(pairs)), "v", [0.5], ["c"])
    # one entry per column of the table
    return q.agg(
        F.map_from_entries(F.collect_list(F.struct("c", F.round(F.col("q")[0], 2)))).alias("m")
    )


def impute(
    df: DataFrame, dates: Sequence[str] = (), with_nulls: Sequence[str] | None = None
) -> DataFrame:
    """Fill nulls: 0 for amounts that may be absent, the median for other
    numbers, ``Unknown`` for text, false for flags.  Dates stay null.

    ``with_nulls`` names the columns known to have nulls; medians are computed
    for those only.
    """
    names = df.columns if with_nulls is None else list(with_nulls)
    kinds = {c: _fill_kind(df, c, dates) for c in names}
    need = [c for c, k in kinds.items() if k == "median"]
    out = df
    if need:
        out = df.withColumn("_medians", medians(df, need).scalar())
    new: dict[str, Column] = {}
    for c, k in kinds.items():
        kind = df.schema[c].dataType
        if k == "zero":
            new[c] = F.coalesce(_q(c), F.lit(0).cast(kind))
        elif k == "median":
            middle = F.coalesce(F.try_element_at("_medians", F.lit(c)), F.lit(0.0))
            new[c] = F.coalesce(_q(c).cast("double"), middle)
        elif k == "unknown":
            new[c] = F.coalesce(_q(c), F.lit("Unknown"))
        elif k == "false":
            new[c] = F.coalesce(_q(c), F.lit(False))
    return out.select(*[new.get(c, _q(c)).alias(c) for c in df.columns])


@dataclass
class Plan:
    """What the cleaner does to a table; sized by its number of columns."""

    dates: list[str] = field(default_factory=list)
    numbers: list[str] = field(default_factory=list)
    pairs: list[tuple[str, str]] = field(default_factory=list)
    nulls: list[str] = field(default_factory=list)


def plan_cleaning(df: DataFrame, info: Profile | None = None, any_rule: bool = False) -> Plan:
    info = info or profile(df)
    dates = [c for c in info.dates if c in df.columns]
    skip = [*info.identifiers, *dates]
    numbers = numeric_text_columns(null_tokens(df), skip, any_rule=any_rule)
    # text columns may gain nulls in the steps before imputation
    nulls = [c.column for c in info.columns if c.n_null or c.column in _texts(df)]
    return Plan(dates, numbers, date_pairs(dates), nulls)


def _typed(df: DataFrame, plan: Plan) -> tuple[DataFrame, DataFrame]:
    """The table after null tokens, and after numbers and dates on top."""
    texts = null_tokens(dedupe(df))
    return texts, to_dates(to_numbers(texts, plan.numbers), plan.dates)


def clean(df: DataFrame, plan: Plan | None = None) -> DataFrame:
    """The whole pipeline.

    The medians need the deduplicated rows before those rows can be filled.
    The table is therefore written once, below the shared folder, instead of
    being deduplicated again for every use; the medians then read their columns
    alone.
    """
    plan = plan or plan_cleaning(df)
    typed = _typed(df, plan)[1]
    if any(_fill_kind(typed, c, plan.dates) == "median" for c in plan.nulls):
        path = scratch_path(df.sparkSession, "typed")
        typed.write.parquet(path)
        typed = df.sparkSession.read.schema(typed.schema).parquet(path)
    return impute(typed, plan.dates, plan.nulls)


def _sum(counts: Sequence[Column]) -> Column:
    total: Column = F.lit(0)
    for c in counts:
        total = total + c
    return total.cast("long")


def quality_score(n_rows: Column, n_cols: int, problems: Column) -> Column:
    cells = F.greatest(n_rows * n_cols, F.lit(1)).cast("double")
    return F.greatest(
        F.lit(0.0), F.least(F.lit(100.0), F.round(100.0 - problems / cells * 100.0, 1))
    )


def quality_report(df: DataFrame, plan: Plan | None = None) -> DataFrame:
    """Counts before and after cleaning and the score, as ``(metric, value)``.

    One pass: each kind of row knows how often it occurs and its nulls, so the
    deduplicated rows tell the counts of the raw ones, too.
    """
    plan = plan or plan_cleaning(df)
    longest = max(map(len, df.columns))
    copies, missing = (f"{name}{'_' * longest}" for name in ("copies", "missing"))  # no column is called so
    kinds = df.groupBy(*[_q(c).alias(c) for c in df.columns]).agg(F.count(F.lit(1)).alias(copies))
    nulls: Column = F.lit(0)
    for c in df.columns:
        nulls = nulls + _q(c).isNull().cast("int")
    texts = null_tokens(kinds.withColumn(missing, nulls), _texts(df))
    # both states side by side, so that one pass over the deduplicated rows counts all
    both = to_dates(
        to_numbers(
            texts.select("*", *[_q(c).alias(f"raw {c}") for c in [*plan.numbers, *plan.dates]]),
            plan.numbers,
        ),
        plan.dates,
    )
    zero = F.lit(0).cast("long")
    n = len(df.columns)
    row = both.agg(
        F.coalesce(F.sum(copies), zero).alias("rows_before"),
        F.coalesce(F.sum(F.col(copies) * F.col(missing)), zero).alias("missing_before"),
        F.coalesce(F.sum(F.col(copies) - 1), zero).alias("duplicates_removed"),
        F.count(F.lit(1)).alias("rows_after"),
        _sum([F.count_if(_q(c).isNull()) for c in df.columns]).alias("missing_values_fixed"),
        _sum(
            [F.count_if(_q(c).isNull() & _q(f"raw {c}").isNotNull()) for c in plan.dates]
        ).alias("invalid_dates"),
        _sum([F.count_if(needs_sanitizing(_q(f"raw {c}"))) for c in plan.numbers]).alias(
            "numbers_sanitized"
        ),
        _sum([F.count_if(_q(a) > _q(b)) for a, b in plan.pairs]).alias("chronology_anomalies"),
    )
    problems = (
        F.col("missing_before")
        + F.col("duplicates_removed") * n
        + F.col("invalid_dates")
        + F.col("numbers_sanitized")
        + F.col("chronology_anomalies")
    )
    row = row.withColumn("quality_score", quality_score(F.col("rows_before"), n, problems))
    return row.select(*[F.col(c).cast("double").alias(c) for c in row.columns]).unpivot(
        [], row.columns, "metric", "value"
    )


def column_actions(df: DataFrame, plan: Plan | None = None) -> DataFrame:
    """Per column: nulls before imputation, nulls left, and what was done."""
    plan = plan or plan_cleaning(df)
    typed = _typed(df, plan)[1]
    rows = typed.agg(
        F.array(
            *[
                F.struct(
                    F.lit(c).alias("column"),
                    F.lit(typed.schema[c].dataType.simpleString()).alias("dtype"),
                    F.lit(_fill_kind(typed, c, plan.dates)).alias("fill"),
                    F.count_if(_q(c).isNull()).alias("missing_before"),
                )
                for c in typed.columns
            ]
        ).alias("s")
    ).select(F.inline("s"))
    kept = F.col("fill") == "keep"
    action = (
        F.when(F.col("missing_before") == 0, "clean")
        .when(kept, "preserved")
        .when(F.col("fill") == "zero", "filled with 0")
        .when(F.col("fill") == "median", "filled with median")
        .when(F.col("fill") == "false", "filled with false")
        .otherwise("filled with Unknown")
    )
    return rows.select(
        "column",
        "dtype",
        "missing_before",
        F.when(kept, F.col("missing_before")).otherwise(0).alias("missing_after"),
        action.alias("action"),
    )
