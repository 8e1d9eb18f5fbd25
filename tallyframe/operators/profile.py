"""Column statistics, column roles, data audit, domain detection."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.functions.columns import parse_date
from tallyframe.functions.vocabulary import (
    DATE_HINTS,
    DOMAIN_WORDS,
    IDENTIFIER_ENDINGS,
    IDENTIFIER_NAMES,
    NON_NEGATIVE_HINTS,
    RATE_HINTS,
    TARGET_HINTS,
    UNIQUE_HINTS,
)

# Columns of one aggregate.  Wider tables are read in several aggregates of the
# same formulas, each over its own columns, as generated code grows with its width.
BATCH = 40
WIDE_CATEGORY = 30  # distinct values beyond which the audit calls a category wide
# Relative error of the distinct sketch.  A sketch is 1 / SKETCH^2 registers of
# aggregation buffer for each column; what it can't decide is counted exactly.
SKETCH = 0.05
# Kinds whose distinct values travel as 8 bytes; bytes of them that a task keeps
# before it sends them on, and the most values of one row.
_PACKED = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType)
HELD = 1 << 27
ROW_VALUES = 1024
_ID_END = re.compile(rf"(^|[_\sa-z])({'|'.join(IDENTIFIER_ENDINGS)})s?$", re.IGNORECASE)


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _title(name: str) -> str:
    return "'" + name.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _value_sql(df: DataFrame, name: str) -> str:
    """The column as SQL text, NaN as null."""
    c = _quoted(name)
    fraction = isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType))
    return f"nullif({c}, double('NaN'))" if fraction else c


def _is_number(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def _hint(name: str, words: Sequence[str]) -> bool:
    return any(w in name.lower() for w in words)


def _may_hold_dates(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.StringType) and _hint(name, DATE_HINTS)


def _as_date(name: str) -> str:
    return f"as date {name}".replace("`", "")


def _struct_sql(df: DataFrame, name: str, distinct: str) -> str:
    """Statistics of one column as SQL text: one parse per batch keeps wide tables fast."""
    field = df.schema[name]
    c = _quoted(name)
    kind = field.dataType
    value = _value_sql(df, name)
    # With at most two distinct values, all of them lie in the set when the
    # least and the greatest do; the role test asks for both.
    if isinstance(kind, T.BooleanType):
        yes_no = "true"
    elif _is_number(kind):
        yes_no = f"min({value}) in (0, 1) and max({value}) in (0, 1)"
    elif isinstance(kind, T.StringType):
        words = "('Yes', 'No', 'yes', 'no')"
        yes_no = f"min({value}) in {words} and max({value}) in {words}"
    else:
        yes_no = f"count({value}) = 0"
    dated = _may_hold_dates(df, name)
    signed = _is_number(kind) and _hint(name, NON_NEGATIVE_HINTS)
    parts = {
        "column": _title(name),
        "dtype": f"'{kind.simpleString()}'",
        "n_rows": "count(1)",
        "n_null": f"count(1) - count({value})",
        "n_distinct": f"approx_count_distinct({value}, {SKETCH})" if distinct == "approx" else "cast(null as bigint)",
        # one distinct value exactly when the least equals the greatest
        "constant": f"coalesce(min({value}) = max({value}), false)",
        "boolean_like": f"coalesce({yes_no}, true)",
        "n_negative": f"count_if({c} < 0)" if signed else "0L",
        "n_dates": f"count(`{_as_date(name)}`)" if dated else "0L",
    }
    return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in parts.items()) + ")"


def column_stats(
    df: DataFrame, columns: Sequence[str] | None = None, distinct: str = "approx"
) -> DataFrame:
    """One row of statistics per column.

    Negative values are counted where the name says there should be none, dates
    where the name of a text column suggests dates.

    ``distinct`` is ``approx`` (a sketch of fixed size per column), ``exact``
    (see :func:`exact_distinct`) or ``none``.
    """
    names = list(columns) if columns is not None else df.columns
    if not names:
        return df.sparkSession.createDataFrame([], "column string, n_rows long, n_null long")
    if distinct == "exact" and (numbers := [n for n in names if isinstance(df.schema[n].dataType, _PACKED)]):
        out = _number_stats(df, numbers)
        rest = [n for n in names if n not in set(numbers)]
        return out.unionByName(column_stats(df, rest, "exact")) if rest else out
    if dates := {_as_date(n): parse_date(_q(n)) for n in names if _may_hold_dates(df, n)}:
        df = df.withColumns(dates)
    parts = []
    for at in range(0, len(names), BATCH):
        structs = ", ".join(_struct_sql(df, n, distinct) for n in names[at : at + BATCH])
        parts.append(df.agg(F.expr(f"array({structs})").alias("s")).select(F.inline("s")))
    while len(parts) > 1:  # by halves: each union is analysed with all that it holds
        pairs = [a.unionAll(b) for a, b in zip(parts[::2], parts[1::2], strict=False)]
        parts = pairs + parts[2 * len(pairs) :]
    out = parts[0]
    if distinct == "exact":
        return out.drop("n_distinct").join(exact_distinct(df, names), "column", "left").withColumn(
            "n_distinct", F.coalesce("n_distinct", F.lit(0))
        )
    return out


def exact_distinct(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exact distinct count per column; a column without a value has no row.

    Each value is sent once per map task, keyed by column and value, so neither
    a repeated value nor a wide table ends in one task.  Numbers travel packed,
    many of a column in one row; all other kinds as texts.
    """
    numbers = [c for c in columns if isinstance(df.schema[c].dataType, _PACKED)]
    texts = [c for c in columns if c not in set(numbers)]
    out = None
    if numbers:
        out = _number_stats(df, numbers).filter("n_distinct > 0").select("column", "n_distinct")
    if texts or out is None:
        pairs = ", ".join(
            f"named_struct('column', {_title(c)}, 'v', cast({_value_sql(df, c)} as string))" for c in texts
        )
        values = df.select(F.expr(f"inline(array({pairs}))")).filter("v is not null").distinct()
        counts = values.groupBy("column").agg(F.count("*").alias("n_distinct"))
        out = counts if out is None else out.unionAll(counts)
    return out


def _number_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """:func:`column_stats` with exact distinct counts of columns of numbers, in one pass.

    A task keeps the sorted distinct values of each column and sends them, 8 bytes
    each, when they take over half of ``HELD``.  Their order is that of an
    invertible mix of their bits, whose upper bits deal a column into buckets; each
    bucket is counted by itself.  Bucket -1 has a row for each column and task:
    rows, values, negative values, the least and the greatest value.
    """
    names, held_bytes, row_values = list(columns), HELD, ROW_VALUES
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bits = max(6, (4 * partitions // len(names)).bit_length())
    whole = {True: "double", False: "bigint"}
    kinds = [whole[isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType))] for c in names]

    def packed(batches):
        import numpy as np
        import pyarrow as pa

        held, size, n_rows = [[] for _ in names], 0, 0
        seen = [[0, 0, None, None] for _ in names]
        cuts = np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)

        def merge():
            for c, parts in enumerate(held):
                if len(parts) > 1:
                    held[c] = [np.unique(np.concatenate(parts))]
            return sum(x.nbytes for parts in held for x in parts)

        def rows(found):
            at, bucket, lengths, data = (np.concatenate(x) for x in zip(*found, strict=True))
            ends = np.concatenate([[0], np.cumsum(8 * lengths)]).astype(np.int32)
            blobs = pa.BinaryArray.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(data)])
            return pa.RecordBatch.from_arrays([pa.array(at), pa.array(bucket), blobs], ["at", "bucket", "v"])

        def sent():
            found, n = [], 0
            for c, parts in enumerate(held):
                held[c] = []
                for v in parts:
                    starts = np.concatenate([np.searchsorted(v, cuts), np.arange(0, len(v), row_values)])
                    starts = np.unique(starts[starts < len(v)])
                    lengths = np.diff(np.append(starts, len(v)))
                    bucket = (v[starts] >> np.uint64(64 - bits)).astype(np.int32)
                    found.append((np.full(len(starts), c, np.int32), bucket, lengths, v))
                    n += v.nbytes
                if n > 1 << 22:
                    yield rows(found)
                    found, n = [], 0
            if found:
                yield rows(found)

        for batch in batches:
            n_rows += batch.num_rows
            for c in range(len(names)):
                v = batch.column(c).drop_null().to_numpy(zero_copy_only=False)
                if v.dtype.kind == "f":
                    v = v[~np.isnan(v)]
                if len(v):
                    lo, hi, s = v.min(), v.max(), seen[c]
                    s[:2] = s[0] + len(v), s[1] + int(np.count_nonzero(v < 0)) if lo < 0 else s[1]
                    s[2:] = (lo, hi) if s[2] is None else (min(lo, s[2]), max(hi, s[3]))
                    v = np.ascontiguousarray(v).view(np.uint64)
                    v = np.unique((v ^ (v >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15))
                    held[c].append(v)
                    size += v.nbytes
            if size > held_bytes:
                size = merge()
                if size > held_bytes // 2:
                    yield from sent()
                    size = 0
        merge()
        yield from sent()
        found = []
        for c, (n, negative, lo, hi) in enumerate(seen):
            ends = np.array([lo, hi]).view(np.uint64) if n else np.zeros(2, np.uint64)
            row = np.concatenate([np.array([n_rows, n, negative], np.uint64), ends])
            found.append((np.array([c], np.int32), np.array([-1], np.int32), np.array([5]), row))
        yield rows(found)

    def counted(batches):
        import numpy as np
        import pyarrow as pa

        totals, now, parts, size = {}, None, [], 0

        def close():
            if not parts:
                return
            t = totals.setdefault(now[0], [0, 0, 0, 0, False, False])
            if now[1] >= 0:
                t[0] += len(np.unique(np.concatenate(parts)))
                return
            x = np.concatenate(parts).reshape(-1, 5)
            t[1:4] = (int(x[:, i].sum()) for i in range(3))
            if t[2]:
                ends = x[x[:, 1] > 0, 3:].copy().view(np.float64 if kinds[now[0]] == "double" else np.int64)
                lo, hi = ends[:, 0].min(), ends[:, 1].max()
                t[4:] = bool(lo == hi), bool(lo in (0, 1) and hi in (0, 1))

        for batch in batches:
            at, bucket, v = batch.columns
            if not len(at):
                continue
            at, bucket = at.to_numpy(), bucket.to_numpy()
            ends = np.frombuffer(v.buffers()[1], np.int32)[v.offset : v.offset + len(v) + 1]
            first = np.flatnonzero(np.append(True, (np.diff(at) != 0) | (np.diff(bucket) != 0)))
            for lo, hi in zip(first, np.append(first[1:], len(at)), strict=True):
                if (key := (int(at[lo]), int(bucket[lo]))) != now:
                    close()
                    now, parts, size = key, [], 0
                n = int(ends[hi] - ends[lo])
                parts.append(np.frombuffer(v.buffers()[2], np.uint64, n // 8, int(ends[lo])).copy())
                size += n
                if size > held_bytes and key[1] >= 0:
                    parts = [np.unique(np.concatenate(parts))]
                    size = 0
        close()
        found = list(zip(*totals.values(), strict=True)) or [[]] * 6
        kind = [pa.int64()] * 4 + [pa.bool_()] * 2
        arrays = [pa.array([names[c] for c in totals], pa.string())]
        arrays += [pa.array(x, k) for x, k in zip(found, kind, strict=True)]
        yield pa.RecordBatch.from_arrays(arrays, ["column", "n", "n_rows", "n_values", "n_below", "same", "binary"])

    wide = df.selectExpr(*[f"cast({_quoted(c)} as {k}) as c{i}" for i, (c, k) in enumerate(zip(names, kinds))])
    buckets = wide.mapInArrow(packed, "at int, bucket int, v binary").repartition("at", "bucket")
    parts = buckets.sortWithinPartitions("at", "bucket").mapInArrow(
        counted, "column string, n long, n_rows long, n_values long, n_below long, same boolean, binary boolean"
    )
    sums = [F.sum(c).alias(c) for c in ("n", "n_rows", "n_values", "n_below")]
    found = parts.groupBy("column").agg(*sums, F.max("same").alias("same"), F.max("binary").alias("binary"))
    rows = [(c, df.schema[c].dataType.simpleString(), _hint(c, NON_NEGATIVE_HINTS)) for c in names]
    # a table without partitions has its columns too
    listed = df.sparkSession.createDataFrame(rows, "column string, dtype string, signed boolean")
    zero = F.lit(0).cast("long")
    return listed.join(found, "column", "left").select(
        "column",
        "dtype",
        F.coalesce("n_rows", zero).alias("n_rows"),
        F.coalesce(F.col("n_rows") - F.col("n_values"), zero).alias("n_null"),
        F.coalesce("same", F.lit(False)).alias("constant"),
        F.coalesce(F.col("binary") | (F.col("n_values") == 0), F.lit(True)).alias("boolean_like"),
        F.when(F.col("signed"), F.coalesce("n_below", zero)).otherwise(zero).alias("n_negative"),
        zero.alias("n_dates"),
        F.coalesce("n", zero).alias("n_distinct"),
    )


@dataclass(frozen=True)
class ColumnInfo:
    column: str
    dtype: str
    role: str
    n_rows: int
    n_null: int
    n_distinct: int


class Profile:
    """Roles and statistics of a table; its size is the number of columns."""

    def __init__(self, columns: Sequence[ColumnInfo]):
        self.columns = list(columns)
        self.n_rows = columns[0].n_rows if columns else 0

    def named(self, *roles: str) -> list[str]:
        return [c.column for c in self.columns if c.role in roles]

    @property
    def identifiers(self) -> list[str]:
        return self.named("identifier")

    @property
    def numerics(self) -> list[str]:
        """Targets and rates are numeric columns too."""
        return self.named("numeric", "target", "kpi")

    @property
    def dates(self) -> list[str]:
        return self.named("date")

    @property
    def categoricals(self) -> list[str]:
        return self.named("categorical")

    @property
    def booleans(self) -> list[str]:
        return self.named("boolean")


def named_like_identifier(name: str) -> bool:
    bare = re.sub("[^a-z0-9]", "", name.lower())
    return bare in IDENTIFIER_NAMES or bool(_ID_END.search(name.strip()))


def _near(estimate: int, threshold: float) -> bool:
    """Within fifteen standard errors of the sketch: beyond, a rule can't come out otherwise."""
    return abs(estimate - threshold) <= 15 * SKETCH * max(threshold, estimate) + 1


def _thresholds(name: str, kind: T.DataType, s: Mapping) -> list[float]:
    """The distinct counts at which a rule about this column turns."""
    n = s["n_rows"]
    if named_like_identifier(name) or not isinstance(kind, (T.StringType, T.IntegralType)):
        return []
    out: list[float] = []
    if s["boolean_like"]:
        out.append(2)
    if any(h in re.sub("[^a-z0-9]", "", name.lower()) for h in UNIQUE_HINTS):
        out.append(n)
    if isinstance(kind, T.StringType):
        out += [WIDE_CATEGORY, max(n / 2, 50)]
    return out


def _role(name: str, kind: T.DataType, s: Mapping, n_distinct: int) -> str:
    n = s["n_rows"]
    bare = re.sub("[^a-z0-9]", "", name.lower())
    if named_like_identifier(name):
        return "identifier"
    keyable = isinstance(kind, (T.StringType, T.IntegralType))
    if n > 1 and n_distinct == n and keyable and any(h in bare for h in UNIQUE_HINTS):
        return "identifier"
    if isinstance(kind, T.BooleanType) or (n > 0 and s["boolean_like"] and n_distinct <= 2):
        return "boolean"
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "date"
    values = n - s["n_null"]
    if values and s["n_dates"] / values > 0.8:
        return "date"
    if _is_number(kind):
        if _hint(name, TARGET_HINTS):
            return "target"
        return "kpi" if _hint(name, RATE_HINTS) else "numeric"
    return "categorical" if n_distinct / max(n, 1) < 0.5 or n_distinct <= 50 else "text"


def profile(df: DataFrame) -> Profile:
    """Classify the columns.  Runs one aggregate, and a second, exact count only
    for text or key columns whose estimate is close to a threshold."""
    if not df.columns:
        return Profile([])
    stats = {r["column"]: r.asDict() for r in column_stats(df).collect()}
    n = next(iter(stats.values()))["n_rows"]
    unsure = [
        c for c, s in stats.items()
        if any(_near(s["n_distinct"], t) for t in _thresholds(c, df.schema[c].dataType, s))
    ]
    counts = {c: s["n_distinct"] for c, s in stats.items()}
    if unsure:
        counts |= {r["column"]: r["n_distinct"] for r in exact_distinct(df, unsure).collect()}
    return Profile(
        [
            ColumnInfo(
                c,
                stats[c]["dtype"],
                _role(c, df.schema[c].dataType, stats[c], counts[c]),
                n,
                stats[c]["n_null"],
                counts[c],
            )
            for c in df.columns
        ]
    )


def roles(df: DataFrame) -> DataFrame:
    """One row per column with its role."""
    rows = [(i, c.column, c.dtype, c.role) for i, c in enumerate(profile(df).columns)]
    return df.sparkSession.createDataFrame(
        rows, "position long, column string, dtype string, role string"
    )


def duplicate_rows(df: DataFrame) -> DataFrame:
    """One row: how many rows repeat an earlier one (nulls are equal).

    Rows travel as two independent 64-bit hashes plus a null mask, not whole.
    """
    cols = [_q(c) for c in df.columns]
    mask = [c.isNull() for c in cols]
    rows = df.select(
        F.xxhash64(*cols, *mask).alias("a"), F.xxhash64(F.lit("second"), *mask, *cols).alias("b")
    )
    # equal rows meet on the map side first
    return (
        rows.groupBy("a", "b")
        .agg(F.count("*").alias("c"))
        .agg(F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("duplicate_rows"))
    )


def duplicate_ids(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows per identifier column whose value was seen before; null counts once as a value."""
    pairs = F.array(
        *[F.struct(F.lit(c).alias("column"), _q(c).cast("string").alias("v")) for c in columns]
    )
    return (
        df.select(F.inline(pairs))
        .groupBy("column", "v")
        .agg(F.count("*").alias("c"))
        .groupBy("column")
        .agg(F.sum(F.col("c") - 1).alias("duplicates"))
    )


def negatives(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Columns that should not be negative, with the number of negative values."""
    names = [
        c
        for c in (columns or df.columns)
        if _is_number(df.schema[c].dataType) and _hint(c, NON_NEGATIVE_HINTS)
    ]
    stats = column_stats(df, names, distinct="none")
    return stats.select("column", "n_negative").filter(F.col("n_negative") > 0)


def audit(df: DataFrame, info: Profile | None = None) -> DataFrame:
    """The audit as ``(metric, value)`` rows.

    missing_values, missing_columns, duplicate_rows, constant_columns,
    high_cardinality_columns and quality_score.
    """
    info = info or profile(df)
    wide = [c.column for c in info.columns if c.role == "categorical" and c.n_distinct > WIDE_CATEGORY]
    stats = column_stats(df, distinct="none").agg(
        F.sum("n_null").alias("missing_values"),
        F.count_if(F.col("n_null") > 0).alias("missing_columns"),
        F.count_if("constant").alias("constant_columns"),
    )
    row = stats.withColumn("duplicate_rows", duplicate_rows(df).scalar())
    score = F.greatest(
        F.lit(0.0), 100.0 - F.col("missing_columns") * 5.0 - F.col("duplicate_rows") * 2.0
    )
    row = row.withColumn("high_cardinality_columns", F.lit(len(wide))).withColumn(
        "quality_score", score
    )
    names = ["missing_values", "missing_columns", "duplicate_rows", "constant_columns",
             "high_cardinality_columns", "quality_score"]
    return row.select(*[F.col(c).cast("double").alias(c) for c in names]).unpivot(
        [], names, "metric", "value"
    )


def domain_scores(headers: DataFrame, samples: DataFrame | None = None) -> DataFrame:
    """Score every domain for every table of a catalog.

    ``headers`` has ``table_id, header``; ``samples`` (optional) has
    ``table_id, column, value``, values of text columns, as many as there are.  A
    word found in some header of the table counts 2, a word found in a value of a
    column counts 1.  The words are literals of the expression: one pass over
    the headers, no join.
    """

    def found(text: Column) -> Column:
        hits = []
        for domain, words in DOMAIN_WORDS.items():
            for w in words:
                hits.append(
                    F.when(
                        F.contains(text, F.lit(w)),
                        F.struct(F.lit(domain).alias("domain"), F.lit(w).alias("word")),
                    )
                )
        return F.inline(F.filter(F.array(*hits), lambda x: x.isNotNull()))

    named = headers.select("table_id", found(F.lower("header"))).distinct()
    points = named.select("table_id", "domain", F.lit(2).alias("points"))
    if samples is not None:
        seen = samples.select("table_id", "column", found(F.lower("value"))).distinct()
        points = points.unionAll(seen.select("table_id", "domain", F.lit(1).alias("points")))
    return points.groupBy("table_id", "domain").agg(F.sum("points").alias("score"))


def detect_domains(headers: DataFrame, samples: DataFrame | None = None) -> DataFrame:
    """Best domain per table, up to two runners-up and a confidence.

    A tie goes to the domain listed first.  A table without a hit is
    ``General Analytics`` with confidence 0.5.
    """
    order = F.array_position(F.array(*[F.lit(d) for d in DOMAIN_WORDS]), F.col("domain"))
    scored = domain_scores(headers, samples).withColumn("place", order)
    w = Window.partitionBy("table_id").orderBy(F.col("score").desc(), "place")
    ranked = scored.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= 3)
    share = F.round(F.col("best") / 10.0, 2)
    confidence = F.when(share < 0.4, 0.55).otherwise(F.least(share, F.lit(0.99)))
    per_table = ranked.groupBy("table_id").agg(
        F.max(F.when(F.col("n") == 1, F.col("domain"))).alias("primary_domain"),
        F.max(F.when((F.col("n") == 2) & (F.col("score") >= 2), F.col("domain"))).alias("second"),
        F.max(F.when((F.col("n") == 3) & (F.col("score") >= 2), F.col("domain"))).alias("third"),
        F.max("score").alias("best"),
    )
    tables = headers.select("table_id").distinct()
    return tables.join(per_table, "table_id", "left").select(
        "table_id",
        F.coalesce("primary_domain", F.lit("General Analytics")).alias("primary_domain"),
        F.concat_ws(", ", "second", "third").alias("secondary_domains"),
        F.when(F.col("best").isNull(), 0.5).otherwise(confidence).alias("confidence"),
    )
