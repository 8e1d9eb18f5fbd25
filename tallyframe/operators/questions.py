"""Tagging a log of questions: intent, slots, follow-ups, session context."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions.columns import col
from tallyframe.functions.vocabulary import (
    ABSENT_CONCEPTS,
    FOLLOW_UP_WORDS,
    KPI_PHRASES,
    KPI_WORDS,
    PER_GROUP_PHRASES,
    QUESTION_OPERATIONS,
)
from tallyframe.operators.matching import match_columns
from tallyframe.session import staged

# --- fixed values -----------------------------------------------------------
# An operation and the words that call for it: one of each group must occur.
# The first line that fits decides.
INTENTS: tuple[tuple[str, tuple[tuple[str, ...], ...]], ...] = (
    ("data_quality", (("quality", "missing", "duplicate", "null", "audit", "health"),)),
    ("top_n_contribution", (("percentage of total",),)),
    ("top_n_contribution", (("percentage",), ("top",))),
    ("extreme_combination", (("more than the average", "above average"), ("profit margin",))),
    ("above_average_filter", (("more than the average", "above average"),)),
    ("difference_between_groups", (("compare",), ("between", "difference"))),
    ("actual_vs_target", (("target",),)),
    ("return_rate", (("return rate",),)),
    ("cancellation_rate", (("cancellation rate",),)),
    ("delivery_rate", (("delivery rate",),)),
    ("profit_margin", (("margin",),)),
    ("distribution_analysis", (("distribution", "skew"),)),
    ("monthly_trend", (("monthly",), ("trend",))),
    ("yearly_trend", (("yearly",), ("trend",))),
    ("year_over_year", (("year over year", "yoy"),)),
    ("growth_rate", (("growth",),)),
    ("moving_average", (("moving average",),)),
    ("cumulative_total", (("cumulative",),)),
    ("variance", (("variance",),)),
    ("std", (("standard deviation", "std"),)),
    ("percentile", (("percentile", "quantile"),)),
    ("correlation", (("correlation",),)),
    ("covariance", (("covariance",),)),
    ("outlier_detection", (("outlier",),)),
    ("average_order_value", (("average order value", "aov"),)),
    ("ratio", (("ratio",),)),
    ("percentage_difference", (("percentage",), ("difference",))),
    ("difference", (("difference", "subtraction"),)),
    ("percentage_contribution", (("contribution",), ("percentage", "revenue", "%"))),
    ("bottom_n", (("bottom", "lowest", "least"),)),
    ("top_n", (("top", "highest", "best"),)),
    ("mean", (("average", "avg", "mean"),)),
    ("median", (("median", "middle"),)),
    ("max", (("max",),)),
    ("min", (("min", "worst"),)),
    ("count", (("count", "how many", "number of"),)),
    ("distinct_values", (("unique", "distinct"),)),
)
TOP_PATTERN = r"\b(?:top|bottom|first|last)\s+(\d+)\b"
PERCENTILE_PATTERN = r"(\d+)(?:th|st|nd|rd)?\s*(?:percentile|quantile)"
AFTER_PATTERN = r"(?:after|since|>)\s*(\d{4}-\d{2}-\d{2})"
GROUP_PATTERN = r"(?:by|per|across|for each)\s+([a-zA-Z0-9_\s]+)"
CONTAINER_PATTERN = r"(?:inside|within|in|for|per)\s+(?:each|every)\s+([a-zA-Z0-9_\s]+)"
# ----------------------------------------------------------------------------


def holds_any(c: Column, words: Sequence[str]) -> Column:
    return reduce(or_, [F.contains(c, F.lit(w)) for w in words])


def _first_that_fits(tests: Sequence[tuple[Column, str]], default: str) -> Column:
    return F.coalesce(*[F.when(test, name) for test, name in tests], F.lit(default))


def operation(text: str | Column) -> Column:
    """One of six plain statistics; sum where no word fits."""
    q = F.lower(col(text))
    tests = [(holds_any(q, words), name) for name, words in QUESTION_OPERATIONS.items()]
    return _first_that_fits(tests, "sum")


def intent(text: str | Column) -> Column:
    """The operation asked for, out of all; sum where no word fits."""
    q = F.lower(col(text))
    tests = [(reduce(and_, [holds_any(q, g) for g in groups]), name) for name, groups in INTENTS]
    return _first_that_fits(tests, "sum")


def asks_for_kpis(text: str | Column) -> Column:
    q = F.lower(col(text))
    return holds_any(q, KPI_PHRASES) & holds_any(q, KPI_WORDS)


def words_of(text: str | Column) -> Column:
    bare = F.regexp_replace(F.lower(col(text)), r"^\s+|\s+$", "")
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"\s+"))


def is_follow_up(text: str | Column) -> Column:
    return F.arrays_overlap(words_of(text), F.array(*[F.lit(w) for w in FOLLOW_UP_WORDS]))


def per_group(text: str | Column) -> Column:
    return holds_any(F.lower(col(text)), PER_GROUP_PHRASES)


def _slot(text: str | Column, pattern: str) -> Column:
    return F.nullif(F.trim(F.regexp_extract(F.lower(col(text)), pattern, 1)), F.lit(""))


def slots(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds limit, percentile, date bound, group phrase, container and the per-group flag."""
    return df.withColumns(
        {
            "top": _slot(text, TOP_PATTERN).try_cast("long"),
            "percentile": _slot(text, PERCENTILE_PATTERN).try_cast("long"),
            "after": _slot(text, AFTER_PATTERN),
            "group_term": _slot(text, GROUP_PATTERN),
            "container": _slot(text, CONTAINER_PATTERN),
            "per_group": per_group(text),
        }
    )


def ngrams(df: DataFrame, text: str = "text", sizes: Sequence[int] = (3, 2, 1)) -> DataFrame:
    """One row per run of one to three words: the other columns, ``n``, ``position``, ``phrase``."""
    keep = [c for c in df.columns if c != text]
    words = df.select(*keep, words_of(text).alias("_w")).filter(F.size("_w") > 0)

    def runs(n: int) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.size("_w")), lambda i: i <= F.size("_w") - (n - 1))
        return F.transform(
            starts,
            lambda i: F.struct(
                F.lit(n).alias("n"),
                i.alias("position"),
                F.array_join(F.slice("_w", i, n), " ").alias("phrase"),
            ),
        )

    return words.select(*keep, F.inline(F.concat(*[runs(n) for n in sizes])))


def last_turns(
    log: DataFrame, session: str = "session_id", turn: str = "turn", text: str = "text", n: int = 5
) -> DataFrame:
    """The last ``n`` turns of every session as one text, oldest first.

    Spark keeps ``n`` rows per session and map task, so a session that holds a
    large part of the log does not travel to one task.
    """
    w = Window.partitionBy(session).orderBy(F.col(turn).desc())
    last = log.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n)
    parts = F.sort_array(F.collect_list(F.struct(F.col(turn).alias("t"), F.col(text).alias("x"))))
    return last.groupBy(session).agg(
        F.count("*").alias("n_turns"),
        F.array_join(F.transform(parts, lambda p: p["x"]), "\n---\n").alias("context"),
    )


def carry_entity(
    log: DataFrame,
    session: str = "session_id",
    turn: str = "turn",
    text: str = "text",
    entity: str = "entity",
    n: int = 5,
) -> DataFrame:
    """Adds ``follow_up`` and, for follow-ups, the newest entity of the ``n`` turns before.

    Each entity is handed on to the turns that may use it, and both meet on
    session and turn: a long session is spread over its turns.
    """
    handed = (
        log.filter(F.col(entity).isNotNull())
        .select(
            session,
            F.col(turn).alias("_from"),
            F.col(entity).alias("_e"),
            F.explode(F.sequence(F.col(turn) + 1, F.col(turn) + n)).alias(turn),
        )
        .groupBy(session, turn)
        .agg(F.max_by("_e", "_from").alias("_e"))
    )
    follow = is_follow_up(text)
    return (
        log.withColumn("follow_up", follow)
        .join(handed, [session, turn], "left")
        .withColumn("carried_entity", F.when(F.col("follow_up"), F.col("_e")))
        .drop("_e")
    )


def missing_concepts(
    log: DataFrame, headers: DataFrame, key: Sequence[str], text: str = "text",
    terms: Sequence[str] = ABSENT_CONCEPTS,
) -> DataFrame:
    """Questions that name a concept for which their table has no column.

    ``log`` has the key columns, ``table_id`` and the text.
    """
    q = F.lower(col(text))
    hits = F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(q, t))
    asked = log.select(*key, "table_id", F.explode(hits).alias("term"))
    # the matching reads its requests several times, the texts need not be
    wanted = staged(asked.select("table_id", "term").distinct())
    known = match_columns(wanted, headers).select("table_id", "term")
    return asked.join(known, ["table_id", "term"], "left_anti")
