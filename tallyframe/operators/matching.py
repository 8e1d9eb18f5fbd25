"""Matching wanted terms to the column names of many tables.

Five tiers, the first that hits wins: same text, same letters and digits,
synonym (same, or one inside the other), substring, and similar spelling.
Containment and similarity run as equi-joins on pieces or letters of the names, so
terms and names of a table are never paired off one by one.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.functions.columns import squash
from tallyframe.functions.vocabulary import SYNONYMS
from tallyframe.session import staged

CUTOFF = 0.60
_RARE_FIRST = "9876543210zqxjkvbpygfwmucldrhsnioate"
MIN_SYNONYM = 4
MIN_TERM = 3


def synonym_table(
    spark: SparkSession, synonyms: Mapping[str, Sequence[str]] = SYNONYMS
) -> DataFrame:
    """``norm, prio, syn``: for each word the names to look for, best first."""

    def bare(s: str) -> str:
        return re.sub("[^a-z0-9]", "", s.lower())

    rows = set()
    for c, (concept, words) in enumerate(synonyms.items()):
        for term in {bare(concept), *map(bare, words)}:
            rows |= {(term, c * 100 + i, bare(w)) for i, w in enumerate(words)}
    return spark.createDataFrame(sorted(rows), "norm string, prio int, syn string")


def _grams(c: str | Column, n: int) -> Column:
    """Distinct substrings of length ``n``."""
    c = F.col(c) if isinstance(c, str) else c
    starts = F.sequence(F.lit(1), F.greatest(F.length(c) - (n - 1), F.lit(1)))
    pieces = F.transform(starts, lambda i: F.substring(c, i, F.lit(n)))
    return F.array_distinct(F.filter(pieces, lambda x: F.length(x) == n))


def _apart(df: DataFrame) -> DataFrame:
    """``df`` as a side of a sort-merge join.

    Sizes known before a run come from compressed files and take no account of exploded
    rows, so by them a whole catalog of names could be sent through the driver.
    """
    return df.hint("merge")


def _prepared(headers: DataFrame) -> DataFrame:
    return headers.select(
        "table_id",
        F.col("position").cast("long").alias("position"),
        "header",
        F.lower(F.trim("header")).alias("low"),
        squash("header").alias("norm"),
    )


def _spelled(names: DataFrame, spelling: str) -> DataFrame:
    """Once per table and spelling: the ``first`` and the ``last`` header that has it."""
    return names.groupBy("table_id", spelling).agg(
        F.min(F.struct("position", "header")).alias("first"),
        F.min(F.struct((-F.col("position")).alias("back"), "header")).alias("last"),
    )


def _named_matches(requests: DataFrame, names: DataFrame) -> DataFrame:
    """Candidates of tiers 1 to 4 with the order in which they are preferred."""
    terms = requests.select("table_id", "term", F.lower(F.trim("term")).alias("low"),
                            squash("term").alias("norm"))
    none = F.lit(0)
    same = terms.select("table_id", "term", F.lit(1).alias("tier"), none.alias("prio"),
                        F.col("low").alias("text"))
    letters = terms.filter("norm <> ''").select(
        "table_id", "term", F.lit(2).alias("tier"), none.alias("prio"), F.col("norm").alias("text")
    )
    dictionary = F.broadcast(synonym_table(requests.sparkSession))  # fixed, under 2,000 rows
    synonyms = terms.join(dictionary, "norm").select(
        "table_id", "term", F.lit(3).alias("tier"), "prio", F.col("syn").alias("text")
    )
    columns = ["table_id", "term", "tier", "prio"]
    exact = (
        same.withColumnRenamed("text", "low")
        .join(_apart(_spelled(names, "low")), ["table_id", "low"])
        .select(*columns, none.alias("part"), F.col("first.position").alias("place"), "first.header")
    )
    filled = _spelled(names.filter("norm <> ''"), "norm")
    by_letters = letters.unionByName(synonyms)
    # of several names with the same letters the last one counts
    exact_letters = (
        by_letters.withColumnRenamed("text", "norm")
        .join(_apart(filled), ["table_id", "norm"])
        .select(*columns, none.alias("part"), F.col("last.back").alias("place"), "last.header")
    )
    inside = synonyms.filter(F.length("text") >= MIN_SYNONYM).unionByName(
        letters.filter(F.length("text") >= MIN_TERM).withColumn("tier", F.lit(4))
    )
    # the wanted text inside the name: its first three letters are a piece of the name
    a = inside.withColumn("gram", F.substring("text", 1, 3))
    b = filled.withColumn("gram", F.explode(_grams("norm", 3)))
    within = a.join(_apart(b), ["table_id", "gram"]).filter(F.contains("norm", "text"))
    # the name inside the wanted text: the other way round, names may be shorter
    a = inside.withColumn(
        "gram", F.explode(F.concat(_grams("text", 1), _grams("text", 2), _grams("text", 3)))
    )
    b = filled.withColumn("gram", F.substring("norm", 1, 3))
    around = a.join(_apart(b), ["table_id", "gram"]).filter(F.contains("text", "norm"))
    partial = within.unionByName(around).select(
        *columns, F.lit(1).alias("part"), F.col("first.position").alias("place"), "first.header"
    )
    return exact.unionByName(exact_letters).unionByName(partial)


def _tokens(norm: Column) -> Column:
    """Letters of a word with their occurrence number, rarest first, as one order for all words."""
    letters = F.split(norm, "")
    numbered = F.transform(
        letters,
        lambda x, i: F.struct(
            # second and later occurrences are rarer than first ones, and rare letters than frequent ones
            (-F.size(F.filter(F.slice(letters, 1, i + 1), lambda y: y == x))).alias("again"),
            F.call_function("locate", x, F.lit(_RARE_FIRST)).alias("rank"),
            x.alias("letter"),
        ),
    )
    return F.array_sort(numbered)


def _alike(terms: DataFrame, names: DataFrame, cutoff: float) -> DataFrame:
    """``table_id, norm, other, likeness`` of all words of a table that are alike enough.

    Likeness is 1 - distance / longer length.  Words within reach share at least
    that part of the longer word's letters, so they share one among the rarest
    ``length - needed + 1`` letters of each: no pair is lost, none is made twice.
    """

    def prefix(df: DataFrame) -> DataFrame:
        tokens = _tokens(F.col("norm"))
        keep = F.size(tokens) - F.ceil(F.lit(cutoff) * F.size(tokens) - 1e-9).cast("int") + 1
        words = df.select("table_id", "norm").filter("norm <> ''").distinct()
        return words.select("table_id", "norm", F.explode(F.slice(tokens, F.lit(1), keep)).alias("token"))

    longer = F.greatest(F.length("norm"), F.length("other"))
    gap = F.abs(F.length("norm") - F.length("other"))
    return (
        prefix(terms).join(_apart(prefix(names).withColumnRenamed("norm", "other")), ["table_id", "token"])
        .filter(1 - gap / longer >= cutoff)
        .select("table_id", "norm", "other")
        .distinct()
        .withColumn("likeness", 1 - F.levenshtein("norm", "other") / longer)
        .filter(F.col("likeness") >= cutoff)
    )


def match_columns(
    requests: DataFrame, headers: DataFrame, similar: bool = True, cutoff: float = CUTOFF
) -> DataFrame:
    """``table_id, term, header, tier`` for every request that finds a column.

    ``requests`` has ``table_id, term``; ``headers`` has ``table_id, position,
    header``.  ``similar`` adds the fifth tier, spellings of that likeness or more.
    """
    wanted = requests.select("table_id", "term").distinct()
    names = _prepared(headers)
    best = (
        _named_matches(wanted, names)
        .groupBy("table_id", "term")
        .agg(F.min_by(F.struct("header", "tier"),
                      F.struct("tier", "prio", "part", "place", "header")).alias("m"))
        .select("table_id", "term", "m.header", "m.tier")
    )
    if not similar:
        return best
    best = staged(best)  # read twice
    open_terms = (
        wanted.join(_apart(best.select("table_id", "term")), ["table_id", "term"], "left_anti")
        .withColumn("norm", squash("term"))
        .filter(F.length("norm") >= MIN_TERM)
    )
    nearest = _nearest(open_terms, names, cutoff)
    return best.unionByName(nearest.select("table_id", "term", "header", F.lit(5).alias("tier")))


def _nearest(terms: DataFrame, names: DataFrame, cutoff: float) -> DataFrame:
    """The most similar header per (table_id, term, norm); ties go to the earlier header."""
    vocabulary = _spelled(names, "norm").select("table_id", F.col("norm").alias("other"), F.col("first").alias("h"))
    return (
        terms.join(_apart(_alike(terms, names, cutoff)), ["table_id", "norm"])
        .join(_apart(vocabulary), ["table_id", "other"])
        .groupBy("table_id", "term")
        .agg(F.min_by(F.struct("h.header", "likeness"), F.struct(-F.col("likeness"), "h.position")).alias("m"))
        .select("table_id", "term", "m.header", "m.likeness")
    )


def match_by_edits(requests: DataFrame, headers: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """Best header per term by edit distance: 1 - distance / longer length."""
    terms = requests.select("table_id", "term").distinct().withColumn("norm", squash("term"))
    return _nearest(terms, _prepared(headers), cutoff)


def concept_map(headers: DataFrame, similar: bool = True) -> DataFrame:
    """Per table the concepts that have a column, with that column."""
    concepts = F.array(*[F.lit(c) for c in SYNONYMS])
    requests = headers.select("table_id").distinct().select("table_id", F.explode(concepts).alias("term"))
    return match_columns(requests, headers, similar).withColumnRenamed("term", "concept")
