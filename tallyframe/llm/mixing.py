"""Mixing sources to target weights: a low-discrepancy schedule of equal-token blocks.

Every source has a target of words.  Its documents are shuffled (by a hash of
the id), laid end to end and cut into blocks of equal size, up to one word.  The
mix is a sequence of slots.  Slot ``i`` looks at the golden-ratio point
``i * g / n`` of a lattice of as many points as slots, and the source whose span
of cumulative slot counts holds the point gets the slot; every source so gets its
slots, spread evenly over the mix.  The slots of a source are ranked, and slot
number ``r`` takes block ``r`` of the source, starting anew after the last block.
The last slot of a source stops at its target.

Only DataFrame functions are used.  Positions come from sums of buckets, so no
task orders a whole source.

Defined cases: a null source is a source, after all others; a null or empty text
has 0 words and is never taken; a null id shuffles as an empty one; rows equal in
source, id, text and size are laid out side by side.  An empty table gives no row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.llm.native import WORD, n_words, numbered, row_hash, running, staged

WEIGHTS = (5, 2, 1)
SHARE = 1.5  # words of the mix, per word of the input
MOST = 2  # a target per word of its source, at most
BLOCK = 8192
_BUCKET_ROWS = 4096


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """place, source, source_size, target of (source, words) rows.

    Sources in code-point order take the weights in turn.  The windows run over one
    row per source.  A source is full if ``most`` times its size is at most its
    share of what smaller ratios leave; the others share the rest by weight.
    """
    by_source = sizes.groupBy("source").agg(F.sum("words").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.col("place") % len(weights) + 1).cast("int"))
    s = by_source.withColumn("place", place).withColumn("w", w).withColumn("cap", F.col("source_size") * most)
    everything = Window.partitionBy()
    rising = Window.orderBy(F.col("cap") / F.col("w"), "place")
    fuller = rising.rowsBetween(Window.unboundedPreceding, -1)
    rest = rising.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    s = s.withColumn("goal", F.sum("source_size").over(everything) * share)
    left = F.col("goal") - F.coalesce(F.sum("cap").over(fuller), F.lit(0))
    s = s.withColumn("full", F.col("cap") * F.sum("w").over(rest) <= left * F.col("w"))
    spent = F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(everything), F.lit(0))
    open_weight = F.sum(F.when(~F.col("full"), F.col("w"))).over(everything)
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(
        (F.col("goal") - spent) / open_weight * F.col("w")
    )
    return s.select("place", "source", "source_size", target.alias("target"))


def _block_start(block: Column) -> Column:
    """First word of a block: the first ``larger`` blocks have ``length + 1`` words."""
    return block * F.col("length") + F.least(block, F.col("larger"))


def _block_of(word: Column) -> Column:
    edge = F.col("larger") * (F.col("length") + 1)
    return F.when(word < edge, _div(word, F.col("length") + 1)).otherwise(
        F.col("larger") + _div(word - edge, F.greatest(F.col("length"), F.lit(1)))
    )


def _div(a: Column, b: Column) -> Column:
    """Whole-number quotient of non-negative longs."""
    return ((a - F.pmod(a, b)) / b).cast("long")


def with_blocks(goals: DataFrame, block: int = BLOCK) -> DataFrame:
    """Block layout and number of slots of each source, and its first slot point."""
    out = goals.withColumn("wanted", F.round("target").cast("long"))
    out = out.withColumn("blocks", F.ceil(F.col("source_size") / block).cast("long"))
    whole = F.greatest(F.col("blocks"), F.lit(1))
    out = out.withColumn("length", _div(F.col("source_size"), whole)).withColumn(
        "larger", F.pmod(F.col("source_size"), whole)
    )
    size = F.greatest(F.col("source_size"), F.lit(1))
    out = out.withColumn("rounds", _div(F.col("wanted"), size)).withColumn("rest", F.pmod(F.col("wanted"), size))
    slots = F.col("rounds") * F.col("blocks") + F.when(F.col("rest") > 0, _block_of(F.col("rest") - 1) + 1).otherwise(0)
    out = out.withColumn("slots", F.when(F.col("source_size") > 0, slots).otherwise(0))
    before = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return out.withColumn("point", F.coalesce(F.sum("slots").over(before), F.lit(0)))


def _golden_step(n: int) -> int:
    """The whole number nearest to n / golden ratio without a divisor in common with n."""
    near = round(n * (math.sqrt(5) - 1) / 2)
    for d in range(n + 1):
        for g in (near + d, near - d):
            if 0 < g <= n and math.gcd(g, n) == 1:
                return g
    return 1


def schedule(layout: DataFrame) -> DataFrame:
    """place, slot, turn, all_slots: the slots of the mix, the turn of each within its source, their number."""
    n = int(layout.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0])
    back = pow(_golden_step(n), -1, n) if n > 1 else 0
    cells = numbered(layout.select("place", "slots", "point"), "slots", "k")
    cell = (F.col("point") + F.col("k")).cast("decimal(19,0)")
    slot = F.pmod(cell * F.lit(back).cast("decimal(19,0)"), F.lit(max(n, 1)).cast("decimal(19,0)")).cast("long")
    slots = cells.select("place", slot.alias("slot"), F.lit(1).alias("one"))
    slots = slots.withColumn("bucket", F.shiftright("slot", 12))
    return running(slots, ["place"], "bucket", ["slot"], "one", "turn").select(
        "place", "slot", "turn", F.lit(n).cast("long").alias("all_slots")
    )


def _stream(docs: DataFrame, row: Column) -> DataFrame:
    """One row per kind of document row: source, doc_id, text_hash, row, size, copies, words."""
    rows = docs.select("source", "doc_id", F.xxhash64("text").alias("text_hash"), row.alias("row"),
                       n_words(F.col("text")).alias("size"))
    kinds = rows.groupBy("source", "doc_id", "text_hash", "row", "size").agg(F.count("*").alias("copies"))
    return kinds.withColumn("words", F.col("size") * F.col("copies"))


def mix(docs: DataFrame, block: int = BLOCK, row: Column | None = None, **goals) -> DataFrame:
    """What the mix takes of every document copy, slot by slot.

    Rows: source, doc_id, text_hash, row, size, copy, source_size, target, and for
    each slot that takes words of it: slot, round (how often the source was used up
    before), all_slots (slots of the whole mix), taken.  A copy that is never taken has one row with slot null and
    taken 0.  ``row`` tells rows of one source, id and text apart (default: not).
    """
    kinds = staged(_stream(docs, F.lit(0).cast("long") if row is None else row))
    layout = staged(with_blocks(targets(kinds, **goals), block))
    digits = max(0, math.ceil(math.log(max(kinds.count(), 1) / _BUCKET_ROWS, 16)))
    order = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    kinds = kinds.withColumn("key", order).withColumn("bucket", F.substring("key", 1, digits))
    laid = running(kinds, ["source"], "bucket", ["key", "doc_id", "size", "text_hash", "row"], "words", "start")
    copies = numbered(laid.drop("key", "bucket", "words"), "copies", "copy").withColumn(
        "start", F.col("start") + F.col("copy") * F.col("size")
    )
    facts = layout.select("place", F.col("source").alias("of"), "source_size", "target", "length", "larger", "slots",
                          "blocks", "rest")
    placed = copies.join(facts, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    span = F.sequence(_block_of(F.col("start")), _block_of(F.col("start") + F.col("size") - 1))
    pieces = placed.withColumn("block", F.explode_outer(F.when(F.col("size") > 0, span)))
    turns = (
        schedule(layout)
        .join(layout.select("place", "blocks"), "place")
        .select("place", "slot", "turn", "all_slots", F.pmod("turn", F.greatest("blocks", F.lit(1))).alias("block"),
                _div(F.col("turn"), F.greatest("blocks", F.lit(1))).alias("round"))
    )
    met = pieces.join(turns, ["place", "block"], "left")
    last = (F.col("turn") == F.col("slots") - 1) & (F.col("rest") > 0)
    stop = F.when(last, F.col("rest")).otherwise(F.col("source_size"))
    low = F.greatest("start", _block_start(F.col("block")))
    high = F.least(F.col("start") + F.col("size"), _block_start(F.col("block") + 1), stop)
    taken = F.when(F.col("turn").isNull(), F.lit(0)).otherwise(F.greatest(high - low, F.lit(0))).cast("long")
    return met.select("source", "doc_id", "text_hash", "row", "size", "copy", "source_size", "target", "slot", "round",
                      "all_slots", taken.alias("taken"))


def words_taken(docs: DataFrame, block: int = BLOCK, **goals) -> DataFrame:
    """doc_id, size, source_size, target, taken, source, first_slot of every document row.

    ``first_slot`` is the place in the mix where the document first turns up; null
    if it is never taken.
    """
    parts = mix(docs, block, **goals)
    whole = parts.groupBy("source", "doc_id", "text_hash", "size", "copy", "source_size", "target").agg(
        F.sum("taken").alias("taken"), _first_slot()
    )
    return whole.select("doc_id", "size", "source_size", "target", "taken", "source", "first_slot")


def _first_slot() -> Column:
    return F.min(F.when(F.col("taken") > 0, F.col("slot"))).alias("first_slot")


def mixed_documents(docs: DataFrame, block: int = BLOCK, **goals) -> DataFrame:
    """The mix as documents, in slot order: a row for each time that words of a document are taken.

    A text taken in part keeps its first words, joined by blanks, and n_chars
    follows.  Every copy keeps the columns of its own row.  Slots hold equal numbers
    of words, so each partition is an equal run of them and no sample is needed to
    find the bounds.
    """
    keys = ["source", "doc_id", "text_hash", "row"]
    rounds = mix(docs, block, row_hash(docs), **goals).groupBy(*keys, "size", "copy", "round", "all_slots").agg(
        F.sum("taken").alias("taken"), _first_slot()
    )
    rounds = rounds.filter("taken > 0").select(*(F.col(k).alias(f"m_{k}") for k in keys), "size", "taken",
                                               "first_slot", "all_slots")
    base = docs.select(F.struct(*(f"`{c}`" for c in docs.columns)).alias("d"))
    base = base.select("d", F.col("d.source").alias("source"), F.col("d.doc_id").alias("doc_id"),
                       F.xxhash64("d.text").alias("text_hash"), row_hash(docs, "d.").alias("row")).dropDuplicates(keys)
    met = base.join(rounds, [F.col(k).eqNullSafe(F.col(f"m_{k}")) for k in keys])
    first = F.array_join(F.slice(F.regexp_extract_all("d.text", F.lit(WORD), F.lit(0)), 1, F.col("taken").cast("int")), " ")
    text = F.when(F.col("taken") == F.col("size"), F.col("d.text")).otherwise(first)
    met = met.withColumn("cut", text)
    new = {"text": F.col("cut")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("taken") == F.col("size"), F.col("d.n_chars")).otherwise(F.length("cut"))
    types = dict(docs.dtypes)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    run = F.floor(F.col("first_slot") / F.col("all_slots") * parts).cast("int")
    met = met.repartitionById(parts, run).sortWithinPartitions("first_slot", "m_doc_id")
    return met.select(*(new.get(c, F.col(f"d.`{c}`")).cast(types[c]).alias(c) for c in docs.columns))
