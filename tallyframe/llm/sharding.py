"""Sharding by extendible hashing: only oversized buckets split on another bit.

The directory is indexed by the first bits of a hash of the document id.  It
starts as one bucket; a bucket over the byte limit splits on its next bit, again
and again, until every bucket fits.  A shard is a bucket: the shortest prefix of
a document's bits whose bucket fits.

Only DataFrame functions are used.  Bytes are summed per cell (bits well below
the expected depth), the few cells are summed for every shorter prefix, and each
cell takes the shortest prefix that fits.  Rows of cells that are still too large,
and only they, go into another round on further bits.

The bits are 60 of the MD5 of the id, then 60 of a hash over all columns.  Rows
equal in every column can't be told apart by bits: if such a group exceeds the
limit, as when a single document does, it leaves the directory and is paged: each
page holds as many of its rows as fit, one at least.  So a shard exceeds the limit
only if it is one document that does.

Defined cases: a null in one column is not one in another, and columns may be of any
type (arrays, maps, structs are compared by their JSON); a null id hashes as an empty one, a null text has 0 bytes, an
empty table gives no row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.native import numbered, row_hash, staged

LIMIT = 32 << 20
_BITS = 60
_ROUND = 16  # bits of a round at most


def _low_bits(md5: Column) -> Column:
    return F.conv(F.substring(md5, 1, _BITS // 4), 16, 10).cast("long")


def keyed(docs: DataFrame) -> DataFrame:
    """h1, h2 (60 bits each) and bytes of every row."""
    row = row_hash(docs)
    return docs.select(
        F.col("doc_id"),
        _low_bits(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("h1"),
        F.shiftrightunsigned(row, 64 - _BITS).alias("h2"),
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"),
    )


def _prefix(depth: int | Column) -> tuple[Column, Column]:
    """The first ``depth`` bits as two numbers."""
    d = F.lit(depth) if isinstance(depth, int) else depth
    one = F.call_function("shiftright", F.col("h1"), F.greatest(F.lit(_BITS) - d, F.lit(0)))
    two = F.call_function("shiftright", F.col("h2"), F.least(F.lit(2 * _BITS) - d, F.lit(_BITS)))
    return one, two


def _bits(h1: Column, h2: Column) -> Column:
    return F.concat(*(F.lpad(F.bin(h), _BITS, "0") for h in (h1, h2)))


def _split(rows: DataFrame, low: int, high: int, limit: int) -> DataFrame:
    """The cells of ``high`` bits, each with the shortest prefix over ``low`` bits that fits.

    Columns c1, c2, depth, shard_bytes; depth is null if no prefix fits.  A prefix
    of ``low`` bits itself is a candidate in the first round only.
    """
    c1, c2 = _prefix(high)
    cells = rows.groupBy(c1.alias("c1"), c2.alias("c2")).agg(F.sum("weight").alias("weight"))
    depths = F.explode(F.sequence(F.lit(low if low == 0 else low + 1), F.lit(high)))
    ladder = cells.withColumn("depth", depths)
    # cell numbers hold the first min(high, 60) and the last high - 60 bits
    up1 = F.call_function("shiftright", F.col("c1"), F.greatest(F.lit(min(high, _BITS)) - F.col("depth"), F.lit(0)))
    over = max(high - _BITS, 0)
    up2 = F.call_function("shiftright", F.col("c2"), F.least(F.lit(high) - F.col("depth"), F.lit(over)))
    ladder = ladder.select("c1", "c2", "weight", "depth", up1.alias("p1"), up2.alias("p2"))
    buckets = ladder.groupBy("depth", "p1", "p2").agg(F.sum("weight").alias("shard_bytes"))
    fits = ladder.join(buckets, ["depth", "p1", "p2"]).filter(F.col("shard_bytes") <= limit)
    best = fits.groupBy("c1", "c2").agg(F.min(F.struct("depth", "shard_bytes")).alias("best"))
    return cells.join(best, ["c1", "c2"], "left").select("c1", "c2", "best.depth", "best.shard_bytes")


def directory(kinds: DataFrame, limit: int) -> DataFrame:
    """h1, h2, depth, shard_bytes of every kind of row that the directory holds.

    ``kinds`` has h1, h2 and weight (its rows' bytes), no weight over the limit.
    """
    total = kinds.agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0]
    low, step = 0, min(_ROUND, 4 + max(0, math.ceil(math.log2(max(total / limit, 1)))))
    done = None
    while True:
        high = min(low + step, 2 * _BITS)
        cells = _split(kinds, low, high, limit)
        c1, c2 = _prefix(high)
        placed = staged(
            kinds.withColumn("c1", c1).withColumn("c2", c2).join(cells, ["c1", "c2"])
            .select("h1", "h2", "weight", "depth", "shard_bytes")
        )
        fit = placed.filter(F.col("depth").isNotNull() | F.lit(high == 2 * _BITS)).drop("weight")
        done = fit if done is None else done.unionByName(fit)
        kinds = placed.filter("depth is null").select("h1", "h2", "weight")
        if high == 2 * _BITS or kinds.isEmpty():
            return done
        low, step = high, 8


def plan(docs: DataFrame, limit: int = LIMIT) -> tuple[DataFrame, DataFrame]:
    """The shards of all kinds of rows (h1, h2, ...): those of the directory, and the paged ones."""
    kinds = staged(keyed(docs).groupBy("doc_id", "h1", "h2", "bytes").agg(F.count("*").alias("copies")))
    kinds = kinds.withColumn("weight", F.col("bytes") * F.col("copies"))
    held, paged = kinds.filter(F.col("weight") <= limit), kinds.filter(F.col("weight") > limit)
    found = directory(held.select("h1", "h2", "weight"), limit)
    shard = F.substring(_bits(F.col("h1"), F.col("h2")), F.lit(1), F.col("depth"))
    held = held.join(found, ["h1", "h2"]).withColumn("shard", shard)
    room = F.greatest(F.floor(F.lit(limit) / F.col("bytes")), F.lit(1)).cast("long")
    pages = numbered(paged.withColumn("room", room), "copies", "copy")
    page = F.floor(F.col("copy") / F.col("room")).cast("long")
    in_page = F.least(F.col("room"), F.col("copies") - page * F.col("room"))
    pages = pages.select(
        "doc_id", "h1", "h2", "bytes", F.lit(2 * _BITS).alias("depth"),
        (F.col("bytes") * in_page).alias("shard_bytes"),
        F.concat_ws("/", _bits(F.col("h1"), F.col("h2")), page).alias("shard"),
    )
    return held, pages


def shard_table(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """doc_id, bytes, shard (its bits), depth, shard_bytes of every row."""
    held, pages = plan(docs, limit)
    columns = ["doc_id", "bytes", "shard", "depth", "shard_bytes"]
    return numbered(held, "copies", "copy").select(*columns).unionByName(pages.select(*columns))


def sharded(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``docs`` with shard, shard_depth and shard_bytes; columns of these names are replaced."""
    added = ["shard", "shard_depth", "shard_bytes"]
    docs = docs.drop(*added)
    held, pages = plan(docs, limit)
    key = [row_hash(docs), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))]
    base = docs.select(
        F.struct(*(f"`{c}`" for c in docs.columns)).alias("d"),
        _low_bits(F.md5(key[1])).alias("h1"),
        F.shiftrightunsigned(key[0], 64 - _BITS).alias("h2"),
    )
    out = [F.col("depth").alias("shard_depth"), "shard_bytes"]
    found = base.join(held.select("h1", "h2", "shard", *out), ["h1", "h2"])
    once = base.join(pages.select("h1", "h2").distinct(), ["h1", "h2"], "left_semi").dropDuplicates(["h1", "h2"])
    paged = once.join(pages.select("h1", "h2", "shard", *out), ["h1", "h2"])
    return found.unionByName(paged).select("d.*", *added)
