"""Merkle manifest of a table, proofs by a recursive query.

Method.  Every row is a leaf.  Leaves of a group stand in a given order; runs of
two become their parent until one node, the subroot, is left; the subroots, in
order of their groups, become the root in the same way.  A lone last node is
hashed again, a node that is alone on its level is the top.

Levels are built by ``STRIDE`` at a time: a tile of up to 2^STRIDE consecutive
nodes is one group of a shuffle, whatever the size of the group, and its row
keeps for each of its nodes the siblings on the way up to the tile's top.  That
gives node rows that are linked with their parents ``STRIDE`` levels above.  Rows
above the leaves are stored once for each page (lowest tile), so that no row is
met by more than 2^STRIDE leaves and no key of a join is hot; they are
2^-STRIDE of the leaves for each step.

The climb is one recursive query: it starts with the leaves, joins the link row
of (group, page, step) in each turn, appends its siblings to the proof and folds
them into the hash.  It ends at the root after about log(leaves) / STRIDE turns.

Ranks come from a range sort on (group, order, leaf) and the row counts of its
partitions.  Nothing but the number of leaves of the largest group and the root
reaches the driver.  Every level is written to the shared folder before the next
reads it.

Nulls: a null field is hashed as ``-``; a null group is a group of its own, the
first; null order values come first.  Repeated rows are leaves of their own, next
to each other.  Rows with one order value are ordered by their leaf.  A group of
one leaf has it as its subroot; one group's subroot is the root.  An empty table
gives no rows.  Columns of the table that are not asked for are ignored, whatever
their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions.numbering import global_row_number
from tallyframe.llm.native import numbered, staged
from tallyframe.session import shared_dir

STRIDE = 6
_TILE = 1 << STRIDE
_POSITION_BITS = 33


def leaf(*fields: Column) -> Column:
    """Hex SHA-256 of the fields: ``-`` if null, else byte count, colon, value."""
    parts = []
    for field in fields:
        value = field.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def _hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def _ranked(leaves: DataFrame) -> DataFrame:
    """Leaves with ``idx`` (rank within the group) and ``n`` (leaves of the group)."""
    parts = int(leaves.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["tree", F.col("at").asc_nulls_first(), "hash"]
    placed = staged(
        leaves.repartitionByRange(parts, *order).sortWithinPartitions(*order)
        .withColumn("id", F.monotonically_increasing_id())
        .withColumn("part", F.shiftright("id", _POSITION_BITS))
        .withColumn("pos", F.col("id").bitwiseAND(F.lit((1 << _POSITION_BITS) - 1)))
        .drop("id")
    )
    runs = placed.groupBy("tree", "part").agg(F.min("pos").alias("least"), F.count("*").alias("here"))
    whole, before = Window.partitionBy("tree"), Window.partitionBy("tree").orderBy("part")
    runs = runs.select(
        "tree", "part",
        (F.sum("here").over(before) - F.col("here") - F.col("least")).alias("base"),
        F.sum("here").over(whole).alias("n"),
    )
    return placed.join(runs, ["tree", "part"]).withColumn("idx", F.col("base") + F.col("pos")).drop("part", "pos", "base")


def _tiles(nodes: DataFrame) -> DataFrame:
    """tree, n, tile, top, kids (idx, flags, siblings, and what else the nodes carry).

    ``flags`` has a letter for each level up to the top: L or R, the side of the
    sibling, or N if there is none.  ``siblings`` are their digests, 32 bytes each.
    """
    extra = [c for c in nodes.columns if c not in ("tree", "n", "idx", "hash")]
    tiles = nodes.groupBy("tree", "n", F.shiftright("idx", STRIDE).alias("tile")).agg(
        F.sort_array(F.collect_list(F.struct("idx", "hash", *extra))).alias("kids")
    )
    tiles = tiles.withColumn("l0", F.transform("kids", lambda k: _hex(k["hash"])))
    active = lambda j: (F.col("n") > _TILE) | (F.size(f"l{j}") > 1)
    for j in range(STRIDE):
        level = F.col(f"l{j}")
        pairs = F.sequence(F.lit(0), F.shiftright(F.size(level) - 1, 1))
        paired = F.transform(
            pairs, lambda i: F.sha2(F.concat(F.get(level, i * 2), F.coalesce(F.get(level, i * 2 + 1), F.lit(""))), 256)
        )
        tiles = tiles.withColumn(f"l{j + 1}", F.when(active(j), paired).otherwise(level))

    def kid(k: Column, place: Column) -> Column:
        flags, digests = [], []
        for j in range(STRIDE):
            own = F.shiftright(place, j)
            odd = own.bitwiseAND(F.lit(1)) == 1
            other = F.get(F.col(f"l{j}"), own.bitwiseXOR(F.lit(1)))
            side = F.when(other.isNull(), F.lit("N")).when(odd, F.lit("L")).otherwise(F.lit("R"))
            flags.append(F.when(active(j), side).otherwise(F.lit("")))
            digests.append(F.when(active(j) & other.isNotNull(), F.unhex(other)).otherwise(F.unhex(F.lit(""))))
        return F.struct(
            k["idx"].alias("idx"), k["hash"].alias("hash"), *(k[c].alias(c) for c in extra),
            F.concat(*flags).alias("flags"), F.concat(*digests).alias("siblings"),
        )

    return staged(
        tiles.select("tree", "n", "tile", F.unhex(F.element_at(f"l{STRIDE}", 1)).alias("top"),
                     F.transform("kids", kid).alias("kids"))
    )


def _built(nodes: DataFrame) -> list[DataFrame]:
    """Tiles of all levels, lowest first; [] without nodes."""
    out = []
    most = nodes.agg(F.max("n")).first()[0]
    while most is not None and (most > 1 or not out):
        out.append(_tiles(nodes))
        nodes = out[-1].filter(F.col("n") > _TILE).select(
            "tree", F.col("tile").alias("idx"), F.ceil(F.col("n") / _TILE).alias("n"), F.col("top").alias("hash")
        )
        most = -(-most // _TILE)
    return out


def _tops(levels: list[DataFrame]) -> DataFrame:
    """tree, top, steps: the one node that is left of each tree, and its number of tile levels."""
    tops = [t.filter(F.col("n") <= _TILE).select("tree", "top", F.lit(s + 1).alias("steps")) for s, t in enumerate(levels)]
    return reduce(DataFrame.unionAll, tops)


def _links(levels: list[DataFrame], sub: DataFrame, upper: list[DataFrame]) -> DataFrame:
    """tree, page, step, flags, siblings, subroot (on the last step only)."""
    pages = levels[0].groupBy("tree").agg(F.count("*").alias("pages"))
    out = []
    for step, tiles in enumerate(levels[1:], 1):
        shift = STRIDE * (step - 1)
        nodes = tiles.select("tree", F.inline("kids")).join(pages, "tree")
        first = F.shiftleft(F.col("idx"), shift)
        spread = numbered(
            nodes.withColumn("wide", F.least(F.lit(1 << shift).cast("long"), F.col("pages") - first)), "wide", "page"
        )
        out.append(spread.select(
            "tree", (first + F.col("page")).alias("page"), F.lit(step).alias("step"), "flags", "siblings",
            F.lit(None).cast("binary").alias("subroot"),
        ))
    for step, tiles in enumerate(upper):
        met = sub.withColumn("idx", F.shiftright("place", STRIDE * step)).join(
            tiles.select(F.inline("kids")).select("idx", "flags", "siblings"), "idx"
        )
        last = F.when(F.lit(step == len(upper) - 1), F.col("top"))
        out.append(numbered(met.join(pages, "tree"), "pages", "page").select(
            "tree", "page", (F.col("steps") + step).alias("step"), "flags", "siblings", last.alias("subroot")
        ))
    return staged(reduce(DataFrame.unionAll, out))


_FOLD = """unhex(aggregate(
  sequence(1, length({flags}), 1), named_struct('h', lower(hex({hash})), 'at', 1),
  (acc, i) -> case substring({flags}, i, 1)
    when 'N' then named_struct('h', sha2(acc.h, 256), 'at', acc.at)
    when 'L' then named_struct('h', sha2(concat(lower(hex(substring({siblings}, acc.at, 32))), acc.h), 256), 'at', acc.at + 32)
    else named_struct('h', sha2(concat(acc.h, lower(hex(substring({siblings}, acc.at, 32)))), 256), 'at', acc.at + 32)
  end, acc -> acc.h))"""


def _fold(hash_: str, flags: str, siblings: str) -> str:
    folded = _FOLD.format(flags=flags, hash=hash_, siblings=siblings)
    return f"case when {flags} = '' then {hash_} else {folded} end"


_CLIMB = f"""
with recursive climb as (
  select id, leaf, tree, page, 1 as step, {_fold("claim", "flags", "siblings")} as hash, siblings as proof,
         cast(null as binary) as subroot
  from {{leaves}}
  union all
  select c.id, c.leaf, c.tree, c.page, c.step + 1, {_fold("c.hash", "l.flags", "l.siblings")},
         concat(c.proof, l.siblings), l.subroot
  from climb c join {{links}} l on c.tree = l.tree and c.page = l.page and c.step = l.step
)
select id, leaf, subroot, proof, hash from climb where subroot is not null
"""


def proofs(rows: DataFrame, key: Column, group: Column, leaf: Column, claimed: Column | None = None) -> DataFrame:
    """id, leaf, subroot, root, proof, folded_root, verified: a row per row of ``rows``.

    ``key`` is the row's id and its place within ``group``; ``leaf`` its hex
    digest; ``claimed`` the digest that is folded with the proof (default: the
    leaf; so a null is the leaf, too).  ``proof`` holds the siblings from the leaf
    to the root, 32 bytes each, ``verified`` says whether the fold gives the root.
    """
    spark = rows.sparkSession
    shared_dir(spark)
    claim = leaf if claimed is None else F.coalesce(claimed, leaf)
    own = F.unhex(leaf)
    leaves = staged(rows.select(
        # the null group before the empty one, both before all others
        F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit("")).alias("tree"),
        key.alias("at"), own.alias("hash"), F.unhex(claim).alias("claim"),
    ))
    levels = _built(_ranked(leaves))
    if not levels:
        return leaves.select(
            F.col("at").alias("id"), *(F.lit("").alias(c) for c in ("leaf", "subroot", "root")), F.col("hash").alias("proof"),
            F.lit("").alias("folded_root"), F.lit(True).alias("verified"),
        )
    sub = staged(global_row_number(_tops(levels), ["tree"], "place"))
    groups = sub.count()
    upper = _built(sub.select(F.lit("").alias("tree"), F.lit(groups).cast("long").alias("n"), F.col("place").alias("idx"),
                              F.col("top").alias("hash")))
    root = _tops(upper).select(_hex(F.col("top"))).first()[0]
    start = levels[0].select("tree", F.col("tile").alias("page"), F.inline("kids")).select(
        F.col("at").alias("id"), F.col("hash").alias("leaf"), "tree", "page", "claim", "flags", "siblings"
    )
    # the climb has as many rows as leaves in every turn, so the default limit of rows must go while it runs
    limit = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(limit, None)
    spark.conf.set(limit, "-1")
    try:
        top = staged(spark.sql(_CLIMB, leaves=start, links=_links(levels, sub, upper)))
    finally:
        spark.conf.set(limit, before) if before is not None else spark.conf.unset(limit)
    return top.select(
        "id", _hex(F.col("leaf")).alias("leaf"), _hex(F.col("subroot")).alias("subroot"), F.lit(root).alias("root"),
        "proof", _hex(F.col("hash")).alias("folded_root"), (_hex(F.col("hash")) == F.lit(root)).alias("verified"),
    )


def document_proofs(docs: DataFrame) -> DataFrame:
    """Proofs of documents, where ids that 7 divides by CRC-32 claim one character more than they have."""
    fields = lambda n: (F.col(c) if c != "n_chars" else n for c in ("doc_id", "source", "lang", "n_chars", "text"))
    n = F.col("n_chars")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return proofs(
        docs, F.col("doc_id"), F.col("lang"), leaf(*fields(n)),
        F.when(tampered, leaf(*fields(n.cast("decimal(20,0)") + 1))),
    )
