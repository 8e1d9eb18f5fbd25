"""MinHash near-duplicates by an LSH forest.

A document's set are its 5-word shingles.  Equal sets are grouped first, by a
128-bit fingerprint; one document stands for each.  A forest of ``TREES`` sorted
orders is then laid over the sets: in each, sets are sorted by a sequence of
MinHashes, and neighbours share the longest prefixes.  Each set is compared, by its
signature, with its neighbours in every order.  In a dense region neighbours share
long prefixes, in a thin one short prefixes do: the depth adapts by itself.

Neighbours whose signatures agree in half of the places or more join a cluster.
Clusters only narrow the search: within a cluster, two sets whose components still
differ are compared in full if they share one of their rarest shingles, as linked
sets must, so links do not depend on which neighbours met.  A cluster with more shingles than ``BLOCK`` is cut into blocks and
each two blocks are a task; tasks return forest edges only, never all pairs.
Neighbours are compared over the bounds of range partitions too.  Sets with a
Jaccard similarity of 0.75 share two leading MinHashes in at least one of 20 orders
but for a chance of 7e-8; where more than ``NEIGHBOURS`` other sets share these two,
the pair need not be compared, and rests on the cluster that it shares with them.

Defined cases: null, blank and empty texts have no shingle and no link; a text of
fewer words than five has one shingle, all its words.  Rows that share an id are
one document and linked; a row without an id takes no part in links, has no
component and is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from tallyframe.llm import words as W
from tallyframe.llm.components import components
from tallyframe.llm.native import free_name, staged

WIDTH = 5
SIMILAR = 75  # percent
TREES, DEPTH = 20, 4
NEIGHBOURS = 4  # compared on either side, in each order
BLOCK = 2_000_000  # shingles of a block
COMPARED = 64  # sets compared with one before joined ones are left out again
BROADCAST_IDS = 1_000_000
_HASHES = TREES * DEPTH
_A = W.mix(np.arange(1, _HASHES + 1, dtype=np.uint64)) | np.uint64(1)
_B = W.mix(np.arange(1001, _HASHES + 1001, dtype=np.uint64))
_SET = StructType([
    StructField("n", LongType()), StructField("f1", LongType()), StructField("f2", LongType()),
    StructField("signature", BinaryType()),
])


def shingles(piece: W.Piece) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hash of each distinct shingle, sorted by both."""
    found = W.split(piece)
    h = W.hashes(piece.data, found, W.LOWER)
    firsts = found.firsts(piece.texts)
    counts = np.diff(firsts)
    value, whole = W.windows(h, firsts, WIDTH)
    texts, values = [found.text[whole]], [value[whole]]
    for width in range(1, WIDTH):
        short = np.flatnonzero(counts == width)
        if len(short):
            texts.append(short)
            values.append(W.windows(h, firsts, width)[0][firsts[short]])
    text, value = np.concatenate(texts), np.concatenate(values)
    order = np.lexsort((value, text))
    text, value = text[order], value[order]
    fresh = np.ones(len(text), bool)
    fresh[1:] = (text[1:] != text[:-1]) | (value[1:] != value[:-1])
    return text[fresh], value[fresh]


def _signatures(value: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """MinHashes (set, hash) of runs of shingles, 32 bits each."""
    out = np.empty((len(starts), _HASHES), np.uint32)
    for k in range(_HASHES):
        out[:, k] = np.minimum.reduceat((value * _A[k] + _B[k]) >> np.uint64(32), starts)
    return out


@F.arrow_udf(_SET)
def set_of(texts: pa.Array) -> pa.Array:
    """Size, fingerprint and signature of each text's set; the signature is empty for no shingle."""
    n, f1, f2, signature = [], [], [], []
    for piece in W.pieces(texts):
        text, value = shingles(piece)
        counts = np.bincount(text, minlength=piece.texts)
        filled = np.flatnonzero(counts)
        starts = np.concatenate([[0], np.cumsum(counts[filled])])[:-1]
        n.append(counts)
        for out, salt in ((f1, 1), (f2, 2)):
            sums = np.zeros(piece.texts, np.uint64)
            if len(filled):
                sums[filled] = np.add.reduceat(W.mix(value + np.uint64(salt)), starts)
            out.append(sums.view(np.int64))
        rows = _signatures(value, starts).astype(">u4") if len(filled) else None
        given = iter(range(len(filled)))
        signature += [rows[next(given)].tobytes() if c else b"" for c in counts]
    cat = lambda parts: pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.int64())
    return pa.StructArray.from_arrays(
        [cat(n), cat(f1), cat(f2), pa.array(signature, pa.binary())], names=["n", "f1", "f2", "signature"]
    )


def _orders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per set and tree: its place in the order, and a byte of every MinHash."""
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            part = batch.slice(at, 2000)
            full = np.frombuffer(b"".join(part.column("signature").to_pylist()), ">u4").reshape(-1, _HASHES)
            low = [x.tobytes() for x in (full & 0xFF).astype(np.uint8)]
            for tree in range(TREES):
                keys = [x.tobytes() for x in np.ascontiguousarray(full[:, tree * DEPTH : (tree + 1) * DEPTH])]
                yield pa.record_batch(
                    [pa.array(np.full(len(low), tree, np.int32)), pa.array(keys, pa.binary()), part.column("id"),
                     pa.array(low, pa.binary())],
                    names=["tree", "key", "id", "low"],
                )


_ORDERED = "tree int, key binary, id long, low binary"


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbours (a, b) in sorted order whose signatures agree in half of the places or more.

    The first and last rows of the partition follow as they are, with null a and b.
    """
    head = tail = None
    for batch in batches:
        if not batch.num_rows:
            continue
        head = batch if head is None or head.num_rows < NEIGHBOURS else head
        rows = batch if tail is None else pa.Table.from_batches([tail, batch]).combine_chunks().to_batches()[0]
        head = rows.slice(0, NEIGHBOURS) if head is batch else head
        tail = rows.slice(max(rows.num_rows - NEIGHBOURS, 0))
        tree, ids = np.asarray(rows.column("tree")), np.asarray(rows.column("id"))
        first = np.frombuffer(b"".join(k[:4] for k in rows.column("key").to_pylist()), ">u4")
        low = np.frombuffer(b"".join(rows.column("low").to_pylist()), np.uint8).reshape(-1, _HASHES)
        found = []
        for step in range(1, NEIGHBOURS + 1):
            a, b = np.arange(len(ids) - step), np.arange(step, len(ids))
            near = np.flatnonzero((tree[a] == tree[b]) & (first[a] == first[b]))
            a, b = a[near], b[near]
            near = np.flatnonzero((low[a] == low[b]).sum(1) * 2 >= _HASHES)
            found.append(np.stack([ids[a[near]], ids[b[near]]]))
        pairs = np.unique(np.sort(np.concatenate(found, 1), 0), axis=1)
        none = [pa.nulls(pairs.shape[1], f.type) for f in batch.schema]
        yield pa.record_batch([pa.array(pairs[0]), pa.array(pairs[1]), *none], names=["a", "b", *batch.schema.names])
    for part in (head, tail):
        if part is not None:
            none = [pa.nulls(part.num_rows, pa.int64())] * 2
            yield pa.record_batch([*none, *part.columns], names=["a", "b", *part.schema.names])


def _near(ordered: DataFrame) -> DataFrame:
    """Neighbours (a, b) of rows sorted by (tree, key, id) within range partitions, and over their bounds."""
    met = staged(ordered.mapInArrow(_neighbours, f"a long, b long, {_ORDERED}"))
    # the rows beside bounds: a few for each partition
    order = ["tree", "key", "id"]
    ends = met.filter("a is null").select(*order, "low").distinct().repartition("tree").sortWithinPartitions(*order)
    over = ends.mapInArrow(_neighbours, f"a long, b long, {_ORDERED}")
    return met.unionByName(over).filter("a is not null").select("a", "b").distinct()


def _rare(flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(shingle, set) rows of the rarest shingles of each set: enough that two linked sets share one of them."""
    order = np.argsort(np.bincount(flat), kind="stable")
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    owner = np.repeat(np.arange(len(sizes)), sizes)
    ranked = rank[flat]
    ranked = ranked[np.lexsort((ranked, owner))]
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    # linked sets have SIMILAR percent of either in common, so that many can't all come after the first few
    few = sizes + SIMILAR * sizes // -100 + 1
    inside = place < np.repeat(few, sizes)
    return ranked[inside], owner[inside]


def forest_edges(sets: list[np.ndarray], left: int | None = None) -> list[tuple[int, int]]:
    """Edges that join sets as their links do; with ``left``, links of the first ``left`` sets to the others only.

    Sets are compared in full if they share one of their rarest shingles and are not
    joined yet.  Sets that share only what most of them have never meet.
    """
    m = len(sets)
    sizes = np.array([len(s) for s in sets])
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    shingle, owner = _rare(flat, sizes)
    _, shingle = np.unique(shingle, return_inverse=True)
    held = np.bincount(shingle)
    owner, shingle = owner[held[shingle] > 1], shingle[held[shingle] > 1]
    first = np.searchsorted(owner, np.arange(m + 1))
    right = owner >= (left or 0)
    bounds = np.concatenate([[0], np.cumsum(np.bincount(shingle[right], minlength=len(held)))])
    holders = owner[right][np.argsort(shingle[right], kind="stable")]
    joined = np.zeros(len(held), bool)  # shingles whose holders are one component
    part = np.arange(m)  # component of each set, by its least member
    mark = np.zeros(int(flat.max()) + 1, bool)
    tried = np.zeros(m, bool)  # compared with the set at hand
    edges = []
    for u in range(m if left is None else left):
        mine = shingle[first[u] : first[u + 1]]
        mark[flat[starts[u] : starts[u + 1]]] = True
        for t in mine[bounds[mine] < bounds[mine + 1]]:
            others = holders[bounds[t] : bounds[t + 1]]
            if joined[t] and part[others[0]] == part[u]:
                continue
            parts = part[others]
            joined[t] = (parts == parts[0]).all()
            others = others[(parts != part[u]) & ~tried[others] & (others > u)]
            fit = (100 * sizes[others] >= SIMILAR * sizes[u]) & (100 * sizes[u] >= SIMILAR * sizes[others])
            others = others[fit]
            while len(others):
                some, others = others[:COMPARED], others[COMPARED:]
                tried[some] = True
                lengths = sizes[some]
                ends = np.cumsum(lengths)
                at = np.repeat(starts[some] - (ends - lengths), lengths) + np.arange(ends[-1])
                common = np.add.reduceat(mark[flat[at]].astype(np.int64), ends - lengths)
                for v in some[100 * common >= SIMILAR * (lengths + sizes[u] - common)]:
                    if part[v] != part[u]:
                        edges.append((u, int(v)))
                        low, high = sorted((part[u], part[v]))
                        part[part == high] = low
                others = others[part[others] != part[u]]  # a link may have joined many of them
        mark[flat[starts[u] : starts[u + 1]]] = False
        tried[:] = False
    return edges


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Forest edges of each group (cluster, i, j); groups arrive one after the other."""

    def close(rows: list[tuple]) -> pa.RecordBatch:
        rows.sort(key=lambda r: (r[1], r[2]))  # block i first, then by id
        left = sum(r[1] == 0 for r in rows) if rows[0][0][1] != rows[0][0][2] else None
        edges = forest_edges([r[3] for r in rows], left) if len(rows) > 1 else []
        return pa.record_batch(
            [pa.array([rows[a][2] for a, _ in edges], pa.int64()), pa.array([rows[b][2] for _, b in edges], pa.int64())],
            names=["a", "b"],
        )

    rows: list[tuple] = []
    for batch in batches:
        keys = list(zip(*(batch.column(c).to_pylist() for c in ("cluster", "i", "j"))))
        sides, ids = batch.column("side").to_pylist(), batch.column("id").to_pylist()
        for piece in W.pieces(batch.column("text")):
            text, value = shingles(piece)
            firsts = np.searchsorted(text, np.arange(piece.texts + 1))
            for t in range(piece.texts):
                at = piece.first + t
                if firsts[t] == firsts[t + 1]:  # a blank text has no link
                    continue
                if rows and rows[0][0] != keys[at]:
                    yield close(rows)
                    rows = []
                rows.append((keys[at], sides[at], ids[at], value[firsts[t] : firsts[t + 1]]))
    if rows:
        yield close(rows)


def _links(docs: DataFrame, clusters: DataFrame) -> DataFrame:
    """Forest edges (a, b) between the ids of ``clusters`` (id, n, cluster), on full sets."""
    sizes = clusters.groupBy("cluster").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("blocks"))
    members = staged(clusters.join(sizes, "cluster"))
    if members.count() <= BROADCAST_IDS:
        members = F.broadcast(members)
    # rows that share an id have one text each in a cluster; blank ones are left out by _confirm
    texts = docs.select(F.col("doc_id").alias("id"), "text").join(members, "id")
    mine = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    tasks = texts.withColumn("mine", mine).withColumn("other", other).select(
        "cluster", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"),
        (F.col("mine") > F.col("other")).cast("int").alias("side"), "id", "text",
    )
    order = ["cluster", "i", "j"]
    return tasks.repartition(*order).sortWithinPartitions(*order).mapInArrow(_confirm, "a long, b long")


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document row."""
    sets = docs.select("doc_id", set_of("text").alias("s")).select(F.col("doc_id").cast("long").alias("doc_id"), "s.*")
    sets = staged(sets)
    filled = sets.filter("n > 0 and doc_id is not null")
    kinds = filled.groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("id"))
    kinds = staged(kinds)
    chosen = kinds.select("f1", "f2", "n", "id").join(
        filled.select("f1", "f2", "n", F.col("doc_id").alias("id"), "signature"), ["f1", "f2", "n", "id"]
    ).dropDuplicates(["id", "f1", "f2"])
    ordered = chosen.select("id", "signature").mapInArrow(_orders, _ORDERED)
    ordered = ordered.repartitionByRange("tree", "key", "id").sortWithinPartitions("tree", "key", "id")
    clusters = components(_near(ordered)).select(F.col("node").alias("id"), F.col("component").alias("cluster"))
    sized = clusters.join(kinds.groupBy("id").agg(F.sum("n").alias("n")), "id")
    links = _links(docs, sized)
    # rows of one id, and of equal sets, belong together
    same = filled.select("doc_id", "f1", "f2", "n").join(kinds, ["f1", "f2", "n"]).select(
        F.col("doc_id").alias("a"), F.col("id").alias("b")
    )
    found = components(links.unionByName(same.filter("a <> b")))
    (node,) = free_name(sets, "node")
    out = sets.join(found.withColumnRenamed("node", node), F.col("doc_id") == F.col(node), "left")
    component = F.coalesce("component", "doc_id")
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each class; columns stay as they are.

    Documents without an id are kept.  Of rows that share a kept id, all stay.
    """
    (gone,) = free_name(docs, "gone")
    dropped = classes(docs).filter(~F.col("kept")).select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(dropped, F.col("doc_id") == F.col(gone), "left_anti")
