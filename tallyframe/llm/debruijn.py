"""Substring dedup by a sparse de Bruijn graph of token k-mers.

Every window of ``WINDOW`` words picks its least ``K``-word k-mer (by hash, the first
of equals).  Picked k-mers are the nodes of the graph: equal windows pick the same
node, so about two in ``WINDOW - K + 2`` positions stand for the text.  The windows
that pick one occurrence of a node form one stretch of words, its edge.

* A node whose occurrences all have the same edge does not branch.  The edge
  compacts to one entry: every occurrence but the first repeats all its windows.
* A node with several edges branches.  The first occurrence of each edge is
  looked up in its source document, and its windows are compared one by one.

Repeated windows come back by source coordinate, merge into spans within their
document, and the words they cover are removed.  Node and edge, or node and
window, are told apart by two 64-bit hashes together.

Copies within an Arrow batch are settled there, so a node sends at most one row
per batch and edge to its task; of a node with more than ``FAN`` edges in a batch
the others skip the node's task and go straight to the window comparison, which
is exact by itself.  Rows of a task are sorted and streamed.

Defined cases: null and empty texts have no words and keep the hash of the empty
text; texts under ``WINDOW`` words lose nothing; a null id comes after all others;
of rows that share an id, texts are ordered by a hash; rows equal in id and text
are one document and get the same result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from tallyframe.llm import words as W
from tallyframe.llm.native import staged

WINDOW = 20
K = 5
FAN = 64
_ROOM = WINDOW - K  # k-mers of a window, less one
_KEYED = "key long, edge long, id long, tie long, at long, kind int"
_LAST = (1 << 63) - 1
# at: 32 bits of the position, 4 + 4 of the windows' reach


def located(docs: DataFrame) -> DataFrame:
    """id, tie, text: null ids last, and a hash that tells texts of one id apart."""
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("id"),
        F.xxhash64("text").alias("tie"),
        "text",
    )


def _least(values: np.ndarray, reach: int) -> np.ndarray:
    """Index of the least of values i to i + reach, the first of equals."""
    best = np.arange(len(values))
    span, need = 1, reach + 1
    while span < need:
        step = min(span, need - span)
        other = best[np.minimum(np.arange(len(values)) + step, len(values) - 1)]
        best = np.where(values[other] < values[best], other, best)
        span += step
    return best


@F.arrow_udf(BinaryType())
def packed(texts: pa.Array) -> pa.Array:
    """Texts compressed for the way to their places, a third below what shuffles make of them."""
    pack = zstandard.ZstdCompressor(level=1).compress
    return pa.array([pack(t or b"") for t in texts.cast(pa.binary()).to_pylist()], pa.binary())


def _unpacked(column: pa.Array) -> pa.Array:
    unpack = zstandard.ZstdDecompressor().decompress
    return pa.array([unpack(t) for t in column.to_pylist()], pa.large_binary()).cast(pa.large_string())


class Nodes:
    """Occurrences of nodes in a piece: text, position, first and last window, hashes."""

    def __init__(self, piece: W.Piece):
        words = W.split(piece)
        self.firsts = words.firsts(piece.texts)
        self.hash = W.hashes(piece.data, words)
        kmer, _ = W.windows(self.hash, self.firsts, K)
        _, whole = W.windows(self.hash, self.firsts, WINDOW)
        window = np.flatnonzero(whole)
        pick = _least(kmer, _ROOM)[window] if len(kmer) else window
        fresh = np.ones(len(window), bool)
        fresh[1:] = (pick[1:] != pick[:-1]) | (words.text[window[1:]] != words.text[window[:-1]])
        run = np.flatnonzero(fresh)
        self.low = window[run]
        self.high = window[np.append(run[1:], len(window)) - 1] if len(run) else window[run]
        self.at = pick[run]
        self.text = words.text[self.low]
        self.node = kmer[self.at]
        power, inverse = W._powers(len(self.hash) + 1)
        self.inverse = inverse
        self.total = np.zeros(len(self.hash) + 1, np.uint64)
        np.cumsum(self.hash * power[:-1], out=self.total[1:])

    def content(self, low: np.ndarray, end: np.ndarray, salt: np.ndarray) -> np.ndarray:
        """Hash of words low to end, and of ``salt``."""
        h = (self.total[end] - self.total[low]) * self.inverse[low]
        return W.mix(h + W.mix((salt.astype(np.uint64) << np.uint64(32)) + (end - low).astype(np.uint64)))

    def place(self) -> np.ndarray:
        """Position in the text, and how far its windows reach, as the low bits of ``at``."""
        position = self.at - self.firsts[self.text]
        return position << 8 | (self.at - self.low) << 4 | (self.high - self.low)


def _groups(*keys: np.ndarray) -> np.ndarray:
    """Whether a row differs from the one before it in any key."""
    fresh = np.ones(len(keys[0]), bool)
    fresh[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return fresh


def _repeated(first: np.ndarray, ids: np.ndarray, ties: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rows that stand elsewhere than the first of their group; one document given twice is no repeat."""
    if not len(first):
        return first
    start = np.flatnonzero(first)[np.cumsum(first) - 1]
    return (ids != ids[start]) | (ties != ties[start]) | (at != at[start])


def _batch(*columns: np.ndarray) -> pa.RecordBatch:
    kinds = [pa.int64()] * 5 + [pa.int32()]
    names = ["key", "edge", "id", "tie", "at", "kind"]
    return pa.record_batch(
        [pa.array(c.view(np.int64) if c.dtype == np.uint64 else c, t) for c, t in zip(columns, kinds)], names=names
    )


def _settled(
    node: np.ndarray, edge: np.ndarray, ids: np.ndarray, ties: np.ndarray, at: np.ndarray, fan: int | None
) -> pa.RecordBatch:
    """Rows of a batch: 0 for the node's task, 1 a repeat, 2 straight to the windows."""
    order = np.lexsort((at, ties, ids, edge, node))
    node, edge, ids, ties, at = (c[order] for c in (node, edge, ids, ties, at))
    first = _groups(node, edge)
    kind = _repeated(first, ids, ties, at).astype(np.int32)
    if fan is not None:
        start = np.flatnonzero(_groups(node))
        group = np.cumsum(_groups(node)) - 1
        rank = np.cumsum(first) - np.cumsum(first)[start][group]
        kind[(kind == 0) & (rank >= fan)] = 2
    spread = at.astype(np.uint64) + (ids.astype(np.uint64) + ties.astype(np.uint64)) * np.uint64(31)
    return _batch(np.where(kind == 0, node, W.mix(spread)), edge, ids, ties, at, kind)


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, tie = np.asarray(batch.column("id")), np.asarray(batch.column("tie"))
        held: list[tuple[np.ndarray, ...]] = []
        for piece in W.pieces(batch.column("text")):
            n = Nodes(piece)
            edge = n.content(n.low, n.high + WINDOW, n.at - n.low)
            owner = n.text + piece.first
            held.append((n.node, edge, ids[owner], tie[owner], n.place()))
        if held:
            yield _settled(*(np.concatenate(x) for x in zip(*held)), FAN)


def _sorted_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Batches of rows sorted by key and edge, cut between edges where they can be."""
    rest: list[np.ndarray] | None = None
    for batch in batches:
        rows = [np.asarray(c) for c in batch.columns]
        if rest is not None:
            rows = [np.concatenate(x) for x in zip(rest, rows)]
        if not len(rows[0]):
            continue
        start = int(np.flatnonzero(_groups(rows[0]))[-1])
        if start:
            yield [c[:start] for c in rows]
        rest = [c[start:] for c in rows]
        if len(rest[0]) > 1_000_000:  # a node of very many rows: the first of its last edge stands for what went on
            yield rest
            last = int(np.flatnonzero(_groups(rest[0], rest[1]))[-1])
            rest = [c[last : last + 1] for c in rest]
    if rest is not None and len(rest[0]):
        yield rest


def _branches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeats (kind 1), and first occurrences of the edges of branching nodes (kind 2)."""
    for key, edge, ids, ties, at, kind in _sorted_rows(batches):
        node, first = _groups(key), _groups(key, edge)
        group = np.cumsum(node) - 1
        edges = np.bincount(group, first)[group]
        again = _repeated(first, ids, ties, at)
        out = np.where(kind > 0, kind, np.where(again, 1, np.where(edges > 1, 2, 0))).astype(np.int32)
        keep = (out == 1) | (out == 2) & (first | (kind == 2))
        yield _batch(*(c[keep] for c in (key, edge, ids, ties, at, out)))


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of the given node occurrences: node, window hash, id, place."""
    for batch in batches:
        ids, tie, wanted = np.asarray(batch.column("id")), np.asarray(batch.column("tie")), batch.column("places")
        held: list[tuple[np.ndarray, ...]] = []
        for piece in W.pieces(_unpacked(batch.column("text"))):
            n = Nodes(piece)
            given = wanted.slice(piece.first, piece.texts)
            owner = np.repeat(np.arange(piece.texts), np.asarray(pc.list_value_length(given)))
            position = np.asarray(given.flatten()) >> 8 & 0xFFFFFFFF
            chosen = np.flatnonzero(np.isin(n.at, n.firsts[owner] + position))
            reach = n.high[chosen] - n.low[chosen] + 1
            ends = np.cumsum(reach)
            start = np.repeat(n.low[chosen] - (ends - reach), reach) + np.arange(ends[-1] if len(ends) else 0)
            occurrence = np.repeat(chosen, reach)
            text = n.text[occurrence]
            value = n.content(start, start + WINDOW, n.at[occurrence] - start)
            owner = text + piece.first
            held.append((n.node[occurrence], value, ids[owner], tie[owner], (start - n.firsts[text]) << 8))
        if held:
            yield _settled(*(np.concatenate(x) for x in zip(*held)), None)


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows that stand earlier, too (kind 1)."""
    for key, edge, ids, ties, at, kind in _sorted_rows(batches):
        first = _groups(key, edge)
        keep = (kind == 1) | _repeated(first, ids, ties, at)
        yield _batch(*(c[keep] for c in (key, edge, ids, ties, at)), np.ones(keep.sum(), np.int32))


def _by_node(rows: DataFrame) -> DataFrame:
    return rows.repartition("key").sortWithinPartitions("key", "edge", "id", "tie", "at")


def _per_text(rows: DataFrame) -> DataFrame:
    """r_id, r_tie, places of each document."""
    return rows.groupBy(F.col("id").alias("r_id"), F.col("tie").alias("r_tie")).agg(F.collect_list("at").alias("places"))


def _met(texts: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    return texts.join(_per_text(rows), (F.col("id") == F.col("r_id")) & (F.col("tie") == F.col("r_tie")), how)


def repeats(docs: DataFrame) -> DataFrame:
    """id, tie, at of repeated windows: a place with the reach of its windows around it."""
    texts = located(docs)
    nodes = staged(_by_node(texts.mapInArrow(_edges, _KEYED)).mapInArrow(_branches, _KEYED))
    to_compare = _met(texts.withColumn("text", packed("text")), nodes.filter("kind = 2").select("id", "tie", "at"), "inner").select("id", "tie", "text", "places")
    later = _by_node(to_compare.mapInArrow(_window_rows, _KEYED)).mapInArrow(_later, _KEYED)
    return nodes.filter("kind = 1").select("id", "tie", "at").unionByName(later.select("id", "tie", "at"))


def _keep(piece: W.Piece, places: pa.Array) -> tuple[W.Words, np.ndarray]:
    """Words of a piece, and whether each is left."""
    words = W.split(piece)
    firsts = words.firsts(piece.texts)
    given = places.slice(piece.first, piece.texts)
    owner = np.repeat(np.arange(piece.texts), np.asarray(pc.fill_null(pc.list_value_length(given), 0)))
    at = np.asarray(given.flatten())
    low = firsts[owner] + (at >> 8 & 0xFFFFFFFF) - (at >> 4 & 15)
    end = low + (at & 15) + WINDOW
    cover = np.zeros(len(words.text) + 1, np.int64)
    np.add.at(cover, low, 1)
    np.add.at(cover, end, -1)
    return words, np.cumsum(cover[:-1]) == 0


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        removed, digests, counts = [], [], []
        for piece in W.pieces(_unpacked(batch.column("text"))):
            words, left = _keep(piece, batch.column("places"))
            data = piece.data.tobytes()
            firsts = words.firsts(piece.texts)
            spans = list(zip(words.start.tolist(), words.end.tolist(), left.tolist()))
            for t in range(piece.texts):
                mine = spans[firsts[t] : firsts[t + 1]]
                digests.append(hashlib.sha256(b" ".join([data[a:b] for a, b, k in mine if k])).hexdigest())
                removed.append(sum(not k for _, _, k in mine))
                counts.append(len(mine))
        yield pa.record_batch(
            [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())],
            names=["doc_id", "n_words", "n_removed", "kept_sha256"],
        )


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for piece in W.pieces(_unpacked(batch.column("text"))):
            words, left = _keep(piece, batch.column("places"))
            data, firsts = piece.data.tobytes(), words.firsts(piece.texts)
            for t in range(piece.texts):
                mine = range(firsts[t], firsts[t + 1])
                out.append(b" ".join([data[words.start[w] : words.end[w]] for w in mine if left[w]]).decode())
        yield batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(out, pa.string())).drop_columns(["places"])


def _with_places(docs: DataFrame, columns: list[Column]) -> DataFrame:
    rows = docs.select(*columns, F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("id"),
                       F.xxhash64("text").alias("tie"))
    return _met(rows, repeats(docs), "left").drop("id", "tie", "r_id", "r_tie")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (kept words joined by a blank) of every document."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    met = _with_places(docs, [F.col("doc_id"), packed("text").alias("text")])
    return met.mapInArrow(_digest, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string")


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, text: the kept words of every document, joined by a blank."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    met = _with_places(docs, [F.col("doc_id"), packed("text").alias("text")])
    return met.mapInArrow(_cut, f"doc_id {kind}, text string")
