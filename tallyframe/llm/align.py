"""Alignment of two tokenizers over a corpus: groups, links and their counts.

Tokenizer A is a byte-level BPE (a ``tokenizers`` JSON file), B a SentencePiece
BPE with byte fallback.  Both encode the same bytes (a space and the text).  Where
a token of A and one of B end at the same byte, the bytes are cut into groups; the
last A and the last B token of a group are linked, as no others end together.

Method.  An identity map, made once, takes an id of A to the id of B with the same
bytes.  A group of one token each that are mapped on each other is regular: it is
counted in a vector over A's vocabulary, in each task and then in sum.  A group of
one token on either side has equal bytes, so no other group can hold a mapped
pair; only the other, irregular groups are counted as pairs.

Passes: (1) encode, cut and pack per document what it links, written to the
shared folder; (2) add up the vectors, and the irregular pairs by a shuffle; (3)
look the counts up.  Regular counts, the highest count of each B id and the
pairs that have 1 / ``SHARE`` of all irregular links or more are bounded by the
vocabularies and by ``SHARE`` and go to the tasks as arrays; all other pairs join
by shuffle, where none of them has more than 1 / ``SHARE`` of the rows.

Documents: null or empty texts, and texts whose tokens do not join to the same
bytes in either tokenizer, have no tokens, and zeros.  Repeated rows are rows of
their own, a null id is kept.  Very long texts are encoded whole; a task holds
texts of about ``PIECE`` bytes, or one text, at a time.  An empty table gives no
rows.  Other columns are ignored.  The files must be on every machine.

``tiktoken`` does A's merges: same vocabulary and pattern as in the JSON file, and
about four times as fast; tests hold it against ``tokenizers``.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.session import scratch_path

FOLDER = "/opt/tokenizers"
A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
SHARE = 100_000
PIECE = 1 << 20

# The pattern that A's byte-level splitter stands for.
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies, and back."""
    plain = [b for b in range(256) if chr(b).isprintable() and chr(b) != " "]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass
class Vocabulary:
    """Bytes of all ids, end to end, with their lengths and starts."""

    blob: np.ndarray
    length: np.ndarray
    start: np.ndarray

    @classmethod
    def of(cls, tokens: list[bytes]) -> Vocabulary:
        length = np.array([len(t) for t in tokens], np.int64)
        return cls(np.frombuffer(b"".join(tokens), np.uint8), length, np.cumsum(length) - length)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of all tokens one after another."""
        length = self.length[ids]
        end = np.cumsum(length)
        return self.blob[np.repeat(self.start[ids] - end + length, length) + np.arange(end[-1] if len(end) else 0)]


class Pair:
    """Both tokenizers and the identity map."""

    def __init__(self, a_path: str, b_path: str):
        with open(a_path, encoding="utf-8") as f:
            letters, vocab = _byte_letters(), json.load(f)["model"]["vocab"]
        ranks = {bytes(letters[c] for c in token): i for token, i in vocab.items()}
        tokens_a = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            tokens_a[i] = token
        self.a = tiktoken.Encoding("a", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        ids_b = range(self.b.vocab_size())
        tokens_b = [
            bytes([int(self.b.id_to_piece(i)[1:-1], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode()
            for i in ids_b
        ]
        self.of_a, self.of_b = Vocabulary.of(tokens_a), Vocabulary.of(tokens_b)
        pieces = {tokens_b[i]: i for i in reversed(ids_b)}  # of equal bytes, a piece before a byte, then the least id
        pieces |= {tokens_b[i]: i for i in reversed(ids_b) if not self.b.is_byte(i)}
        self.same = np.array([pieces.get(t, -1) if t else -1 for t in tokens_a], np.int64)
        names = [[str(i) for i in range(len(v))] for v in (tokens_a, tokens_b)]
        # what follows an id: A , and |   B , and ; and (last of a text) nothing
        self.parts = np.array(
            [n + end for ids, ends in zip(names, (",|", ",; ")) for end in ends for n in ids], dtype=object
        )
        self.parts[-len(tokens_b) :] = names[1]

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of A (with a space before each text) and of B; none for empty texts."""
        a = [self.a.encode_ordinary(" " + t) if t else [] for t in texts]
        b = [ids if t else [] for t, ids in zip(texts, self.b.encode(texts, num_threads=1))]
        return a, b


@lru_cache(maxsize=2)
def pair(a_path: str, b_path: str) -> Pair:
    return Pair(a_path, b_path)


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    n = np.array([len(x) for x in lists], np.int64)
    return np.fromiter(chain.from_iterable(lists), np.int64, int(n.sum())), n


def _keep(ids: np.ndarray, n: np.ndarray, ok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return ids[np.repeat(ok, n)], np.where(ok, n, 0)


def _same_bytes(p: Pair, texts: list[str], a: tuple, b: tuple) -> tuple[tuple, tuple]:
    """Ids of the texts that both tokenizers give back byte by byte; none of the others."""
    data = [(" " + t).encode() if t else b"" for t in texts]
    size = np.array([len(d) for d in data], np.int64)
    for vocabulary, side in ((p.of_a, 0), (p.of_b, 1)):
        ids, n = (a, b)[side]
        ends = np.concatenate([[0], np.cumsum(vocabulary.length[ids])])
        last = np.cumsum(n)
        ok = ends[last] - ends[last - n] == size
        want = np.frombuffer(b"".join(d for d, o in zip(data, ok) if o), np.uint8)
        wrong = np.flatnonzero(vocabulary.joined(_keep(ids, n, ok)[0]) != want)
        ok[np.searchsorted(np.cumsum(np.where(ok, size, 0)), wrong, side="right")] = False
        a, b = _keep(*a, ok), _keep(*b, ok)
        data = [d if o else b"" for d, o in zip(data, ok)]
        size = np.where(ok, size, 0)
    return a, b


@dataclass
class Cut:
    """Groups of consecutive texts: the linked ids, whether regular, and the written form."""

    a_count: np.ndarray
    b_count: np.ndarray
    groups: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray
    regular: np.ndarray
    written: list[str]


def cut(p: Pair, texts: list[str]) -> Cut:
    """Encode and group texts; the written form is ``a1,a2|b1;a3|b2,b3``."""
    a, b = p.encode(texts)
    (a, na), (b, nb) = _same_bytes(p, texts, _flat(a), _flat(b))
    end_a, end_b = np.cumsum(p.of_a.length[a]), np.cumsum(p.of_b.length[b])
    mark = np.zeros((2, (int(end_a[-1]) if len(a) else 0) + 1), bool)
    mark[0, end_a] = True
    mark[1, end_b] = True
    cut_a, cut_b = mark[1, end_a], mark[0, end_b]
    group_a, group_b = np.cumsum(cut_a) - cut_a, np.cumsum(cut_b) - cut_b
    last_a, last_b = np.flatnonzero(cut_a), np.flatnonzero(cut_b)
    link_a, link_b = a[last_a], b[last_b]
    alone = (np.diff(last_a, prepend=-1) == 1) & (np.diff(last_b, prepend=-1) == 1)
    text_a = np.repeat(np.arange(len(texts)), na)
    groups = np.bincount(text_a[last_a], minlength=len(texts))
    # each token's place in the written form: after all of the earlier groups, A before B
    parts = np.empty(len(a) + len(b), np.int64)
    size_a, size_b = len(p.of_a.length), len(p.of_b.length)
    before_b = np.concatenate([[0], last_b + 1])
    parts[np.arange(len(a)) + before_b[group_a]] = a + size_a * cut_a
    kind_b = cut_b.astype(np.int64)
    kind_b[(np.cumsum(nb) - 1)[nb > 0]] = 2
    parts[np.arange(len(b)) + last_a[group_b] + 1] = b + 2 * size_a + size_b * kind_b
    words = p.parts[parts].tolist()
    ends = np.cumsum(na + nb)
    written = ["".join(words[s:e]) for s, e in zip((ends - na - nb).tolist(), ends.tolist())]
    return Cut(na, nb, groups, link_a, link_b, alone & (p.same[link_a] == link_b), written)


def _bags(text: np.ndarray, value: np.ndarray, texts: int) -> tuple[pa.Array, pa.Array]:
    """For each text its distinct values and how often each occurs, as list arrays."""
    order = np.lexsort((value, text))
    text, value = text[order], value[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (value[1:] != value[:-1])
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(text)))
    offsets = np.concatenate([[0], np.cumsum(np.bincount(text[first], minlength=texts))]).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, pa.array(value[first])), pa.ListArray.from_arrays(offsets, pa.array(n))


_PACKED = (
    "row long, doc_id {0}, n_a long, n_b long, n_groups long, groups_sha256 string, {1}"
    "ids array<long>, ids_n array<long>, pairs array<long>, pairs_n array<long>"
)


def pack(docs: DataFrame, a_path: str, b_path: str, written: bool = False) -> DataFrame:
    """A row per document with its counts and its linked ids, written to the shared folder.

    ``ids`` are A's ids of regular links, ``pairs`` the irregular ones as
    a * 2^32 + b, each with their number.  ``written`` adds the groups themselves.
    """
    spark = docs.sparkSession
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pair(a_path, b_path)
        for batch in batches:
            size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(2)), 0).to_numpy(zero_copy_only=False))
            start = 0
            while start < batch.num_rows:
                done = size[start - 1] if start else 0
                end = max(start + 1, int(np.searchsorted(size, done + PIECE, side="right")))
                part = batch.slice(start, end - start)
                start = end
                n = part.num_rows
                c = cut(p, [t or "" for t in part.column(2).to_pylist()])
                text = np.repeat(np.arange(n), c.groups)
                ids, ids_n = _bags(text[c.regular], c.link_a[c.regular], n)
                odd = ~c.regular
                pairs, pairs_n = _bags(text[odd], (c.link_a[odd] << 32) | c.link_b[odd], n)
                digests = [hashlib.sha256(w.encode()).hexdigest() if w else "" for w in c.written]
                out = {
                    "row": part.column(0), "doc_id": part.column(1), "n_a": pa.array(c.a_count), "n_b": pa.array(c.b_count),
                    "n_groups": pa.array(c.groups), "groups_sha256": pa.array(digests, pa.string()),
                    "groups": pa.array(c.written, pa.string()), "ids": ids, "ids_n": ids_n, "pairs": pairs, "pairs_n": pairs_n,
                }
                if not written:
                    del out["groups"]
                yield pa.RecordBatch.from_pydict(out)

    id_type = docs.schema["doc_id"].dataType.simpleString()
    path = scratch_path(spark, "aligned")
    rows.mapInArrow(run, _PACKED.format(id_type, "groups string, " if written else "")).write.parquet(path)
    return spark.read.parquet(path)


def regular_counts(packed: DataFrame, size: int) -> DataFrame:
    """a, n: links of mapped pairs; a vector over the vocabulary in each task, then their sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            ids, n = (batch.column(i).flatten().to_numpy() for i in (0, 1))
            total += np.bincount(ids, n, size).astype(np.int64)
        a = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"a": pa.array(a), "n": pa.array(total[a])})

    return packed.select("ids", "ids_n").mapInArrow(run, "a long, n long").groupBy("a").agg(F.sum("n").alias("n"))


def irregular_counts(packed: DataFrame) -> DataFrame:
    """pair, n: links of all other pairs, added up before and after a shuffle."""
    odd = packed.select(F.inline(F.arrays_zip("pairs", "pairs_n"))).groupBy("pairs").agg(F.sum("pairs_n").alias("n"))
    path = scratch_path(packed.sparkSession, "pairs")
    odd.select(F.col("pairs").alias("pair"), "n").write.parquet(path)
    return packed.sparkSession.read.parquet(path)


@dataclass
class Counts:
    """What the tasks look up: counts by A id, the highest by B id, and common irregular pairs."""

    regular: np.ndarray
    highest: np.ndarray
    pair: np.ndarray
    pair_n: np.ndarray


def counts(packed: DataFrame, odd: DataFrame, same: np.ndarray, size_b: int) -> Counts:
    """Bounded by the vocabularies and ``SHARE``."""
    regular, highest = np.zeros(len(same), np.int64), np.zeros(size_b, np.int64)
    for a, n in regular_counts(packed, len(same)).collect():
        regular[a] = n
        highest[same[a]] = max(highest[same[a]], n)
    b = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))
    for b, n in odd.groupBy(b.alias("b")).agg(F.max("n").alias("n")).collect():
        highest[b] = max(highest[b], n)
    total = odd.agg(F.sum("n")).first()[0] or 0
    hot = odd.filter(F.col("n") * SHARE >= total).orderBy("pair").toPandas()
    return Counts(regular, highest, hot["pair"].to_numpy(np.int64), hot["n"].to_numpy(np.int64))


def _looked_up(packed: DataFrame, found: Counts, same: np.ndarray) -> DataFrame:
    """Documents with what regular and common pairs give, and ``cold``: the other pairs with their number."""
    shared = packed.sparkSession.sparkContext.broadcast((found, same))
    kept = [c for c in packed.columns if c not in ("ids", "ids_n", "pairs", "pairs_n")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, same = shared.value
        mapped = np.where(same >= 0, same, 0)
        best_a = (same >= 0) & (found.regular == found.highest[mapped])
        best_pair = found.pair_n == found.highest[found.pair & 0xFFFFFFFF]
        for batch in batches:
            n = batch.num_rows
            col = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            at = {}
            for name in ("ids", "pairs"):
                lengths = pc.list_value_length(col[name]).to_numpy(zero_copy_only=False)
                at[name] = np.repeat(np.arange(n), lengths)
            ids, ids_n, pairs, pairs_n = (col[c].flatten().to_numpy() for c in ("ids", "ids_n", "pairs", "pairs_n"))
            total, best = np.zeros(n, np.int64), np.zeros(n, np.int64)
            np.add.at(total, at["ids"], ids_n * found.regular[ids])
            np.add.at(best, at["ids"], ids_n * best_a[ids])
            place = np.searchsorted(found.pair, pairs)
            hot = place < len(found.pair)
            hot[hot] = found.pair[place[hot]] == pairs[hot]
            place = place[hot]
            np.add.at(total, at["pairs"][hot], pairs_n[hot] * found.pair_n[place])
            np.add.at(best, at["pairs"][hot], pairs_n[hot] * best_pair[place])
            cold = ~hot
            offsets = np.concatenate([[0], np.cumsum(np.bincount(at["pairs"][cold], minlength=n))]).astype(np.int32)
            out = {c: col[c] for c in kept} | {
                "n_best": pa.array(best), "count_sum": pa.array(total),
                "cold": pa.ListArray.from_arrays(offsets, pa.array(pairs[cold])),
                "cold_n": pa.ListArray.from_arrays(offsets, pa.array(pairs_n[cold])),
            }
            yield pa.RecordBatch.from_pydict(out)

    schema = ", ".join(f"`{c}` {packed.schema[c].dataType.simpleString()}" for c in kept)
    spark, path = packed.sparkSession, scratch_path(packed.sparkSession, "counted")
    packed.mapInArrow(run, f"{schema}, n_best long, count_sum long, cold array<long>, cold_n array<long>").write.parquet(path)
    return spark.read.parquet(path)


def _cold_sums(spark: SparkSession, docs: DataFrame, odd: DataFrame, highest: np.ndarray) -> DataFrame:
    """row, best_more, sum_more: what the pairs beyond the common ones add to each document."""
    tops = [(int(b), int(highest[b])) for b in np.flatnonzero(highest)]
    top = spark.createDataFrame(tops, "b long, top long")
    b = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))
    # a row per id of B's vocabulary bounds the broadcast
    judged = odd.join(F.broadcast(top), b == F.col("b")).select("pair", "n", (F.col("n") == F.col("top")).cast("long").alias("best"))
    rows = docs.select("row", F.inline(F.arrays_zip("cold", "cold_n")))
    return (
        rows.join(judged, rows["cold"] == judged["pair"])
        .groupBy("row")
        .agg(F.sum(F.col("cold_n") * F.col("best")).alias("best_more"), F.sum(F.col("cold_n") * F.col("n")).alias("sum_more"))
    )


def alignment(docs: DataFrame, folder: str = FOLDER, a_file: str = A_FILE, b_file: str = B_FILE, written: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 (and groups, if ``written``) of every document."""
    a_path, b_path = f"{folder}/{a_file}", f"{folder}/{b_file}"
    p = pair(a_path, b_path)
    packed = pack(docs, a_path, b_path, written)
    odd = irregular_counts(packed)
    found = counts(packed, odd, p.same, len(p.of_b.length))
    known = _looked_up(packed, found, p.same)
    more = _cold_sums(docs.sparkSession, known, odd, found.highest)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return known.join(more, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"),
        (F.col("n_best") + zero("best_more")).alias("n_best"), (F.col("count_sum") + zero("sum_more")).alias("count_sum"),
        "groups_sha256", *(["groups"] if written else []),
    )
