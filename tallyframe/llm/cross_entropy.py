"""LM scoring: cross-entropy difference of a target and a background model.

Both are bigram models with absolute discounts over one vocabulary and one set of
bigrams; only their counts differ.  The background counts every document, the
target those that a condition marks.  A document's score is its mean loss per
word under the target less that under the background: the lower, the more like
the target.

``corpus_scored`` counts and scores one corpus with every word and every bigram
(see there).  ``fit`` and ``scored`` are for other texts than those counted: a
model that every task holds, cut to a bound that holds for any corpus.  Its
vocabulary is every word that makes up at least ``WORD_SHARE`` of all words; all
other words are one word "rare".  Bigrams of at least ``PAIR_SHARE`` of all are
kept; others back off to single words.

Words are runs outside blanks, A-Z in lower case, told apart by 64-bit hashes.
Null and empty texts have losses and score 0.  Without a marked document the
target knows no word, and its loss is that of a uniform choice.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from tallyframe.llm import words as W
from tallyframe.llm.native import free_name, staged
from tallyframe.session import scratch_path

WORD_SHARE = 10_000  # a vocabulary word is at least one in so many words
PAIR_SHARE = 1_000_000  # a kept bigram is at least one in so many
DISCOUNT = 0.75
BROADCAST_IDS = 1_000_000
FREQUENT = 500_000  # words whose counts every task of corpus_scored holds, at most
COMMON = 500_000  # a bigram of at least one in so many stays off the shuffle
SAMPLE = 0.1  # of the rows, to find such bigrams
BUCKET = 1_000_000  # words of a bucket
_CHUNK = 1_000_000
_SMALL = 1 << 16  # bytes that are compressed at once
_RESULT = StructType(
    [StructField("n_words", LongType()), StructField("target_loss", DoubleType()), StructField("background_loss", DoubleType())]
)


def _word_hashes(piece: W.Piece) -> tuple[W.Words, np.ndarray]:
    found = W.split(piece)
    return found, W.hashes(piece.data, found, W.LOWER).view(np.int64)


def _tally(keys: list[np.ndarray], marks: list[np.ndarray]) -> pa.RecordBatch:
    """Distinct keys with their count, and their count among marked ones."""
    found, at = np.unique(np.concatenate(keys), return_inverse=True)
    n = np.bincount(at, minlength=len(found)).astype(np.int64)
    marked = np.bincount(at, np.concatenate(marks), len(found)).astype(np.int64)
    return pa.record_batch([pa.array(found), pa.array(n), pa.array(marked)], names=["key", "n", "n_target"])


@dataclass
class Vocabulary:
    """Sorted word hashes; "rare" and "start" are the two numbers after them."""

    words: np.ndarray

    def pairs(self, piece: W.Piece) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, number of the word before, number of the word; for every word."""
        found, h = _word_hashes(piece)
        rare = len(self.words)
        at = np.searchsorted(self.words, h)
        number = np.where(np.append(self.words, 0)[at] == h, at, rare)
        number[at == rare] = rare
        before = np.empty_like(number)
        before[1:] = number[:-1]
        firsts = found.firsts(piece.texts)[:-1]
        before[firsts[firsts < len(number)]] = rare + 1
        return found.text, before, number

    @property
    def size(self) -> int:
        return len(self.words) + 2


def _counted(rows: DataFrame, keys) -> DataFrame:
    """key, n, n_target over all rows (text, marked); ``keys`` gives text and key of each word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marked = np.asarray(batch.column("marked").cast(pa.int8()))
            found, marks, held = [], [], 0
            for piece in W.pieces(batch.column("text")):
                text, key = keys(piece)
                found.append(key)
                marks.append(marked[text + piece.first])
                held += len(key)
                if held > 2_000_000:
                    yield _tally(found, marks)
                    found, marks, held = [], [], 0
            if found:
                yield _tally(found, marks)

    out = rows.select("text", "marked").mapInArrow(count, "key long, n long, n_target long")
    return out.groupBy("key").agg(F.sum("n").alias("n"), F.sum("n_target").alias("n_target"))


@dataclass
class Model:
    vocabulary: Vocabulary
    pair: np.ndarray  # kept bigrams, ascending
    share: np.ndarray  # (model, bigram): discounted share, 0 at the end
    rest: np.ndarray  # (model, word): what a history leaves to single words
    single: np.ndarray  # (model, word): likelihood of a single word

    def losses(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words, and mean loss per word under target and background, of each text."""
        counts, target, background = [], [], []
        for piece in W.pieces(texts):
            text, before, word = self.vocabulary.pairs(piece)
            key = before * self.vocabulary.size + word
            at = np.searchsorted(self.pair, key)
            at[np.append(self.pair, -1)[at] != key] = len(self.pair)
            n = np.bincount(text, minlength=piece.texts)
            counts.append(n)
            for out, share, rest, single in zip((target, background), self.share, self.rest, self.single):
                loss = -np.log(share[at] + rest[before] * single[word])
                out.append(np.bincount(text, loss, piece.texts) / np.maximum(n, 1))
        return tuple(np.concatenate(x) if x else np.zeros(0) for x in (counts, target, background))


def fit(docs: DataFrame, word_share: int = WORD_SHARE, pair_share: int = PAIR_SHARE) -> Model:
    """Count both models over rows (text, marked)."""
    by_hash = lambda piece: (lambda found, h: (found.text, h))(*_word_hashes(piece))
    words = _counted(docs, by_hash).persist()
    try:
        total, total_target = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("n_target"), F.lit(0))).first()
        frequent = words.filter(F.col("n") * word_share >= total).toArrow().sort_by("key")
    finally:
        words.unpersist()
    vocabulary = Vocabulary(np.asarray(frequent.column("key")))

    def by_number(piece: W.Piece) -> tuple[np.ndarray, np.ndarray]:
        text, before, word = vocabulary.pairs(piece)
        return text, before * vocabulary.size + word

    pairs = _counted(docs, by_number).persist()
    try:
        history = F.floor(F.col("key") / vocabulary.size).cast("long").alias("before")
        before = pairs.groupBy(history).agg(F.sum("n").alias("n"), F.sum("n_target").alias("n_target")).toArrow()
        kept = pairs.filter(F.col("n") * pair_share >= total).toArrow().sort_by("key")
    finally:
        pairs.unpersist()
    key = np.asarray(kept.column("key"))
    shares, rests, singles = [], [], []
    for name, all_words in (("n_target", total_target), ("n", total)):
        n = np.append(np.asarray(frequent.column(name)), 0.0)
        n[-1] = all_words - n.sum()
        singles.append(np.append((n + 0.5) / (all_words + 0.5 * len(n)), 0))
        histories = np.zeros(vocabulary.size)
        histories[np.asarray(before.column("before"))] = np.asarray(before.column(name))
        mine = np.maximum(np.asarray(kept.column(name)) - DISCOUNT, 0) / np.maximum(histories[key // vocabulary.size], 1)
        shares.append(np.append(mine, 0))
        rests.append(1 - np.bincount(key // vocabulary.size, mine, vocabulary.size))
    return Model(vocabulary, key, np.stack(shares), np.maximum(np.stack(rests), 1e-9), np.stack(singles))


def marked_documents(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id, text, marked: whether the id is among ``ids`` (doc_id).

    Few ids, by their count, are broadcast; more are joined by shuffle.
    """
    ids = ids.filter("doc_id is not null").select("doc_id", F.lit(True).alias("found")).distinct()
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    met = docs.select("doc_id", "text").join(ids, "doc_id", "left")
    return met.select("doc_id", "text", F.coalesce("found", F.lit(False)).alias("marked"))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with n_words, target_loss, background_loss, score; such columns are replaced."""
    added = ["n_words", "target_loss", "background_loss", "score"]
    docs = docs.drop(*added)
    (s,) = free_name(docs, "s")

    @F.arrow_udf(_RESULT)
    def losses(texts: pa.Array) -> pa.Array:
        n, target, background = model.losses(texts)
        columns = [pa.array(n, pa.int64()), pa.array(target, pa.float64()), pa.array(background, pa.float64())]
        return pa.StructArray.from_arrays(columns, names=added[:3])

    out = docs.withColumn(s, losses("text"))
    return out.select(
        *(f"`{c}`" for c in docs.columns), *(F.col(s)[c].alias(c) for c in added[:3]),
        (F.col(s)["target_loss"] - F.col(s)["background_loss"]).alias("score"),
    )


def _widths(columns: list[np.ndarray]) -> list[int]:
    """Bytes that the values of each integer column need."""
    spans = [(int(c.min(initial=0)), int(c.max(initial=0))) for c in columns]
    return [8 if low < 0 else -(-high.bit_length() // 8) for low, high in spans]


def _pack(columns: list[np.ndarray], widths: list[int] | None = None) -> bytes:
    """Integer columns, compressed byte place by byte place; few bytes all at once."""
    columns = [np.ascontiguousarray(c, np.int64) for c in columns]
    widths = _widths(columns) if widths is None else widths
    raw = [c.view(np.uint8).reshape(-1, 8).T[:width] for c, width in zip(columns, widths)]
    if sum(x.size for x in raw) < _SMALL:
        places = [b"".join(x.tobytes() for x in raw)]
    else:
        places = [place.tobytes() for x in raw for place in x]
    places = [min(x, pa.compress(x, "zstd", asbytes=True), key=len) for x in places]
    return b"".join([bytes(widths), np.array([len(x) for x in places], np.uint32).tobytes(), *places])


def _unpack(data: bytes | pa.Buffer, lengths: list[int]) -> list[np.ndarray]:
    data = pa.py_buffer(data)
    at = len(lengths)
    widths = data.slice(0, at).to_pybytes()
    raw = [n for n, width in zip(lengths, widths) for _ in range(width)]
    small = sum(raw) < _SMALL
    raw = [sum(raw)] if small else raw
    sizes = np.frombuffer(data.slice(at, 4 * len(raw)), np.uint32).tolist()
    at += 4 * len(raw)
    places = []
    for n, size in zip(raw, sizes):
        part = data.slice(at, size)
        places.append(np.frombuffer(part if size == n else pa.decompress(part, n, "zstd"), np.uint8))
        at += size
    if small:
        ends = np.cumsum([n * width for n, width in zip(lengths, widths)]).tolist()
        parts = (places[0][end - n * width : end].reshape(width, n) for n, width, end in zip(lengths, widths, ends))
    else:
        rest = iter(places)
        parts = ([next(rest) for _ in range(width)] for width in widths)
    out = []
    for n, part in zip(lengths, parts):
        column = np.zeros((n, 8), np.uint8)
        for i, place in enumerate(part):
            column[:, i] = place
        out.append(column.view(np.int64).ravel())
    return out


def _sums(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, ascending, and the sum of each value by key."""
    found, at = np.unique(key, return_inverse=True)
    return found, *(np.bincount(at, v, len(found)) for v in values)


def _run_sums(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """As ``_sums``, of keys that ascend."""
    first = np.flatnonzero(np.diff(key, prepend=~key[:1]))
    return key[first], *(np.add.reduceat(v, first, dtype=float) if len(first) else np.zeros(0) for v in values)


def _order(before: np.ndarray, word: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Order by word before, word and text; sorted as one number if that fits 63 bits."""
    rare = np.unique(np.concatenate([c[c < 0] for c in (before, word)]))
    top = int(max(before.max(initial=0), word.max(initial=0))) + len(rare)
    word_bits, text_bits = top.bit_length(), int(text.max(initial=0)).bit_length()
    if 2 * word_bits + text_bits > 63:
        return np.lexsort((text, word, before))
    key = text.copy()
    for column, shift in ((word, text_bits), (before, text_bits + word_bits)):
        number = column + len(rare)
        low = np.flatnonzero(column < 0)
        number[low] = np.searchsorted(rare, column[low])
        key |= number << shift
    return np.argsort(key)


def _found(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Place of each wanted number in ascending ``keys``, or -1."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


@dataclass
class Routes:
    """Where the bigrams of a corpus are counted.

    A frequent word is numbered by its place in ``words``; "start" is the number
    after them; any other word is a negative number made of its hash.
    """

    words: np.ndarray
    common: np.ndarray  # bigrams of frequent words that stay off the shuffle, ascending
    buckets: int

    @property
    def size(self) -> int:
        return len(self.words) + 1

    def pairs(self, piece: W.Piece) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, number of the word before, number of the word; for every word."""
        found, h = _word_hashes(piece)
        own, place = np.unique(h, return_inverse=True)  # lookups in order stay in the cache
        at = _found(self.words, own)
        number = np.where(at >= 0, at, own | np.int64(-(1 << 63)))[place]
        before = np.empty_like(number)
        before[1:] = number[:-1]
        firsts = found.firsts(piece.texts)[:-1]
        before[firsts[firsts < len(number)]] = len(self.words)
        return found.text, before, number

    def place(self, before: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Place among the common bigrams, or -1."""
        key = np.where((before >= 0) & (word >= 0), before * self.size + word, -1)
        return np.asarray(pc.index_in(pa.array(key), pa.array(self.common)).fill_null(-1))

    def bucket(self, before: np.ndarray, word: np.ndarray) -> np.ndarray:
        """All rows of a bigram are in one bucket, and all of a rare second word."""
        key = np.where(word < 0, word, np.where(before < 0, before, before * self.size + word))
        return (W.mix(key.view(np.uint64)) % np.uint64(self.buckets)).astype(np.int64)

    def dealt(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(bucket, m, k, data): m bigrams of k texts; k = -1 for counts of common bigrams."""

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            b, m, k, data = zip(*rows) if rows else ((), (), (), ())
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary())
            return pa.record_batch([pa.array(x, t) for x, t in zip((b, m, k, data), kinds)], names=["bucket", "m", "k", "data"])

        tallies = np.zeros((2, len(self.common)))  # of all rows, of marked ones
        by_bucket = np.min_scalar_type(self.buckets)

        def flush(text, before, word, keys, marked) -> pa.RecordBatch:
            order = _order(before, word, text)
            text, before, word = text[order], before[order], word[order]
            new = np.ones(len(text), bool)
            new[1:] = (text[1:] != text[:-1]) | (word[1:] != word[:-1]) | (before[1:] != before[:-1])
            n = np.diff(np.append(np.flatnonzero(new), len(text)))
            text, before, word = text[new], before[new], word[new]
            place = self.place(before, word)
            met = place >= 0
            for tally, x in zip(tallies, (n[met], n[met] * marked[text[met]])):
                tally += np.bincount(place[met], x, len(tally))
            bucket = self.bucket(before[~met], word[~met])
            order = np.argsort(bucket.astype(by_bucket), kind="stable")
            bucket, (text, before, word, n) = bucket[order], (x[~met][order] for x in (text, before, word, n))
            own, at = np.unique(bucket << 32 | text, return_inverse=True)  # the texts of each bucket
            start = np.flatnonzero(np.diff(bucket, prepend=-1))
            end = np.append(start[1:], len(bucket))
            first = np.searchsorted(own, bucket[start] << 32)
            last = np.append(first[1:], len(own))
            at -= np.repeat(first, end - start)
            steps = np.diff(before, prepend=np.int64(0))
            steps[start] = before[start]
            texts = own & 0xFFFFFFFF
            pairs, texts = (steps, word, at, n), (keys[texts], marked[texts])
            widths = _widths([*pairs, *texts])
            rows = []
            for b, i, j, u, v in zip(*(x.tolist() for x in (bucket[start], start, end, first, last))):
                rows.append((b, j - i, v - u, _pack([*(x[i:j] for x in pairs), *(x[u:v] for x in texts)], widths)))
            return batch_of(rows)

        for batch in batches:
            keys = np.asarray(batch.column("text_key"))
            marked = np.asarray(batch.column("marked").cast(pa.int8())).astype(np.int64)
            parts, held = [], 0
            for piece in W.pieces(batch.column("text")):
                text, before, word = self.pairs(piece)
                parts.append((text + piece.first, before, word))
                held += len(text)
                if held > _CHUNK:
                    yield flush(*map(np.concatenate, zip(*parts)), keys, marked)
                    parts, held = [], 0
            if held:
                yield flush(*map(np.concatenate, zip(*parts)), keys, marked)
        found = np.flatnonzero(tallies[0])
        found = found[np.argsort(found % self.buckets, kind="stable")]
        cuts = np.flatnonzero(np.diff(found % self.buckets)) + 1
        split = np.split(found, cuts) if len(found) else []
        yield batch_of([(own[0] % self.buckets, len(own), -1, _pack([own, *tallies[:, own]])) for own in split])


@dataclass
class Bucket:
    """The bigrams of a bucket, their counts in the corpus and among marked texts, and the texts of each."""

    before: np.ndarray
    word: np.ndarray
    counts: np.ndarray  # (model, bigram)
    rows: np.ndarray  # texts of each bigram
    at: np.ndarray  # their place in ``keys``
    n: np.ndarray
    keys: np.ndarray
    common: list[np.ndarray]  # number, count, count among marked texts

    @classmethod
    def of(cls, rows: pa.Table) -> Bucket:
        none = np.zeros(0, np.int64)
        parts, texts, tallies, held = [(none,) * 5], [none], [(none,) * 3], 0
        for m, k, data in _rows(rows, "m", "k", "data"):
            if k < 0:
                tallies.append(_unpack(data, [m] * 3))
                continue
            steps, word, at, n, keys, marked = _unpack(data, [m] * 4 + [k] * 2)
            parts.append((np.cumsum(steps), word, n, at + held, n * marked[at]))
            texts.append(keys)
            held += k
        before, word, n, at, n_target = (np.concatenate(x) for x in zip(*parts))
        del parts
        keys, place = np.unique(np.concatenate(texts), return_inverse=True)
        at = place[at]
        order = _order(before, word, at)
        before, word, n, at, n_target = before[order], word[order], n[order], at[order], n_target[order]
        new = np.ones(len(word), bool)
        new[1:] = (word[1:] != word[:-1]) | (before[1:] != before[:-1])
        first = np.flatnonzero(new)
        counts = np.zeros((2, len(first)))
        if len(first):
            for count, x in zip(counts, (n_target, n)):
                np.add.reduceat(x, first, out=count, dtype=float)
        return cls(before[first], word[first], counts, np.diff(np.append(first, len(word))), at, n, keys,
                   list(_sums(*map(np.concatenate, zip(*tallies)))))

    def packed(self) -> tuple[list[int], bytes, bytes]:
        """Lengths; what ``pairs`` reads; the rest."""
        lengths = [len(x) for x in (self.word, self.at, self.keys, self.common[0])]
        steps = np.diff(self.before, prepend=np.int64(0))
        return lengths, _pack([steps, *self.counts, *self.common]), _pack([self.word, self.rows, self.at, self.n, self.keys])

    @staticmethod
    def pairs(lengths: list[int], pairs: bytes) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Words before, counts and common bigrams only."""
        m, _, _, t = lengths
        steps, c_target, c, *common = _unpack(pairs, [m] * 3 + [t] * 3)
        return np.cumsum(steps), np.stack([c_target, c]), common

    @classmethod
    def unpacked(cls, lengths: list[int], pairs: bytes, data: bytes) -> Bucket:
        m, e, k, _ = lengths
        before, counts, common = cls.pairs(lengths, pairs)
        word, rows, at, n, keys = _unpack(data, [m] * 2 + [e] * 2 + [k])
        return cls(before, word, counts, rows, at, n, keys, common)

    def rare_words(self) -> tuple[np.ndarray, ...]:
        """Rare second words, with their counts in both models."""
        rare = self.word < 0
        return _sums(self.word[rare], *self.counts[:, rare])


_LENGTHS = ["m", "e", "k", "t"]
_PACKED = "bucket int, m int, e int, k int, t int, pairs binary, data binary"


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each bucket."""
    for bucket, rows in _by_bucket(batches):
        lengths, *data = Bucket.of(rows).packed()
        numbers = [pa.array([x], pa.int32()) for x in (bucket, *lengths)]
        yield pa.record_batch([*numbers, *(pa.array([x], pa.binary()) for x in data)], names=["bucket", *_LENGTHS, "pairs", "data"])


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """The rows of each bucket, by the first column; buckets arrive one after the other."""
    at, held = None, []
    for batch in batches:
        own = np.asarray(batch.column(0))
        cuts = np.flatnonzero(np.diff(own, prepend=~own[:1]))
        for start, end in zip(cuts, [*cuts[1:], len(own)]):
            if held and own[start] != at:
                yield at, pa.Table.from_batches(held)
                held = []
            at = int(own[start])
            held.append(batch.slice(start, end - start))
    if held:
        yield at, pa.Table.from_batches(held)


def _rows(table: pa.Table, *columns: str) -> Iterator[tuple]:
    """Python numbers, and bytes where they lie in Arrow's memory."""
    return zip(*([x.as_buffer() if pa.types.is_binary(x.type) else x.as_py() for x in table.column(c)] for c in columns))


_PARTS = ["c_target", "c", "d_target", "d"]


def _histories(frequent: bool):
    """Rows (kind, bucket, key, *_PARTS): kind 0 histories, kind 1 common bigrams (with ``frequent`` only)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, table in _by_bucket(batches):
            ((*lengths, pairs),) = _rows(table, *_LENGTHS, "pairs")
            before, (target, every), (key, c, c_target) = Bucket.pairs(lengths, pairs)
            cut = np.searchsorted(before, 0)  # rare words are below 0
            own = slice(cut, None) if frequent else slice(cut)
            parts = [(0, _run_sums(before[own], target[own], every[own], target[own] > 0, every[own] > 0))]
            if frequent:
                parts.append((1, (key, c_target, c, c * 0, c * 0)))
            for kind, columns in parts:
                columns = [pa.array(x.astype(np.int64)) for x in columns]
                n = len(columns[0])
                yield pa.record_batch(
                    [pa.array(np.full(n, kind, np.int32)), pa.array(np.full(n, bucket, np.int32)), *columns],
                    names=["kind", "bucket", "key", *_PARTS],
                )

    return run


@dataclass
class Counts:
    """What every task holds: totals, and counts of frequent words and histories."""

    total: np.ndarray  # (model)
    distinct: int
    words: np.ndarray  # (model, word)
    histories: np.ndarray  # (rows or different bigrams, model, word)

    def loss(self, k: int, counts, rows, kinds, single) -> np.ndarray:
        """Loss of bigrams under model ``k``, from the counts of bigram, history and word."""
        all_rows = np.maximum(rows, 1)
        share = np.maximum(counts - DISCOUNT, 0) / all_rows
        rest = np.maximum(1 - (rows - DISCOUNT * kinds) / all_rows, 1e-9)
        return -np.log(share + rest * (single + 0.5) / (self.total[k] + 0.5 * (self.distinct + 1)))

    def bucket_losses(self, bucket: Bucket, rare: tuple[np.ndarray, ...]) -> Iterator[np.ndarray]:
        """Loss of each bigram of a bucket under either model; ``rare`` has the histories outside the frequent words."""

        def places(number: np.ndarray, keys: np.ndarray, frequent: int) -> np.ndarray:
            out = number.copy()
            low = np.flatnonzero(number < 0)
            out[low] = frequent + _found(keys, number[low])
            return out

        words, *sums = bucket.rare_words()
        before = places(bucket.before, rare[0], self.histories.shape[-1])
        word = places(bucket.word, words, self.words.shape[-1])
        for k in (0, 1):
            rows, kinds = (np.concatenate([self.histories[i, k], rare[1 + 2 * i + k]])[before] for i in (0, 1))
            yield self.loss(k, bucket.counts[k], rows, kinds, np.concatenate([self.words[k], sums[k]])[word])


_SUMS = "text_key long, n long, target double, background double"


def _loss_rows(key, n, target, background) -> pa.RecordBatch:
    return pa.record_batch(
        [pa.array(key), *(pa.array(x.astype(kind)) for x, kind in ((n, np.int64), (target, float), (background, float)))],
        names=["text_key", "n", "target", "background"],
    )


def corpus_scored(
    docs: DataFrame, ids: DataFrame, frequent: int = FREQUENT, common: int = COMMON, sample: float = SAMPLE, bucket: int = BUCKET
) -> DataFrame:
    """``docs`` scored by models of all their own words and bigrams, as ``scored`` does.

    No word and no bigram is left out; the arguments after ``ids`` only choose what
    is counted where.  Tasks hold the counts of at most ``frequent`` words, and of
    bigrams that make up one in ``common`` of a sample.  All other bigrams are
    dealt to buckets by hash, packed with their text's hash; a bucket counts its
    bigrams, gets the counts of the rare words before them by a shuffle, and sends
    back a sum of losses for each text, packed by parts of the texts.  Rows of one text, told
    apart by its 64-bit hash, have the same losses and words.
    """
    spark = docs.sparkSession
    texts = marked_documents(docs, ids).select("text", "marked", F.xxhash64("text").alias("text_key"))
    by_hash = lambda piece: (lambda found, h: (found.text, h))(*_word_hashes(piece))
    counted = _counted(texts, by_hash).persist()
    try:
        zero = F.lit(0)
        total, total_target, distinct = counted.agg(
            F.coalesce(F.sum("n"), zero), F.coalesce(F.sum("n_target"), zero), F.count("*")
        ).first()
        # the least count that at most ``frequent`` words have
        steps = counted.groupBy(F.floor(F.log2("n") * 8).alias("step")).agg(F.count("*").alias("words")).collect()
        held, low = 0, 1 << 20
        for step in sorted(steps, key=lambda r: -r["step"]):
            held += step["words"]
            if held > frequent:
                break
            low = step["step"]
        words = counted.filter(F.floor(F.log2("n") * 8) >= low).toArrow().sort_by("key")
    finally:
        counted.unpersist()
    routes = Routes(np.asarray(words.column("key")), np.zeros(0, np.int64), max(1, -(-total // bucket)))

    def frequent_pairs(piece: W.Piece) -> tuple[np.ndarray, np.ndarray]:
        text, before, word = routes.pairs(piece)
        own = (before >= 0) & (word >= 0)
        return text[own], before[own] * routes.size + word[own]

    some = _counted(texts.sample(sample, seed=1) if sample < 1 else texts, frequent_pairs)
    often = some.filter(F.col("n") * common >= F.lit(int(total * sample))).select("key").toArrow()
    routes.common = np.sort(np.asarray(often.column("key")))

    grouped = lambda df: df.repartition("bucket").sortWithinPartitions("bucket")
    dealt = texts.mapInArrow(routes.dealt, "bucket int, m int, k int, data binary")
    path = scratch_path(spark, "bigrams")  # written once, as buckets are read three times
    grouped(dealt).mapInArrow(_gathered, _PACKED).write.option("compression", "none").parquet(path)
    packed = spark.read.parquet(path)
    parts = "kind int, bucket int, key long, c_target long, c long, d_target long, d long"
    pairs = packed.select("bucket", *_LENGTHS, "pairs")
    seen = pairs.mapInArrow(_histories(True), parts)
    seen = seen.groupBy("kind", "key").agg(*(F.sum(c).alias(c) for c in _PARTS)).toArrow()
    kind, key = np.asarray(seen.column("kind")), np.asarray(seen.column("key"))
    sums = np.stack([np.asarray(seen.column(c)).astype(float) for c in _PARTS])
    histories, tallies = np.zeros((4, routes.size)), np.zeros((2, len(routes.common)))
    histories[:, key[kind == 0]] = sums[:, kind == 0]
    tallies[:, key[kind == 1]] = sums[:2, kind == 1]
    before, word = np.divmod(routes.common, routes.size)
    for k in (0, 1):
        np.add.at(histories[k], before, tallies[k])
        np.add.at(histories[2 + k], before, tallies[k] > 0)
    counts = Counts(
        np.array([total_target, total]), distinct,
        np.stack([np.asarray(words.column(c)).astype(float) for c in ("n_target", "n")]), histories.reshape(2, 2, -1),
    )
    common_losses = [
        counts.loss(k, tallies[k], counts.histories[0, k][before], counts.histories[1, k][before], counts.words[k][word]) for k in (0, 1)
    ]

    # a rare history may stand in several buckets; each gets its counts over all of them
    rare = pairs.mapInArrow(_histories(False), parts)
    same = Window.partitionBy("key")
    rare = rare.select("bucket", "key", *(F.sum(c).over(same).alias(c) for c in _PARTS))
    none = [F.lit(None).cast("long").alias(c) for c in ("key", *_PARTS)]
    met = packed.select("*", *none).unionByName(rare, allowMissingColumns=True)

    def bucket_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
            """Sums by text over the buckets at hand, a row for each part of the texts."""
            keys, *sums = _sums(*map(np.concatenate, zip(*held)))
            group = (W.mix(keys.view(np.uint64)) % np.uint64(routes.buckets)).astype(np.int32)
            order = np.argsort(group, kind="stable")  # keys ascend, so they do within a group
            cuts = np.flatnonzero(np.diff(group[order])) + 1
            parts = [x for x in np.split(order, cuts) if len(x)]
            data = [_pack([np.diff(keys[x], prepend=np.int64(0)), *(c[x].view(np.int64) for c in sums)]) for x in parts]
            return pa.record_batch(
                [pa.array([group[x[0]] for x in parts], pa.int32()), pa.array([len(x) for x in parts], pa.int32()), pa.array(data, pa.binary())],
                names=["part", "m", "data"],
            )

        held: list[tuple[np.ndarray, ...]] = []
        for _, table in _by_bucket(batches):
            ((*lengths, pairs, data),) = _rows(table.filter(pc.field("key").is_null()), *_LENGTHS, "pairs", "data")
            own = Bucket.unpacked(lengths, pairs, data)
            low = table.filter(pc.field("key").is_valid()).select(["key", *_PARTS]).sort_by("key")
            losses = counts.bucket_losses(own, tuple(np.asarray(c) for c in low.columns))
            sums = [np.bincount(own.at, own.n * np.repeat(x, own.rows), len(own.keys)) for x in losses]
            held.append((own.keys, *sums))
            if sum(len(x[0]) for x in held) > _CHUNK:
                yield flush(held)
                held = []
        if held:
            yield flush(held)

    def text_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _by_bucket(batches):
            parts = [_unpack(data, [m] * 3) for m, data in _rows(rows, "m", "data")]
            steps, *sums = (list(x) for x in zip(*parts))
            keys = np.concatenate([np.cumsum(x) for x in steps])
            keys, *sums = _sums(keys, *(np.concatenate(x).view(float) for x in sums))
            yield _loss_rows(keys, np.zeros(len(keys)), *sums)

    def common_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All words of each text, and the losses of its common bigrams."""
        for batch in batches:
            keys = np.asarray(batch.column("text_key"))
            for piece in W.pieces(batch.column("text")):
                text, before, word = routes.pairs(piece)
                n = np.bincount(text, minlength=piece.texts)
                place = routes.place(before, word)
                text, place = text[place >= 0], place[place >= 0]
                own = np.flatnonzero(n)
                sums = (np.bincount(text, x[place], piece.texts)[own] for x in common_losses)
                yield _loss_rows(keys[own + piece.first], n[own], *sums)

    # what a bucket sends back is packed, too: one row for each part of the texts
    back = grouped(met).mapInArrow(bucket_sums, "part int, m int, data binary")
    back = back.repartition("part").sortWithinPartitions("part")
    losses = back.mapInArrow(text_sums, _SUMS).unionByName(
        texts.select("text", "text_key").mapInArrow(common_sums, _SUMS)
    )
    sums = (F.sum(c).alias(c) for c in ("n", "target", "background"))
    losses = staged(losses.groupBy("text_key").agg(F.max("n").alias("n_words"), *sums))
    added = ["n_words", "target_loss", "background_loss", "score"]
    docs = docs.drop(*added)
    key, n, target, background, size = free_name(docs, "text_key", "n", "target", "background", "size")
    losses = losses.select(F.col("text_key").alias(f"r{key}"), F.col("n").alias(n), F.col("target").alias(target),
                           F.col("background").alias(background), F.col("n_words").alias(size))
    out = docs.withColumn(key, F.xxhash64("text"))
    out = out.join(losses, F.col(key) == F.col(f"r{key}"), "left")
    mean = lambda c: F.coalesce(F.col(c) / F.col(n), F.lit(0.0))
    return out.select(
        *(f"`{c}`" for c in docs.columns), F.coalesce(size, F.lit(0).cast("long")).alias("n_words"), mean(target).alias("target_loss"),
        mean(background).alias("background_loss"), (mean(target) - mean(background)).alias("score"),
    )
