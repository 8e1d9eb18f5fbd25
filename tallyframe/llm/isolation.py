"""Quality rules: an isolation forest on rule statistics.

Every whole text gets the statistics of the usual quality rules: words, their
characters, symbols, repeated lines, words in repeated 3-word windows, capitals
and other marks.  Two fixed rules reject by themselves (``base_failed``).  The
others are judged together: trees of random splits over the statistics isolate an
unusual document after few splits, and its mean path length gives an anomaly
score (0.5 ordinary, towards 1 unusual).

The trees are grown on at most ``TREES * TREE_ROWS`` labelled rows (a documented
bound, the first in order of an id hash).  The threshold is calibrated on the
scores of all labelled rows: the one with the most labelled low-quality rows
rejected, less ``GOOD_WEIGHT`` times the good ones, as shares of their kind.

Defined cases: null and empty texts have all statistics 0 and fail the word
count; repeated ids are judged by their own text; an id labelled more than once
takes the majority; without labels of both kinds nothing but the fixed rules
rejects.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from tallyframe.llm import words as W
from tallyframe.llm.labelled import labelled_ids, labelled_texts
from tallyframe.llm.native import free_name, staged

TREES = 100
TREE_ROWS = 256
GOOD_WEIGHT = 10.0
MIN_WORDS = 50
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_MORE = ("n_lines", "n_capitals", "n_marks")
_SYMBOLS = W.byte_table("#*$%&|<>")
_NEWLINE = W.byte_table("\n")
_CAPITALS = W.byte_table(bytes(range(65, 91)))
_MARKS = W.byte_table(bytes(b for b in range(33, 127) if not chr(b).isalnum()))
_NOT_TAIL = (np.arange(256) & 0xC0) != 0x80  # bytes that begin a character


def _ends(total: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return total[bounds[1:]] - total[bounds[:-1]]


def _sums(flags: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])


def _repeats(text: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How often each (text, value) stands there, and whether it is its first."""
    order = np.lexsort((value, text))
    t, v = text[order], value[order]
    fresh = np.ones(len(order), bool)
    fresh[1:] = (t[1:] != t[:-1]) | (v[1:] != v[:-1])
    group = np.cumsum(fresh) - 1
    often, first = np.empty(len(order), np.int64), np.zeros(len(order), bool)
    often[order] = np.bincount(group)[group] if len(group) else 0
    first[order[fresh]] = True  # lexsort keeps text order among equals
    return often, first


def _piece_statistics(piece: W.Piece) -> list[np.ndarray]:
    n, data, bounds = piece.texts, piece.data, piece.bounds
    found = W.split(piece)
    count = found.counts(n)
    begun = _sums(_NOT_TAIL[data] & ~W.BLANK[data])
    lines = W.split(piece, _NEWLINE)
    inked = _sums(~W.BLANK[data])
    lines_kept = inked[lines.end] > inked[lines.start]
    lines = W.Words(lines.text[lines_kept], lines.start[lines_kept], lines.end[lines_kept])
    _, first = _repeats(lines.text, W.hashes(data, lines))
    window, whole = W.windows(W.hashes(data, found), found.firsts(n), 3)
    at = np.flatnonzero(whole)
    often, _ = _repeats(found.text[at], window[at])
    at = at[often > 1]
    cover = np.zeros(len(found.text) + 3, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + 3, -1)
    covered = np.cumsum(cover)[: len(found.text)] > 0
    return [
        count,
        _ends(begun, bounds),
        _ends(_sums(_SYMBOLS[data]), bounds),
        np.bincount(lines.text[~first], minlength=n),
        np.bincount(found.text[covered], minlength=n),
        np.bincount(lines.text, minlength=n),
        _ends(_sums(_CAPITALS[data]), bounds),
        _ends(_sums(_MARKS[data]), bounds),
    ]


@F.arrow_udf(StructType([StructField(c, LongType()) for c in (*BASE, *_MORE)]))
def statistics(texts: pa.Array) -> pa.Array:
    parts = [_piece_statistics(p) for p in W.pieces(texts)]
    columns = [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0) for i in range(len(BASE) + len(_MORE))]
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[*BASE, *_MORE])


def ratios(s: Column) -> Column:
    """What the trees split on: the statistics per word, line or character."""
    per = lambda a, b: s[a] / F.greatest(s[b], F.lit(1))
    return F.array(
        F.log10(s["n_words"] + 1), per("word_chars", "n_words"), per("n_symbols", "word_chars"),
        per("n_dup_lines", "n_lines"), per("n_repeat_words", "n_words"), per("n_capitals", "word_chars"),
        per("n_marks", "word_chars"),
    )


@dataclass
class Forest:
    """Trees as arrays of nodes (tree, node); a leaf has itself as both children."""

    feature: np.ndarray
    cut: np.ndarray
    child: np.ndarray  # tree, node, side
    depth: np.ndarray  # path length that ends in a node
    usual: float

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """Anomaly scores of rows (row, feature)."""
        total = np.zeros(len(rows))
        for feature, cut, child, depth in zip(self.feature, self.cut, self.child, self.depth):
            node = np.zeros(len(rows), np.int32)
            for _ in range(int(np.ceil(np.log2(TREE_ROWS)))):
                side = rows[np.arange(len(rows)), feature[node]] >= cut[node]
                node = child[node, side.astype(np.int8)]
            total += depth[node]
        return 2 ** (-total / len(self.feature) / self.usual)

    def column(self, features: Column) -> Column:
        @F.arrow_udf(DoubleType())
        def score(rows: pa.Array) -> pa.Array:
            flat = np.asarray(rows.flatten()).reshape(len(rows), -1)
            return pa.array(self.scores(flat), pa.float64())

        return score(features)


def _rest(n: int) -> float:
    """Mean path length that n unsplit rows would still need."""
    return 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else float(n == 2)


def grow(rows: np.ndarray, trees: int = TREES, tree_rows: int = TREE_ROWS) -> Forest:
    """Random trees, each on its own draw of rows."""
    rng = np.random.default_rng(11)
    deepest = int(np.ceil(np.log2(tree_rows)))
    size = 2 ** (deepest + 1)
    feature, cut = np.zeros((trees, size), np.int8), np.zeros((trees, size))
    child, depth = np.zeros((trees, size, 2), np.int32), np.zeros((trees, size))
    child[:] = np.arange(size)[None, :, None]
    drawn = min(tree_rows, len(rows))
    for t in range(trees):
        free = 1
        work = [(0, rows[rng.permutation(len(rows))[:drawn]], 0)]
        while work:
            node, mine, level = work.pop()
            low, high = mine.min(0), mine.max(0)
            usable = np.flatnonzero(high > low)
            if level == deepest or not len(usable):
                depth[t, node] = level + _rest(len(mine))
                continue
            f = rng.choice(usable)
            # above the least value, so that both sides have rows
            at = max(rng.uniform(low[f], high[f]), np.nextafter(low[f], high[f]))
            feature[t, node], cut[t, node], child[t, node] = f, at, (free, free + 1)
            right = mine[:, f] >= at
            work += [(free, mine[~right], level + 1), (free + 1, mine[right], level + 1)]
            free += 2
    return Forest(feature, cut, child, depth, max(_rest(drawn), 1.0))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Forest | None:
    """A forest over the labelled sample; None if it has no row."""
    ids = labelled_ids(labels, label, F.lit(True), TREES * TREE_ROWS)
    found = (
        labelled_texts(docs, ids)
        .select("doc_id", "place", ratios(statistics("text")).alias("r"))
        .groupBy("place", "doc_id")
        .agg(F.min("r").alias("r"))
        .toArrow()
        .sort_by([("place", "ascending"), ("doc_id", "ascending")])
    )
    if not found.num_rows:
        return None
    rows = np.stack([np.asarray(x.values) for x in found.column("r")])
    return grow(rows)


def threshold(scored: DataFrame, labels: DataFrame, label: str = "quality") -> float:
    """The score from which a document is rejected, from all labelled rows of (doc_id, score).

    The driver receives counts of scores rounded to three digits.
    """
    marks = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(
        (F.avg(label) >= 0.5).alias("good")
    )
    step = F.floor(F.col("score") * 1000).cast("int").alias("step")
    seen = scored.join(marks, "doc_id").groupBy(step).agg(
        F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad")
    )
    counts = np.zeros((2, 1002))
    for r in seen.collect():
        counts[:, r["step"]] = r["good"], r["bad"]
    if not counts.sum(1).all():
        return 2.0
    # share of either kind at or above each step
    good, bad = (c[::-1].cumsum()[::-1] / c.sum() for c in counts)
    return int(np.argmax(bad - GOOD_WEIGHT * good)) / 1000


def with_scores(docs: DataFrame, forest: Forest | None) -> DataFrame:
    """``docs`` with the base statistics, base_failed and score; such columns are replaced."""
    docs = docs.drop(*BASE, "base_failed", "score")
    s, features = free_name(docs, "s", "features")
    out = docs.withColumn(s, statistics("text")).select(
        *(f"`{c}`" for c in docs.columns), *(F.col(s)[c].alias(c) for c in BASE), ratios(F.col(s)).alias(features)
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    score = forest.column(F.col(features)) if forest else F.lit(0.0)
    return out.withColumn("base_failed", failed).withColumn("score", score).drop(features)


def _kept(at: float) -> Column:
    return ~F.col("base_failed") & (F.col("score") < at)


def judged(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """``docs`` with all their columns, and ``with_scores`` and ``kept`` added."""
    forest = fit(docs, labels, label)
    at = threshold(with_scores(docs.select("doc_id", "text"), forest).select("doc_id", "score"), labels, label)
    return with_scores(docs.drop("kept"), forest).withColumn("kept", _kept(at))


def verdicts(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """doc_id and the columns of ``judged``, without the texts; every text is read once."""
    forest = fit(docs, labels, label)
    out = staged(with_scores(docs.select("doc_id", "text"), forest).drop("text"))
    return out.withColumn("kept", _kept(threshold(out.select("doc_id", "score"), labels, label)))
