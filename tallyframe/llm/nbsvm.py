"""Quality classifier: naive Bayes support vectors.

Features are indicators of token 1- and 2-grams, hashed to ``2**BITS`` buckets.
Each is scaled by its class log-count ratio and the row brought to length 1; a
linear hinge-loss model is then fitted by dual coordinate descent.

Tokens are runs of letters and digits, or runs of other visible characters, so
that symbols stuck to a word count by themselves.  A word equal to one of the
two tokens before it becomes the token "repeat".

The model is fitted on at most ``rows`` labelled rows (a documented bound; the
first in order of an id hash) and scores every whole text.  Null and empty
texts have no feature and get the score of the offset alone.  Without labels
every score is 0.5.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType

from tallyframe.llm import words as W
from tallyframe.llm.labelled import labelled_ids, labelled_texts, platt, sigmoid

BITS = 18
SAMPLE_ROWS = 8000
_REPEAT = np.uint64(0x5BD1E995)
_KINDS = np.where(W.BLANK, 0, np.where(W.NOT_ALNUM, 2, 1)).astype(np.uint8)


def features(piece: W.Piece) -> tuple[np.ndarray, np.ndarray]:
    """Text number and bucket of each distinct feature, in text order."""
    tokens = W.split(piece, kinds=_KINDS)
    h = W.hashes(piece.data, tokens)
    same = np.zeros(len(h), bool)
    for back in (1, 2):
        same[back:] |= (h[back:] == h[:-back]) & (tokens.text[back:] == tokens.text[:-back])
    same &= _KINDS[piece.data[tokens.start]] == 1
    h = np.where(same, _REPEAT, h)
    pair, whole = W.windows(h, tokens.firsts(piece.texts), 2)
    buckets = np.concatenate([W.mix(h + np.uint64(1)), pair[whole]]) >> np.uint64(64 - BITS)
    owner = np.concatenate([tokens.text, tokens.text[whole]])
    key = np.unique(owner.astype(np.int64) << BITS | buckets.astype(np.int64))
    return key >> BITS, key & ((1 << BITS) - 1)


@F.arrow_udf(ArrayType(IntegerType()))
def feature_list(texts: pa.Array) -> pa.Array:
    counts, values = [], []
    for piece in W.pieces(texts):
        owner, bucket = features(piece)
        counts.append(np.bincount(owner, minlength=piece.texts))
        values.append(bucket)
    offsets = np.concatenate([[0], np.cumsum(np.concatenate(counts))]) if counts else np.zeros(1)
    flat = np.concatenate(values) if values else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat.astype(np.int32)))


@dataclass
class Model:
    """Score of a text: a logistic curve over (offset + sum of weights / length)."""

    weight: np.ndarray
    squares: np.ndarray
    offset: float
    slope: float
    shift: float

    def margins(self, texts: pa.Array) -> np.ndarray:
        out = []
        for piece in W.pieces(texts):
            owner, bucket = features(piece)
            total = np.bincount(owner, self.weight[bucket], piece.texts)
            norm = np.sqrt(np.bincount(owner, self.squares[bucket], piece.texts))
            out.append(total / np.maximum(norm, 1e-9) + self.offset)
        return np.concatenate(out) if out else np.zeros(0)

    def column(self, text: Column) -> Column:
        """The score (0 to 1) of a text column; other columns never reach Python."""

        @F.arrow_udf(DoubleType())
        def score(texts: pa.Array) -> pa.Array:
            return pa.array(sigmoid(self.slope * self.margins(texts) + self.shift), pa.float64())

        return score(text)


def log_count_ratios(rows: list[np.ndarray], label: np.ndarray) -> np.ndarray:
    """Smoothed log of the share of a feature among class 1 against class 0."""
    n = np.ones((2, 1 << BITS))
    for r, y in zip(rows, label):
        n[y][r] += 1  # a row names a feature once
    share = n / n.sum(1, keepdims=True)
    return np.log(share[1] / share[0])


def dual_descent(
    rows: list[np.ndarray], ratio: np.ndarray, label: np.ndarray, cost: float = 1.0, epochs: int = 12
) -> tuple[np.ndarray, float]:
    """Weights and offset of a linear hinge-loss model with L2 penalty.

    A row's values are the ratios of its features, brought to length 1; they are
    made anew at each visit, so that memory holds the feature numbers only.
    """
    sign = np.where(label == 1, 1.0, -1.0)
    weight, offset = np.zeros(1 << BITS), 0.0
    alpha = np.zeros(len(rows))
    scale = np.array([1 / max(float(np.sqrt(ratio[r] @ ratio[r])), 1e-9) for r in rows])
    square = np.array([float(ratio[r] @ ratio[r]) * k * k + 1 for r, k in zip(rows, scale)])  # 1: the offset's feature
    order = np.random.default_rng(7)
    for _ in range(epochs):
        most = 0.0
        for i in order.permutation(len(rows)):
            r = rows[i]
            v = ratio[r] * scale[i]
            slack = sign[i] * (weight[r] @ v + offset) - 1
            new = min(max(alpha[i] - slack / square[i], 0.0), cost)
            change = (new - alpha[i]) * sign[i]
            if change:
                weight[r] += change * v
                offset += change
                most = max(most, abs(change))
                alpha[i] = new
        if most < 1e-3 * cost:
            break
    return weight, offset


def _fit(rows: list[np.ndarray], label: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    ratio = log_count_ratios(rows, label)
    weight, offset = dual_descent(rows, ratio, label)
    return weight * ratio, ratio**2, offset


def train(rows: list[np.ndarray], label: np.ndarray, folds: int = 3) -> Model:
    """Fit on distinct feature lists; the curve comes from margins of left-out folds."""
    flat = np.zeros(1 << BITS)
    if len(set(label.tolist())) < 2:
        slope, shift = platt(np.zeros(len(label)), label)
        return Model(flat, flat, 0.0, slope, shift)
    margin = np.zeros(len(rows))
    fold = np.arange(len(rows)) % folds
    for k in range(folds):
        inside = [rows[i] for i in np.flatnonzero(fold != k)]
        if len(set(label[fold != k].tolist())) < 2:
            continue
        weight, squares, offset = _fit(inside, label[fold != k])
        for i in np.flatnonzero(fold == k):
            margin[i] = weight[rows[i]].sum() / max(np.sqrt(squares[rows[i]].sum()), 1e-9) + offset
    slope, shift = platt(margin, label)
    weight, squares, offset = _fit(rows, label)
    return Model(weight.astype(np.float32), squares.astype(np.float32), offset, max(slope, 0.0), shift)


def fit(docs: DataFrame, labels: DataFrame, label: str, usable: Column, rows: int = SAMPLE_ROWS) -> Model:
    """Train on at most ``rows`` labelled rows that ``usable`` (over labels) allows.

    The driver receives their feature numbers only, at most ``2**BITS`` a row.  Rows
    that repeat an id count once (the least feature list).
    """
    sample = labelled_texts(docs, labelled_ids(labels, label, usable, rows))
    found = (
        sample.select("doc_id", "place", "label", feature_list("text").alias("features"))
        .groupBy("doc_id", "place", "label")
        .agg(F.min("features").alias("features"))
        .toArrow()
        .sort_by([("place", "ascending"), ("doc_id", "ascending")])
    )
    label = np.asarray(found.column("label"))
    column = found.column("features").combine_chunks()
    flat, bounds = np.asarray(column.values), np.asarray(column.offsets)
    model = train([flat[a:b] for a, b in zip(bounds[:-1], bounds[1:])], label)
    del found, column, flat
    pa.default_memory_pool().release_unused()
    return model


def classify(
    docs: DataFrame, model: Model, threshold: float = 0.7, score: str = "score", predicted: str = "predicted"
) -> DataFrame:
    """``docs`` with a score and a 0/1 prediction; columns of these names are replaced."""
    kept = docs.drop(score, predicted)
    scored = kept.withColumn(score, model.column(F.col("text")))
    return scored.withColumn(predicted, (F.col(score) >= threshold).cast("int"))
