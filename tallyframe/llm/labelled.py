"""Labelled rows for classifiers: a bounded, repeatable sample, and calibration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """True if the CRC-32 of the id as text has remainder ``fold``; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def labelled_ids(labels: DataFrame, label: str, usable: Column, rows: int) -> DataFrame:
    """At most ``rows`` usable ids with their label (0 or 1), in order of an id hash.

    An id labelled more than once takes the majority, ties count as 1.  Null ids
    and null labels are left out.
    """
    return (
        labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & usable)
        .groupBy("doc_id")
        .agg((F.avg(label) >= 0.5).cast("int").alias("label"))
        .withColumn("place", F.xxhash64("doc_id"))
        .orderBy("place", "doc_id")
        .limit(rows)
    )


def labelled_texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id, label, place, text of the sampled ids.

    ``ids`` comes from ``labelled_ids`` and so has at most its ``rows`` rows of
    20 bytes, which bounds the broadcast.
    """
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def platt(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve through margins, by Newton steps.

    Targets are pulled in from 0 and 1 as Platt does, so separable margins have a
    finite answer.  With one class only, the curve is flat at its smoothed share.
    """
    pos, neg = float((label == 1).sum()), float((label == 0).sum())
    if not pos or not neg:
        return 0.0, float(np.log((pos + 1) / (neg + 1)))
    target = np.where(label == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    scale = float(np.std(margin)) or 1.0
    x = margin / scale
    a, b = 0.0, float(np.log((pos + 1) / (neg + 1)))
    loss = lambda a, b: float(np.sum(np.logaddexp(0, a * x + b) - target * (a * x + b))) + 1e-6 * a * a
    now = loss(a, b)
    for _ in range(100):
        p = sigmoid(a * x + b)
        g, s = p - target, p * (1 - p) + 1e-9
        grad = np.array([g @ x + 2e-6 * a, g.sum()])
        hess = np.array([[s @ (x * x) + 2e-6, s @ x], [s @ x, s.sum()]])
        step = np.linalg.solve(hess, grad)
        size = 1.0
        while size > 1e-8 and (after := loss(a - size * step[0], b - size * step[1])) > now:
            size /= 2
        if size <= 1e-8 or now - after < 1e-9:
            break
        a, b, now = a - size * step[0], b - size * step[1], after
    return a / scale, b
