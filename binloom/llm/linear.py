"""Training rows and logistic fits that the classifiers share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binloom.llm.common import durable, fold_of, utf8

#: A classifier is fitted on about this many labelled documents at most, chosen by a hash of id and text.
SAMPLE_ROWS = 20_000
#: Labels that are sent to all tasks, at most, and rows, or entries of a sparse table, that a step of a fit looks at.
BROADCAST_ROWS, FIT_ROWS, FIT_ENTRIES = 1 << 18, 8192, 1 << 22


def labelled_documents(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int) -> DataFrame:
    """(id, hash, text, y) of documents with a label outside the held fold, each different text of an id once.

    Of several labels of an id the largest counts; nulls are no labels.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (fold_of("doc_id", folds) != held))
    known = known.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(label).cast("int").alias("y"))
    text = utf8("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64(text).alias("hash"), text.alias("text"))
    known = durable(known)
    few = known.count() <= BROADCAST_ROWS  # 12 bytes a row; more labels meet the documents by a shuffle
    return rows.join(F.broadcast(known) if few else known, "id").dropDuplicates(["id", "hash"])


def sampled(rows: DataFrame, bound: int = SAMPLE_ROWS) -> DataFrame:
    """About `bound` of the rows (id, hash) at most, the same ones each time."""
    share = min(1.0, bound / max(rows.count(), 1))
    return rows.where(F.pmod(F.xxhash64("id", "hash", F.lit("sample")), F.lit(1 << 30)) < int(share * (1 << 30)) + (share == 1.0))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * x))


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float, weight: np.ndarray | None = None, bias: bool = True, steps: int = 25) -> np.ndarray:
    """Newton's method for L2-penalised logistic loss; the last weight is the bias (not penalised) if there is one.

    x may be of any number type; it is widened a few rows at a time."""
    n = x.shape[1] + bias
    w, pull = np.zeros(n), np.full(n, l2)
    if bias:
        pull[-1] = 1e-6
    weight = np.ones(len(y)) if weight is None else weight
    for _ in range(steps):
        gradient, curve = pull * w, np.diag(pull)
        for at in range(0, len(y), FIT_ROWS):
            part = x[at : at + FIT_ROWS].astype(np.float32)
            if bias:
                part = np.hstack([part, np.ones((len(part), 1), np.float32)])
            p, k = sigmoid(part @ w), weight[at : at + FIT_ROWS]
            gradient += part.T @ (k * (p - y[at : at + FIT_ROWS]))
            curve += (part * (k * np.maximum(p * (1 - p), 1e-6))[:, None].astype(np.float32)).T @ part
        step = np.linalg.solve(curve, gradient)
        biggest = np.abs(step).max(initial=0.0)
        w -= step * min(1.0, 4.0 / max(biggest, 1e-12))
        if biggest < 1e-4:
            break
    return w


def fit_sparse_logistic(row: np.ndarray, feature: np.ndarray, value: np.ndarray, y: np.ndarray, width: int, l2: float, steps: int = 40) -> np.ndarray:
    """L2-penalised logistic loss over a sparse table of (row, feature, value): Newton steps, each solved by conjugate gradients.

    The last of width + 1 weights is the bias (not penalised). No table of features by features is made."""
    n, pull = len(y), np.full(width + 1, l2)
    pull[-1] = 1e-6
    cuts = [slice(at, at + FIT_ENTRIES) for at in range(0, len(row), FIT_ENTRIES)]
    row, feature = row.astype(np.intp), feature.astype(np.intp)

    def forward(w: np.ndarray) -> np.ndarray:
        return sum((np.bincount(row[c], value[c] * w[feature[c]], minlength=n) for c in cuts), np.full(n, w[-1]))

    def back(r: np.ndarray, power: int = 1) -> np.ndarray:
        return np.append(sum((np.bincount(feature[c], value[c] ** power * r[row[c]], minlength=width) for c in cuts), np.zeros(width)), r.sum())

    def loss(w: np.ndarray, z: np.ndarray) -> float:
        return float((np.logaddexp(0.0, z) - y * z).sum() + (pull * w * w).sum() / 2)

    w = np.zeros(width + 1)
    z = forward(w)
    now, first = loss(w, z), None
    for _ in range(steps):
        p = sigmoid(z)
        gradient = pull * w + back(p - y)
        size = float(np.abs(gradient).max())
        first = first or size
        if size <= 1e-4 * first:
            break
        curve = np.maximum(p * (1 - p), 1e-6)
        scale = pull + back(curve, 2)
        step, left = np.zeros(width + 1), gradient.copy()
        along = near = left / scale
        goal = (left @ near) * 0.25**2
        for _ in range(100):
            bent = pull * along + back(curve * forward(along))
            share = (left @ near) / (along @ bent)
            before = left @ near
            step, left = step + share * along, left - share * bent
            near = left / scale
            if left @ near <= goal:
                break
            along = near + (left @ near) / before * along
        for half in range(30):  # a full step, halved until the loss falls
            z2 = forward(w - step / 2**half)
            after = loss(w - step / 2**half, z2)
            if after < now:
                break
        else:
            break
        fell, w, z, now = now - after, w - step / 2**half, z2, after
        if fell <= 1e-4 * now:
            break
    return w
