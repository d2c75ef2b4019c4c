"""Quality by Bradley-Terry ranking: documents compete in preference pairs, and features explain who wins.

Each text is described by shares of character classes, word repetition and lengths; each of these is cut at training
quantiles into steps, so that a document's worth is a sum of a step function per feature. A good and a bad labelled
document make a preference pair; logistic loss on the difference of their features fits the steps' weights. The accepted
are those above a quantile of the labelled documents' worth, the share of bad labels; the score is a logistic of the
distance to that threshold, set so that a document at the threshold scores `at_threshold`.

The weights are fitted on a bounded sample of the labelled documents (linear.SAMPLE_ROWS), in which each is in ROUNDS pairs
or more; the threshold is of all labelled documents outside the held fold, and every document is scored whole.

Defined results: null, empty and white-space texts have all features 0 and are scored by them; a very long text is
described whole; equal texts have equal scores; without labels of both classes every document scores 1.0 (nothing is
known against it); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binloom.llm.common import buffers, durable, durable_table, fold_of, groups_of, hashes_of, numbered, pick, table, utf8, without
from binloom.llm.linear import SAMPLE_ROWS, fit_logistic, labelled_documents, sampled, sigmoid

ROUNDS, STEPS, L2, AT_THRESHOLD, STEP_BYTES = 4, 12, 1.0, 0.7, 1 << 20
NAMES = ("log_words", "word_bytes", "long_words", "upper", "digits", "ends", "commas", "pipes", "symbols", "other_punct", "wide", "spaces", "lines", "distinct", "distinct_pairs", "repeat_next", "top_word", "caps_words", "capital_words", "line_words")


def _classes() -> np.ndarray:
    out = np.zeros(256, np.int64)  # 0: lower-case letters and controls
    out[0x41:0x5B] = 1
    out[0x30:0x3A] = 2
    for k, chars in ((3, b".!?"), (4, b",;:"), (5, b"|"), (6, b"#$%&*@^~=+<>_\\/{}[]"), (7, b"\"'()-`"), (9, b" \t\r\x0b\x0c"), (10, b"\n")):
        out[list(chars)] = k
    out[0x80:] = 8
    return out


_CLASS, _SPACE = _classes(), np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))


def describe(data: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The features (rows x NAMES) of the texts that the edges cut the bytes into."""
    n, size = len(edges) - 1, np.maximum(np.diff(edges), 1).astype(float)
    kinds = np.zeros(n * 11)
    for at in range(0, len(data), STEP_BYTES):  # a few bytes a byte, also of a very long text
        inside = np.clip(edges, at, min(at + STEP_BYTES, len(data)))
        kinds += np.bincount(np.repeat(np.arange(n) * 11, np.diff(inside)) + _CLASS[data[at : at + STEP_BYTES]], minlength=n * 11)
    kinds = kinds.reshape(n, 11) / size[:, None]
    cut = np.zeros(len(data) + 1, bool)
    cut[edges[:-1]] = True
    word = ~_SPACE[data]
    start = np.flatnonzero(word & (np.concatenate([[True], ~word[:-1]]) | cut[:-1])) if len(data) else np.zeros(0, np.int64)
    cut[edges[1:]] = True
    end = np.flatnonzero(word & (np.concatenate([~word[1:], [True]]) | cut[1:])) + 1 if len(data) else start
    hashes, doc, length = hashes_of(data, start, end), np.searchsorted(edges, start, "right") - 1, end - start
    words = np.bincount(doc, minlength=n)
    safe = np.maximum(words, 1)
    per = lambda mask: np.bincount(doc[mask], minlength=n) / safe
    next_same = np.zeros(len(doc), bool)
    next_same[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
    order = np.lexsort((hashes, doc))
    h, d = hashes[order], doc[order]
    new = np.ones(len(d), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    distinct = np.bincount(d[new], minlength=n)
    top = np.zeros(n)
    np.maximum.at(top, d[new], np.diff(np.append(np.flatnonzero(new), len(d))))
    pair, pd = hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:], doc[:-1]
    inside = doc[1:] == doc[:-1]
    pair, pd = pair[inside], pd[inside]
    order = np.lexsort((pair, pd))
    pair, pd = pair[order], pd[order]
    new = np.ones(len(pd), bool)
    new[1:] = (pair[1:] != pair[:-1]) | (pd[1:] != pd[:-1])
    upper = np.concatenate([[0], np.cumsum((data >= 0x41) & (data < 0x5B), dtype=np.int32)])
    caps = (upper[end] - upper[start]) * 2 >= np.maximum(length, 3)
    lines = kinds[:, 10] * size + 1
    return np.column_stack([
        np.log1p(words), np.bincount(doc, length, minlength=n) / safe, per(length > 12), kinds[:, 1:9], kinds[:, 9], kinds[:, 10],
        distinct / safe, np.bincount(pd[new], minlength=n) / np.maximum(words - 1, 1), per(next_same), top / safe, per(caps),
        per(_CLASS[data[start]] == 1) if len(data) else np.zeros(n), np.log1p(words / lines),
    ])


def _described(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    data, off = buffers(column)
    for a, b in groups_of(off, STEP_BYTES):
        yield a, b, describe(data[off[a] : off[b]], off[a : b + 1] - off[a])


class QualityModel:
    """Cuts of each feature, weights of the steps, and the worth at which a document is accepted."""

    def __init__(self, cuts: list[np.ndarray] | None, weights: np.ndarray, threshold: float, at_threshold: float):
        self.cuts, self.weights, self.threshold, self.at_threshold = cuts, weights, threshold, at_threshold

    def steps(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([(x[:, k, None] >= c).astype(np.float64) for k, c in enumerate(self.cuts)])

    def worth(self, x: np.ndarray) -> np.ndarray:
        return (self.steps(x) * self.weights).sum(axis=1)  # row by row: equal texts, equal scores

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.cuts is None:
            return np.ones(len(x))
        shift = np.log(self.at_threshold / (1 - self.at_threshold))
        return sigmoid(self.worth(x) - self.threshold + shift)


def pairings(good: np.ndarray, bad: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (winner, loser): each of the larger class in `rounds` of them, each of the smaller one in as many or more."""
    draw, n = np.random.default_rng(0), rounds * max(len(good), len(bad))
    dealt = lambda some: np.concatenate([draw.permutation(some) for _ in range(-(-n // len(some)))])[:n]
    return dealt(good), dealt(bad)


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 4, held: int = 2, rows: int = SAMPLE_ROWS, rounds: int = ROUNDS, at_threshold: float = AT_THRESHOLD) -> QualityModel:
    """Fit on labelled rows outside the held fold (the weights on at most about `rows` of them)."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, x in _described(batch.column(2)):
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in (batch.column(0), batch.column(1), batch.column(3))), pa.array(list(x), pa.list_(pa.float64()))], ["id", "hash", "y", "x"])

    described = durable_table(labelled_documents(docs, labels, label, folds, held).select("id", "hash", "text", "y").mapInArrow(kernel, "id long, hash long, y int, x array<double>"))
    got = sampled(described, rows).select("y", "x").toArrow().combine_chunks()  # bounded by `rows`
    y, x = got["y"].to_numpy(), got["x"].combine_chunks().flatten().to_numpy().reshape(got.num_rows, len(NAMES))
    order = np.lexsort((*x.T, y))  # the fit does not depend on the order of arrival
    x, y = x[order], y[order]
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return QualityModel(None, np.zeros(0), 0.0, at_threshold)
    cuts = [np.unique(np.concatenate([np.quantile(part[:, k], np.linspace(0, 1, STEPS + 1)[1:-1]) for part in (x, x[bad])])) for k in range(x.shape[1])]
    model = QualityModel(cuts, np.zeros(0), 0.0, at_threshold)
    z = model.steps(x).astype(np.int8)
    gap, kinds = np.unique(np.column_stack(pairings(good, bad, rounds)), axis=0, return_counts=True)
    delta = z[gap[:, 0]] - z[gap[:, 1]]
    # Every pair has a winner on the left: the loss is ln(1 + exp(-w . difference)).
    model.weights = fit_logistic(delta, np.ones(len(delta)), L2, kinds.astype(float), bias=False)

    def worths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, len(NAMES))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.worth(own))], ["y", "worth"])

    worth = durable(described.select("y", "x").mapInArrow(worths, "y int, worth double"))
    share = worth.agg(F.avg(F.when(F.col("y") == 0, 1.0).otherwise(0.0))).first()[0]
    model.threshold = float(worth.agg(F.percentile_approx("worth", share, 10_000)).first()[0])
    return model


def with_score(docs: DataFrame, model: QualityModel, score: str = "score") -> DataFrame:
    """All columns of docs and the score of the whole text, which takes the place of a column of its name."""
    kept = without(docs.columns, score)
    sent, width = docs.sparkSession.sparkContext.broadcast(model), len(kept)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, x in _described(batch.column(width)):
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns[:width]), pa.array(sent.value.score(x))], [*kept, score])

    schema = docs.select(*pick(kept), F.lit(0.0).cast("double").alias(score)).schema
    return numbered(docs, kept, utf8("text")).mapInArrow(kernel, schema)


def accepted_documents(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents, with all their columns, that score at least the threshold."""
    sent = docs.sparkSession.sparkContext.broadcast(fit_quality(docs, labels, **options))
    columns, width = docs.columns, len(docs.columns)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            rows = pa.RecordBatch.from_arrays(batch.columns[:width], columns)
            for a, b, x in _described(batch.column(width)):
                yield rows.slice(a, b - a).filter(pa.array(model.score(x) >= model.at_threshold))

    return numbered(docs, columns, utf8("text")).mapInArrow(kernel, docs.schema)


def op6_bradley_terry_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; learnt from rows outside the fold crc32(doc_id) mod 4 = 2."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = with_score(docs, fit_quality(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", (fold_of("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= AT_THRESHOLD).cast("int").alias("predicted"))
