"""Toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

N-grams of the lower-cased text's characters are hashed to 2^20 buckets. Over the training rows each bucket's log-count
ratio r = ln((df in toxic + a) / (toxic rows + 2a)) - the same for clean is counted; every bucket whose ratio stands out
(in at least LEAST rows, the chi-square of its counts LEVEL or more) is a feature, with value r * (1 + ln tf), and a
logistic fit over the sparse table of these gives their weights. A score needs one pass over a text's characters, with a
table of 2^20 entries.

The model is fitted on a bounded sample of the labelled documents (linear.SAMPLE_ROWS); how many features there are follows
from the counts alone. Every document is scored whole, a very long one in pieces.

Defined results: null and empty texts have no n-grams and get the score of the bias; a text shorter than the shortest
n-gram likewise; equal texts have equal scores; repeated ids are scored each for itself; without any labels of a class
the score is the share of toxic labels, smoothed towards clean (a quarter without any label), so the class that is there is
predicted; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binloom.llm.common import Roller, durable_table, fold_of, mix64, table, utf8
from binloom.llm.linear import SAMPLE_ROWS, fit_sparse_logistic, labelled_documents, sampled, sigmoid

ORDERS, BUCKET_BITS, SMOOTH, L2 = (3, 4, 5, 6), 20, 1.0, 1.0
#: Rows that a feature is in, and the chi-square (one degree of freedom) that chance reaches in any of 2^20 buckets at 5 %.
LEAST, LEVEL = 3, 29.7
#: Tasks that count n-grams of the (bounded) sample, and characters that one step handles.
TRAIN_TASKS, STEP_CHARS = 8, 1 << 19


def gram_steps(texts: list[str], orders: tuple[int, ...], roll: Roller, step: int = STEP_CHARS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, bool]]:
    """(first row, rows, row, bucket, whether the rows end here) of the n-grams of some texts at a time.

    A text of more than two steps comes in pieces that overlap by the longest n-gram less one; each n-gram is in one."""
    a, reach = 0, max(orders) - 1
    while a < len(texts):
        b, chars = a, 0
        while b < len(texts) and (b == a or chars + len(texts[b]) <= step):
            chars += len(texts[b])
            b += 1
        lowered = [t.lower() for t in texts[a:b]]
        if b > a + 1 or len(lowered[0]) <= 2 * step:
            yield a, b - a, *_grams(lowered, orders, roll, None), True
        else:
            for at in range(0, len(lowered[0]), step):
                yield a, 1, *_grams([lowered[0][at : at + step + reach]], orders, roll, step), at + step >= len(lowered[0])
        a = b


def _grams(texts: list[str], orders: tuple[int, ...], roll: Roller, first: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of the n-grams, of those that begin among the first characters if a number of these is given."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(t) for t in texts])
    row = np.repeat(np.arange(len(texts)), np.diff(np.concatenate([[0], ends])))
    roll.grow(len(codes))
    pre = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(codes.astype(np.uint64) + np.uint64(1)) * roll.up[: len(codes)])])
    rows, buckets = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for n in orders:
        if len(codes) >= n:
            fits = np.arange(n, len(codes) + 1) <= ends[row[: len(codes) - n + 1]]
            if first is not None:
                fits[first:] = False
            h = roll.grams(np.append(pre, pre[-1]), n)[: len(codes) - n + 1][fits] * np.uint64(2 * n + 0x9E3779B97F4A7C15)
            rows.append(row[: len(codes) - n + 1][fits])
            buckets.append((mix64(h) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64))
    return np.concatenate(rows), np.concatenate(buckets)


def _texts(column: pa.Array) -> list[str]:
    return [t.decode("utf-8", "replace") if t else "" for t in column.to_pylist()]


def _counted(texts: list[str], orders: tuple[int, ...], roll: Roller, of: np.ndarray | None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, rows, row, what, count): how often each row has each bucket, or each feature that `of` makes of them."""
    held: list[tuple] = []
    for a, n, row, bucket, done in gram_steps(texts, orders, roll):
        if of is not None:
            bucket = of[bucket]
            row, bucket = row[bucket >= 0], bucket[bucket >= 0]
        key, count = np.unique(row << BUCKET_BITS | bucket, return_counts=True)
        if held or not done:
            held.append((key, count))
            if not done:
                continue
            key, place = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            count = np.bincount(place, np.concatenate([c for _, c in held])).astype(np.int64)
            held = []
        yield a, n, key >> BUCKET_BITS, key & (1 << BUCKET_BITS) - 1, count


def _count_grams(train: DataFrame, orders: tuple[int, ...]) -> DataFrame:
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll, df = Roller(STEP_CHARS), np.zeros((2, 1 << BUCKET_BITS), np.int32)
        for batch in batches:
            y = batch.column(1).to_numpy(zero_copy_only=False)
            for a, _, row, bucket, _ in _counted(_texts(batch.column(0)), orders, roll, None):
                toxic = y[a + row] > 0
                for k in (0, 1):
                    df[k] += np.bincount(bucket[toxic == bool(k)], minlength=1 << BUCKET_BITS).astype(np.int32)
        some = np.flatnonzero(df.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(df[0][some]), pa.array(df[1][some])], ["bucket", "clean", "toxic"])

    return train.mapInArrow(kernel, "bucket int, clean int, toxic int").groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


class ToxicityModel:
    """What a score needs: the table of features, their ratios and weights."""

    def __init__(self, orders: tuple[int, ...], index: np.ndarray, weights: np.ndarray, bias: float):
        self.orders, self.index, self.weights, self.bias = orders, index, weights, bias


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 5, held: int = 0, orders: tuple[int, ...] = ORDERS, level: float = LEVEL, rows: int = SAMPLE_ROWS) -> ToxicityModel:
    """Fit on labelled rows outside the held fold (at most about `rows` of them)."""
    train = durable_table(sampled(labelled_documents(docs, labels, label, folds, held), rows).select("text", "y").repartition(TRAIN_TASKS))
    sizes = {r["y"]: r["n"] for r in train.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    index = np.full(1 << BUCKET_BITS, -1, np.int32)
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        return ToxicityModel(orders, index, np.zeros(0), float(np.log((n1 + 0.5) / (n0 + 1.5))))
    c, t = F.col("clean").cast("double"), F.col("toxic").cast("double")
    total = float(n1 + n0)
    spread = t * F.lit(float(n0)) - c * F.lit(float(n1))
    chi = total * spread * spread / (F.lit(float(n0)) * F.lit(float(n1)) * (c + t) * (F.lit(total) - c - t + 1.0))
    best = _count_grams(train, orders).where((c + t >= LEAST) & (chi >= level)).orderBy("bucket").collect()  # 2^20 at most
    bucket, toxic, clean = (np.array([r[k] for r in best], np.int64) for k in ("bucket", "toxic", "clean"))
    index[bucket] = np.arange(len(best))
    ratio = np.log((toxic + SMOOTH) / (n1 + 2 * SMOOTH)) - np.log((clean + SMOOTH) / (n0 + 2 * SMOOTH))
    sent = docs.sparkSession.sparkContext.broadcast(index)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll = Roller(STEP_CHARS)
        for batch in batches:
            for a, n, row, feature, tf in _counted(_texts(batch.column(0)), orders, roll, sent.value):
                cuts = np.searchsorted(row, np.arange(1, n))
                order = [xxhash.xxh3_64_intdigest(t or b"") >> 1 for t in batch.column(0).slice(a, n).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(a, n), pa.array(order, pa.int64()), pa.array(np.split(feature.astype(np.int32), cuts), pa.list_(pa.int32())), pa.array(np.split(tf.astype(np.int32), cuts), pa.list_(pa.int32()))], ["y", "order", "f", "tf"])

    got = train.mapInArrow(kernel, "y int, order long, f array<int>, tf array<int>").toArrow().combine_chunks()  # bounded by `rows`
    got = got.sort_by([("y", "ascending"), ("order", "ascending")])  # the fit does not depend on the order of arrival
    row = np.repeat(np.arange(got.num_rows, dtype=np.int32), pc.list_value_length(got["f"]).to_numpy())
    feature, tf = (pc.list_flatten(got[c]).to_numpy() for c in ("f", "tf"))
    value = (ratio[feature] * (1 + np.log(tf))).astype(np.float32)
    w = fit_sparse_logistic(row, feature, value, got["y"].to_numpy().astype(float), len(best), L2)
    return ToxicityModel(orders, index, w[:-1] * ratio, float(w[-1]))


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """(doc_id, score) of every whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, roll = sent.value, Roller(STEP_CHARS)
        for batch in batches:
            for a, n, row, feature, tf in _counted(_texts(batch.column(1)), m.orders, roll, m.index):
                total = np.bincount(row, m.weights[feature] * (1 + np.log(tf)) if len(row) else None, minlength=n) + m.bias
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, n), pa.array(sigmoid(total))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8("text").alias("text")).mapInArrow(kernel, "doc_id long, score double")


def op2_nb_ngram_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; learnt from rows outside the fold crc32(doc_id) mod 5 = 0."""
    docs = table(spark, sf_dir, "documents")
    out = score_toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", (fold_of("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
