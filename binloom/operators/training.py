"""Training of the variational autoencoder on contig vectors, with links and must-differ pairs as further losses.

Data-parallel: rows stay in their partitions; in an epoch each partition takes Adam steps of its own from the common
state, and the states are averaged by rows in a tree, so the driver sees at most FAN_IN states however many partitions
there are. A state is the weights, their moments and the running statistics: its size is set by the layers, not by the
data. Rows are dealt by hash of their key and shuffled by (seed, epoch, partition): equal inputs give equal partitions,
and a lost partition is trained again to the same state.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binloom.operators.models import KLD_WEIGHT, KMER_SHARE, LOG_GUARD, LOGVAR
from binloom.sources.store import durable

#: Rows that a partition has in the mean, rows it shuffles at once, and states that are averaged in one task.
PART_ROWS, SHUFFLE_ROWS, FAN_IN = 200_000, 16_384, 16
# Slope below zero, the normalisation's guard, the optimiser's decays and guard, epochs that double batches.
LEAK, NORM_GUARD, DECAYS, ADAM_GUARD, DOUBLINGS = 0.01, 1e-3, (0.9, 0.999), 1e-7, (25, 75, 150, 300)
#: Share of the running statistics that a batch leaves as they were.
KEEP = 0.9

State = dict[str, np.ndarray]


@dataclass(frozen=True)
class Shape:
    """Sizes of the network: a vector is `samples` abundances before `kmers` frequencies."""

    samples: int
    kmers: int
    hidden: int = 512
    latent: int = 64
    layers: int = 2
    dropout: float = 0.0


@dataclass(frozen=True)
class Rates:
    """Step size and the weights of links and of must-differ pairs beside the reconstruction."""

    step: float = 1e-3
    links: float = 1.0
    markers: float = 1.0


def initial_state(shape: Shape, seed: int = 0) -> State:
    """Glorot weights, zero biases, and zero weights of the log variance."""
    rng = np.random.default_rng(seed)
    out: State = {}

    def dense(name: str, a: int, b: int) -> None:
        edge = np.sqrt(6.0 / max(a + b, 1))
        out[f"{name}.w"], out[f"{name}.b"] = rng.uniform(-edge, edge, (a, b)), np.zeros(b)

    for side, first in (("enc", shape.samples + shape.kmers), ("dec", shape.latent)):
        for i in range(shape.layers):
            dense(f"{side}{i}", first if i == 0 else shape.hidden, shape.hidden)
            out[f"{side}{i}.scale"], out[f"{side}{i}.shift"] = np.ones(shape.hidden), np.zeros(shape.hidden)
            out[f"{side}{i}.~mean"], out[f"{side}{i}.~var"] = np.zeros(shape.hidden), np.ones(shape.hidden)
    top = lambda first: shape.hidden if shape.layers else first
    dense("mu", top(shape.samples + shape.kmers), shape.latent)
    dense("logvar", top(shape.samples + shape.kmers), shape.latent)
    out["logvar.w"][:] = 0.0
    dense("out", top(shape.latent), shape.samples + shape.kmers)
    return out


def _forward(s: State, side: str, x: np.ndarray, shape: Shape, rng: np.random.Generator | None) -> tuple[np.ndarray, list]:
    """Through the layers of a side; with rng as in training: statistics of the batch, which move the running ones."""
    kept = []
    for i in range(shape.layers):
        name = f"{side}{i}"
        a = x @ s[f"{name}.w"] + s[f"{name}.b"]
        slope = np.where(a > 0, 1.0, LEAK)
        if rng is not None and shape.dropout:
            slope = slope * (rng.random(a.shape) >= shape.dropout) / (1 - shape.dropout)
        h = a * slope
        mean, var = (h.mean(axis=0), h.var(axis=0)) if rng is not None else (s[f"{name}.~mean"], s[f"{name}.~var"])
        if rng is not None:
            s[f"{name}.~mean"] = KEEP * s[f"{name}.~mean"] + (1 - KEEP) * mean
            s[f"{name}.~var"] = KEEP * s[f"{name}.~var"] + (1 - KEEP) * var
        inv = 1.0 / np.sqrt(var + NORM_GUARD)
        unit = (h - mean) * inv
        kept.append((name, x, slope, inv, unit))
        x = unit * s[f"{name}.scale"] + s[f"{name}.shift"]
    return x, kept


def _backward(s: State, kept: list, d: np.ndarray, grads: State) -> np.ndarray:
    for name, x, slope, inv, unit in reversed(kept):
        grads[f"{name}.scale"], grads[f"{name}.shift"] = (d * unit).sum(axis=0), d.sum(axis=0)
        d = d * s[f"{name}.scale"]
        d = inv * (d - d.mean(axis=0) - unit * (d * unit).mean(axis=0)) * slope
        grads[f"{name}.w"], grads[f"{name}.b"] = x.T @ d, d.sum(axis=0)
        d = d @ s[f"{name}.w"].T
    return d


def _cosine_loss(mu: np.ndarray, y: np.ndarray, positive: bool) -> tuple[float, np.ndarray]:
    """Cross-entropy with cosines of the rows of both halves as logits; `positive` adds one constant positive of logit 1."""
    half = len(mu) // 2
    a, b = mu[:half], mu[half:]
    na, nb = (np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12) for v in (a, b))
    c = ((a / na) * (b / nb)).sum(axis=1, keepdims=True)
    n, y = half + positive, y[:, None]
    total = (np.logaddexp(0.0, c) - y * c).sum() + (np.logaddexp(0.0, 1.0) - 1.0 if positive else 0.0)
    g = (1.0 / (1.0 + np.exp(-c)) - y) / n
    return float(total / n), np.concatenate([g * (b / nb - c * a / na) / na, g * (a / na - c * b / nb) / nb])


def losses_and_gradients(s: State, x: np.ndarray, shape: Shape, rng: np.random.Generator, y: np.ndarray | None = None, reconstruct: bool = True, markers: bool = False, weight: float = 1.0) -> tuple[dict[str, float], State]:
    """The losses of a batch, weighted, and the gradients of their sum.

    With y the batch is pairs, the first ends before the second ones; without `reconstruct` only the pairs count.
    """
    grads: State = {}
    h, below = _forward(s, "enc", x, shape, rng)
    mu = h @ s["mu.w"] + s["mu.b"]
    found: dict[str, float] = {}
    d_mu, d_log = np.zeros_like(mu), np.zeros_like(mu)
    if reconstruct:
        raw = h @ s["logvar.w"] + s["logvar.b"]
        log, free = np.clip(raw, *LOGVAR), (raw >= LOGVAR[0]) & (raw <= LOGVAR[1])
        noise = rng.standard_normal(mu.shape) * np.exp(0.5 * log)
        top, above = _forward(s, "dec", mu + noise, shape, rng)
        o = top @ s["out.w"] + s["out.b"]
        n, k = len(x), shape.samples
        d_out = np.zeros_like(o)
        if k > 1:
            e = np.exp(o[:, :k] - o[:, :k].max(axis=1, keepdims=True))
            soft = e / e.sum(axis=1, keepdims=True)
            found["abundance"] = (1 - KMER_SHARE) * float(-(x[:, :k] * np.log(soft + LOG_GUARD)).sum() / n)
            d_soft = -x[:, :k] / (soft + LOG_GUARD)
            d_out[:, :k] = (1 - KMER_SHARE) / n * soft * (d_soft - (d_soft * soft).sum(axis=1, keepdims=True))
        elif k:
            gap = o[:, :1] - x[:, :1]
            found["abundance"] = (1 - KMER_SHARE) * float((gap**2).sum() / n)
            d_out[:, :1] = (1 - KMER_SHARE) * 2 * gap / n
        if shape.kmers:
            gap = o[:, k:] - x[:, k:]
            found["kmer"] = KMER_SHARE * float((gap**2).mean())
            d_out[:, k:] = KMER_SHARE * 2 * gap / gap.size
        found["kld"] = KLD_WEIGHT * float(-0.5 * (1 + log - mu**2 - np.exp(log)).mean())
        grads["out.w"], grads["out.b"] = top.T @ d_out, d_out.sum(axis=0)
        d_z = _backward(s, above, d_out @ s["out.w"].T, grads)
        d_mu += d_z + KLD_WEIGHT * mu / mu.size
        d_log = (d_z * noise * 0.5 + KLD_WEIGHT * 0.5 * (np.exp(log) - 1) / mu.size) * free
        grads["logvar.w"], grads["logvar.b"] = h.T @ d_log, d_log.sum(axis=0)
    if y is not None:
        loss, d = _cosine_loss(mu, y, markers)
        found["markers" if markers else "links"] = weight * loss
        d_mu += weight * d
    grads["mu.w"], grads["mu.b"] = h.T @ d_mu, d_mu.sum(axis=0)
    _backward(s, below, d_mu @ s["mu.w"].T + (d_log @ s["logvar.w"].T if reconstruct else 0.0), grads)
    return found, grads


def adam(s: State, grads: State, rate: float) -> None:
    s["@steps"] = s.get("@steps", np.zeros(())) + 1.0
    t = float(s["@steps"])
    for name, g in grads.items():
        m = DECAYS[0] * s.get(f"{name}@m", 0.0) + (1 - DECAYS[0]) * g
        v = DECAYS[1] * s.get(f"{name}@v", 0.0) + (1 - DECAYS[1]) * g * g
        s[f"{name}@m"], s[f"{name}@v"] = m, v
        s[name] = s[name] - rate * (m / (1 - DECAYS[0] ** t)) / (np.sqrt(v / (1 - DECAYS[1] ** t)) + ADAM_GUARD)


_PART = "part int, n long, state binary, loss binary"


def _averaged(parts: DataFrame, tasks: int) -> tuple[int, State, dict[str, float]] | None:
    """The mean by rows of the partitions' states and losses, in a tree of fan-in FAN_IN."""

    def mean(pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(pdf["n"].sum())
        sums: list[dict] = [{}, {}]
        for share, *both in pdf.sort_values("part")[["n", "state", "loss"]].itertuples(index=False):
            for total, packed in zip(sums, both):
                for name, value in pickle.loads(packed).items():
                    total[name] = total.get(name, 0.0) + value * (share / n)
        return pd.DataFrame([(int(pdf["part"].min()) // FAN_IN, n, pickle.dumps(sums[0]), pickle.dumps(sums[1]))], columns=["part", "n", "state", "loss"])

    while tasks > FAN_IN:
        parts = parts.groupBy(F.floor(F.col("part") / FAN_IN).alias("up")).applyInPandas(mean, _PART)
        tasks = -(-tasks // FAN_IN)
    rows = parts.toPandas()  # FAN_IN at most
    if not len(rows):
        return None
    whole = mean(rows).iloc[0]
    return int(whole["n"]), pickle.loads(whole["state"]), pickle.loads(whole["loss"])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def epoch(state: State, dealt: DataFrame, tasks: int, shape: Shape, rates: Rates, batch: int, number: int, seed: int, markers: bool = False) -> tuple[State, dict[str, float]]:
    """The state after one pass over dealt rows, and the mean losses.

    dealt: (x) is nodes, (x, other, y) is pairs, y 1 for links and 0 for drawn ones; with `markers` must-differ pairs,
    which move the encoder without a reconstruction. No rows leave the state as it is.
    """
    pairs = "other" in dealt.columns

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        rng, s, n, total, held, count = np.random.default_rng([seed, number, part]), dict(state), 0, {}, [], 0

        def train(rows: list[pa.RecordBatch]) -> int:
            t = pa.Table.from_batches(rows).combine_chunks()
            x = _matrix(t["x"].combine_chunks())
            other, y = (_matrix(t["other"].combine_chunks()), t["y"].to_numpy()) if pairs else (None, None)
            order = rng.permutation(len(x))
            for a in range(0, len(x), batch):
                pick = order[a : a + batch]
                both = np.concatenate([x[pick], other[pick]]) if pairs else x[pick]
                found, grads = losses_and_gradients(s, both, shape, rng, y[pick] if pairs else None, not markers, markers, rates.markers if markers else rates.links)
                adam(s, grads, rates.step)
                for name, value in found.items():
                    total[name] = total.get(name, 0.0) + value * len(pick)
            return len(x)

        for one in batches:
            held.append(one)
            count += one.num_rows
            if count >= max(SHUFFLE_ROWS, batch):
                n, held, count = n + train(held), [], 0
        if count:
            n += train(held)
        if n:
            yield pa.RecordBatch.from_pylist([{"part": part, "n": n, "state": pickle.dumps(s), "loss": pickle.dumps({k: v / n for k, v in total.items()})}], pa.schema([("part", pa.int32()), ("n", pa.int64()), ("state", pa.binary()), ("loss", pa.binary())]))

    done = _averaged(dealt.mapInArrow(kernel, _PART), tasks)
    return (done[1], done[2]) if done else (state, {})


def deal(df: DataFrame, keys: list[str], columns: list[str]) -> tuple[DataFrame, int, int]:
    """(rows in partitions by hash of the keys and in their order, partitions, rows); rows with a null vector are left out."""
    df = df.dropna(subset=columns)
    rows = df.count()
    tasks = max(1, -(-rows // PART_ROWS))
    vectors = [F.col(c).cast("double" if c == "y" else "array<double>").alias(c) for c in columns]
    return durable(df.repartition(tasks, *keys).sortWithinPartitions(*keys, *columns).select(*vectors)), tasks, rows


def batch_at(number: int, batch: int, rows: int) -> int:
    """The batch of an epoch: doubled at each of DOUBLINGS for which the rows are more than the doubled batch."""
    batch = batch or max(rows, 1)
    return batch * 2 ** sum(number >= at for i, at in enumerate(DOUBLINGS) if 2 ** (i + 1) * batch < rows)


def _pairs(links: DataFrame, nodes: DataFrame, key: str, vector: str) -> DataFrame:
    a, b = nodes.select(F.col(key).alias("src"), F.col(vector).alias("x")), nodes.select(F.col(key).alias("dst"), F.col(vector).alias("other"))
    return links.join(a, "src").join(b, "dst").select("src", "dst", "x", "other", "y")


def train(nodes: DataFrame, key: str, vector: str, shape: Shape, epochs: int, batch: int = 256, rates: Rates = Rates(), seed: int = 0, links: DataFrame | None = None, differ: DataFrame | None = None,
          evaluate: Callable[[int, State], float] | None = None, every: int = 10, skip: int = 0) -> tuple[State, list[dict[str, float]]]:
    """(state, losses of each epoch). links (src, dst, y): steps are on pairs, reconstructing both ends; else on nodes.

    differ (src, dst): a marker-only pass after each epoch. evaluate(epoch, state) is a score, taken every `every` epochs
    after `skip` and at the last one: the state of the best is returned, the first of equal ones.
    """
    state, history, best = initial_state(shape, seed), [], None
    main, tasks, rows = deal(nodes, [key], [vector]) if links is None else deal(_pairs(links, nodes, key, vector), ["src", "dst"], ["x", "other", "y"])
    main = main.withColumnRenamed(vector, "x") if links is None else main
    apart = deal(_pairs(differ.select("src", "dst", F.lit(0.0).alias("y")), nodes, key, vector), ["src", "dst"], ["x", "other", "y"]) if differ is not None else None
    for number in range(epochs):
        state, found = epoch(state, main, tasks, shape, rates, batch_at(number, batch, rows), number, seed)
        if apart is not None:
            state, more = epoch(state, apart[0], apart[1], shape, rates, batch_at(number, batch, apart[2]), number, seed + 1, markers=True)
            found = found | more
        history.append(found | {"loss": sum(found.values())})
        if evaluate is not None and (number == epochs - 1 or (number >= skip and (number - skip) % every == 0)):
            score = evaluate(number, state)
            history[-1]["score"] = score
            if best is None or score > best[0]:
                best = (score, state)
    return (best[1] if best else state), history


def encode(df: DataFrame, key: str, vector: str, state: State, shape: Shape, concat: bool = False) -> DataFrame:
    """(key, emb): the means of the latent values, after the input vector if `concat`; null for a null vector."""
    weights = {k: v for k, v in state.items() if "@" not in k and not k.startswith("dec")}

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one in batches:
            there = np.flatnonzero(one.column(1).is_valid().to_numpy(zero_copy_only=False))
            x = _matrix(one.column(1).take(pa.array(there))) if len(there) else np.zeros((0, shape.samples + shape.kmers))
            h, _ = _forward(weights, "enc", x, shape, None)
            mu = h @ weights["mu.w"] + weights["mu.b"]
            rows: list = [None] * one.num_rows
            for i, v in zip(there.tolist(), np.concatenate([x, mu], axis=1) if concat else mu):
                rows[i] = v
            yield pa.RecordBatch.from_arrays([one.column(0), pa.array(rows, pa.list_(pa.float64()))], [key, "emb"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, F.col(vector).cast("array<double>").alias("v")).mapInArrow(kernel, f"`{key}` {kind}, emb array<double>")
