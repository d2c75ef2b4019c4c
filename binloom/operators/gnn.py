"""Graph networks that train: convolution, sample-and-add and attention layers over edge tables of any size.

Node vectors are rows (key, array); a layer is a dense step in each row (numpy on Arrow batches, weights sent out), a sparse
product (a join of the edges with the vectors at their far ends, vectors summed by the near end, in each task first), and
normalisation over all nodes. Training is in reverse mode over the same relations: gradients of node vectors travel along
the transposed edges by one join a layer, gradients of weights are sums over all nodes that meet in a tree. Only weights,
their gradients and the statistics of a layer come to the driver; their size is set by the layers, not by the data.

Layers, with A the adjacency's values, W and b weights, then normalisation, relu and dropout each:
gcn: A (x W [+ b in the first]) + c; sage: x V [+ d] + A (x W [+ b]) + c; gat: of each head softmax over a node's edges of
leaky_relu(A_ij (l . h_i + r . h_j)), h = x W, times h_j, plus b, heads side by side. A dense step follows the last layer.

Activations that the backward pass needs are written to the shared folder and go when the step is done. Dropout is drawn
from a hash of the node, so a lost task is done again alike.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from binloom import functions as G
from binloom.operators.blocks import Blocks, added
from binloom.operators.graph import negative_edges
from binloom.operators.training import KEEP, State, adam
from binloom.sources.store import Scratch

# Slope of attention below zero, the normalisation's guard.
SLOPE, NORM_GUARD = 0.2, 1e-5
#: Partial sums that one task adds up.
FAN_IN = 64


@dataclass(frozen=True)
class Net:
    """kind is gcn, sage or gat; a gat layer has `hidden` values for each head."""

    kind: str
    inputs: int
    hidden: int = 128
    out: int = 64
    layers: int = 2
    heads: int = 1
    dropout: float = 0.5

    @property
    def width(self) -> int:
        return self.hidden * (self.heads if self.kind == "gat" else 1)

    def before(self, layer: int) -> int:
        return self.width if layer else self.inputs


@dataclass(frozen=True)
class Losses:
    """Weights of links and of must-differ pairs, negatives an edge, and the step size."""

    links: float = 1.0
    markers: float = 1.0
    negatives: int = 1
    step: float = 1e-2


def initial_state(net: Net, seed: int = 0) -> State:
    rng = np.random.default_rng(seed)

    def glorot(a: int, b: int) -> np.ndarray:
        edge = np.sqrt(6.0 / max(a + b, 1))
        return rng.uniform(-edge, edge, (a, b))

    out: State = {}
    for i in range(net.layers):
        a, b = net.before(i), net.width
        out[f"{i}.w"] = glorot(a, b)
        if net.kind == "sage":
            out[f"{i}.v"] = glorot(a, b)
        if net.kind == "gat":
            out[f"{i}.l"], out[f"{i}.r"] = glorot(net.heads, net.hidden), glorot(net.heads, net.hidden)
        elif i == 0:
            out[f"{i}.b"] = np.zeros(b)
            if net.kind == "sage":
                out[f"{i}.d"] = np.zeros(b)
        out[f"{i}.c"], out[f"{i}.scale"], out[f"{i}.shift"] = np.zeros(b), np.ones(b), np.zeros(b)
        out[f"{i}.~mean"], out[f"{i}.~var"] = np.zeros(b), np.ones(b)
    out["out.w"], out["out.b"] = glorot(net.before(net.layers), net.out), np.zeros(net.out)
    return out


def _column(column: pa.Array) -> np.ndarray:
    """Numbers, or vectors of equal length as a matrix; nulls are an error of the caller."""
    if pa.types.is_list(column.type) or pa.types.is_large_list(column.type):
        return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return column.to_numpy(zero_copy_only=False)


def by_rows(df: DataFrame, keep: list[str], inputs: list[str], outputs: list[str], step: Callable[..., tuple[np.ndarray, ...]]) -> DataFrame:
    """keep, and outputs as `step` makes them of the inputs, a batch of rows at a time: vectors of matrices, doubles of columns."""
    kinds = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one in batches:
            if not one.num_rows:
                continue
            made = step(*[_column(one.column(len(keep) + i)) for i in range(len(inputs))])
            packed = [pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(np.ascontiguousarray(m, np.float64).ravel())) for m in made]
            yield pa.RecordBatch.from_arrays([*one.columns[: len(keep)], *packed], [*keep, *outputs])

    return df.select(*keep, *inputs).mapInArrow(kernel, ", ".join([*kinds, *(f"`{c}` array<double>" for c in outputs)]))


def totals(df: DataFrame, inputs: list[str], step: Callable[..., State]) -> State:
    """Sums over all rows of what `step` makes of a batch, added up in each task and then in a tree."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: State = {}
        for one in batches:
            if one.num_rows:
                for name, value in step(*map(_column, one.columns)).items():
                    total[name] = total.get(name, 0.0) + value
        if total:
            yield pa.RecordBatch.from_pylist([{"part": TaskContext.get().partitionId(), "sums": pickle.dumps(total)}], pa.schema([("part", pa.int64()), ("sums", pa.binary())]))

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        total: State = {}
        for packed in pdf.sort_values("part")["sums"]:
            for name, value in pickle.loads(packed).items():
                total[name] = total.get(name, 0.0) + value
        return pd.DataFrame({"part": [int(pdf["part"].min()) // FAN_IN], "sums": [pickle.dumps(total)]})

    parts = df.select(*inputs).mapInArrow(kernel, "part long, sums binary")
    parts = parts.groupBy(F.floor(F.col("part") / FAN_IN).alias("up")).applyInPandas(added, "part long, sums binary")
    rows = parts.toPandas()  # one a FAN_IN tasks
    return pickle.loads(added(rows)["sums"][0]) if len(rows) else {}


#: Values of a vector that are added up as columns of their own.
COLUMNS = 64


def summed(df: DataFrame, key: str, vector: str | Column, out: str, width: int | None = None) -> DataFrame:
    """(key, out): vectors added up by key, in each task first; those of a known small width by plain sums, which need no
    sorting where a task has many keys."""
    vector = F.col(vector) if isinstance(vector, str) else vector
    if width is not None and width <= COLUMNS:
        sums = df.select(key, vector.alias("__v")).groupBy(key).agg(*[F.sum(F.col("__v")[i]).alias(f"__{i}") for i in range(width)])
        return sums.select(key, F.array(*[f"__{i}" for i in range(width)]).alias(out))
    return df.groupBy(key).agg(Summarizer.sum(array_to_vector(vector)).alias("__sum")).select(key, vector_to_array("__sum").alias(out))


def spread_along(edges: DataFrame, nodes: DataFrame, vector: str, value: str = "value", out: str = "near", width: int | None = None) -> DataFrame:
    """(node, out): of each edge's near end (src) the far ends' vectors times the edge's value, added up."""
    far = nodes.select(F.col("node").alias("dst"), F.col(vector).alias("__x"))
    met = edges.select("src", "dst", F.col(value).alias("__v")).join(far, "dst")
    return summed(met, "src", F.transform("__x", lambda x: x * F.col("__v")), out, width).withColumnRenamed("src", "node")


def reversed_(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "value")


def _or_zeros(vector: str, size: int) -> Column:
    return F.coalesce(vector, F.array_repeat(F.lit(0.0), size)).alias(vector)


def _kept(hashes: np.ndarray, width: int, share: float, salt: int) -> np.ndarray:
    """What dropout leaves, scaled: drawn for each node and place from the node's hash."""
    x = hashes.astype(np.uint64)[:, None] ^ (np.arange(1, width + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (np.uint64((salt + 1) * 0xC2B2AE3D27D4EB4F % (1 << 64)))
    for _ in range(2):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    u = (x >> np.uint64(11)).astype(np.float64) / float(1 << 53)
    return (u >= share) / (1.0 - share)


class Pass:
    """One forward pass, whose tape (x and every layer's sums z) the backward pass reads.

    In training the statistics of a layer are those of the pass, which move the running ones; else the running ones count.
    """

    def __init__(self, net: Net, state: State, nodes: DataFrame, edges: DataFrame | Blocks, scratch: Scratch, training: bool, salt: int = 0):
        """nodes (node, x), edges (src, dst, value) with the loops that the layers are meant to see, or Blocks, whose nodes
        are longs and which have no backward pass."""
        self.net, self.state, self.edges, self.scratch, self.training, self.salt = net, state, edges, scratch, training, salt
        self.norm: list[tuple[np.ndarray, np.ndarray]] = []
        self.attention: list[DataFrame] = []
        self.tape = nodes.select("node", F.xxhash64("node").alias("hash"), "x")
        for i in range(net.layers):
            self._layer(i)
        at, w, b = self._at(net.layers), state["out.w"], state["out.b"]
        self.embedded = by_rows(self.tape, ["node"], self._inputs(net.layers), ["emb"], lambda *x: (at(*x) @ w + b,))

    def _inputs(self, layer: int) -> list[str]:
        return ["hash", f"z{layer - 1}" if layer else "x"]

    def _at(self, layer: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
        """From (hash, x or z) of a batch to what the layer reads."""
        if layer == 0:
            return lambda hashes, x: x
        parts = self._normal(layer - 1)

        def read(hashes: np.ndarray, z: np.ndarray) -> np.ndarray:
            _, u, keep = parts(hashes, z)
            return np.maximum(u, 0.0) * keep

        return read

    def _normal(self, layer: int) -> Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray | float]]:
        """From (hash, z) to the standardised sums, what relu reads, and what dropout leaves."""
        (mean, inv), scale, shift = self.norm[layer], self.state[f"{layer}.scale"], self.state[f"{layer}.shift"]
        share, salt, training = self.net.dropout, self.salt * 1009 + layer, self.training

        def parts(hashes: np.ndarray, z: np.ndarray):
            unit = (z - mean) * inv
            return unit, unit * scale + shift, _kept(hashes, z.shape[1], share, salt) if training and share else 1.0

        return parts

    def _layer(self, i: int) -> None:
        net, s, at, width, w = self.net, self.state, self._at(i), self.net.width, self.state[f"{i}.w"]
        if net.kind == "gat":
            left, right = s[f"{i}.l"], s[f"{i}.r"]
            scored = self.scratch.keep(by_rows(self.tape, ["node"], self._inputs(i), ["h", "left", "right"], lambda *x: _scores(at(*x) @ w, left, right)))
            if isinstance(self.edges, Blocks):
                near = attended(self.edges, scored, net.heads, net.hidden)
            else:
                self.attention.append(self.scratch.keep(attention_weights(self.edges, scored, net.heads)))
                near = summed(weighted_messages(self.attention[i], scored, net.heads, net.hidden), "src", "message", "near", width).withColumnRenamed("src", "node")
        else:
            b = s.get(f"{i}.b", 0.0)
            y = by_rows(self.tape, ["node"], self._inputs(i), ["y"], lambda *x: (at(*x) @ w + b,))
            if isinstance(self.edges, Blocks):
                near = summed(self.edges.meet(y, F.col("y"), added), "node", "part", "near", width)
            else:
                near = spread_along(self.edges, y, "y", width=width)
        z = self.tape.join(near, "node", "left").withColumn("near", _or_zeros("near", width))
        if net.kind == "sage":
            v, d = s[f"{i}.v"], s.get(f"{i}.d", 0.0)
            z = by_rows(z, self.tape.columns, [*self._inputs(i), "near"], [f"z{i}"], lambda hashes, x, near: (at(hashes, x) @ v + d + near,))
        else:
            z = z.withColumnRenamed("near", f"z{i}")
        self.tape = self.scratch.keep(z)
        c, mean, var = s[f"{i}.c"], s[f"{i}.~mean"], s[f"{i}.~var"]
        if self.training:
            n, m, v = self.tape.agg(F.count(F.lit(1)), *[f(array_to_vector(f"z{i}")) for f in (Summarizer.mean, Summarizer.variance)]).first()
            mean, var = (m.toArray() + c, v.toArray() * max(n - 1, 0) / n) if n else (mean, var)
            s[f"{i}.~mean"] = KEEP * s[f"{i}.~mean"] + (1 - KEEP) * mean
            s[f"{i}.~var"] = KEEP * s[f"{i}.~var"] + (1 - KEEP) * var
        self.norm.append((mean - c, 1.0 / np.sqrt(var + NORM_GUARD)))

    def backward(self, gradient: DataFrame) -> State:
        """Gradients of all weights from (node, g), the loss's by the embedding; nodes without a row have none."""
        net, s, n = self.net, self.state, max(self.tape.count(), 1)
        at, w = self._at(net.layers), s["out.w"]
        joined = self.tape.join(gradient, "node", "left").withColumn("g", _or_zeros("g", net.out))
        grads = totals(joined, [*self._inputs(net.layers), "g"], lambda hashes, x, g: {"out.w": at(hashes, x).T @ g, "out.b": g.sum(axis=0)})
        joined = by_rows(joined, self.tape.columns, ["g"], ["g"], lambda g: (g @ w.T,))
        for i in reversed(range(net.layers)):
            parts, inv, scale = self._normal(i), self.norm[i][1], s[f"{i}.scale"]
            joined = self.scratch.keep(joined)

            def through(hashes, z, g, parts=parts):
                unit, u, keep = parts(hashes, z)
                return unit, g * keep * (u > 0)

            def sums(hashes, z, g, i=i, through=through):
                unit, du = through(hashes, z, g)
                return {f"{i}.scale": (du * unit).sum(axis=0), f"{i}.shift": du.sum(axis=0)}

            grads |= totals(joined, ["hash", f"z{i}", "g"], sums)
            a, b = grads[f"{i}.shift"] / n, grads[f"{i}.scale"] / n

            def by_z(hashes, z, g, through=through, scale=scale, inv=inv, a=a, b=b):
                unit, du = through(hashes, z, g)
                return (scale * inv * (du - a - unit * b),)

            back = self.scratch.keep(by_rows(joined, [c for c in joined.columns if c not in ("g", f"z{i}")], ["hash", f"z{i}", "g"], ["dz"], by_z))
            joined = self._through_layer(i, back, grads)
        return grads

    def _through_layer(self, i: int, back: DataFrame, grads: State) -> DataFrame | None:
        """Adds the layer's gradients to grads; the tape with g by the layer's input, if there is a layer below."""
        net, s, at, w = self.net, self.state, self._at(i), self.state[f"{i}.w"]
        held = [c for c in back.columns if c != "dz"]
        if net.kind == "gat":
            return self._through_attention(i, back, grads, held)
        met = back.join(spread_along(reversed_(self.edges), back, "dz", out="t"), "node", "left").withColumn("t", _or_zeros("t", net.width))
        met = self.scratch.keep(met)
        sage, first = net.kind == "sage", i == 0

        def sums(hashes, x, dz, t):
            x = at(hashes, x)
            out = {f"{i}.w": x.T @ t, f"{i}.c": dz.sum(axis=0)}
            if first:
                out[f"{i}.b"] = t.sum(axis=0)
            if sage:
                out[f"{i}.v"] = x.T @ dz
                if first:
                    out[f"{i}.d"] = dz.sum(axis=0)
            return out

        grads |= totals(met, [*self._inputs(i), "dz", "t"], sums)
        v = s.get(f"{i}.v")
        return by_rows(met, held, ["dz", "t"], ["g"], lambda dz, t: (t @ w.T + (dz @ v.T if sage else 0.0),)) if i else None

    def _through_attention(self, i: int, back: DataFrame, grads: State, held: list[str]) -> DataFrame | None:
        net, s, at = self.net, self.state, self._at(i)
        w, left, right, heads, size = s[f"{i}.w"], s[f"{i}.l"], s[f"{i}.r"], net.heads, net.hidden
        ends = self.scratch.keep(by_rows(back, ["node"], [*self._inputs(i), "dz"], ["h", "dz"], lambda hashes, x, dz: (at(hashes, x) @ w, dz)))
        near, far = ends.select(F.col("node").alias("src"), "dz"), ends.select(F.col("node").alias("dst"), "h")
        split = lambda x: x.reshape(len(x), heads, size)

        def by_alpha(alpha, slope, dz, h):
            return alpha, slope, (split(dz) * split(h)).sum(axis=2), (alpha[:, :, None] * split(dz)).reshape(len(dz), -1)

        edge = self.attention[i].join(near, "src").join(far, "dst")
        edge = self.scratch.keep(by_rows(edge, ["src", "dst"], ["alpha", "slope", "dz", "h"], ["alpha", "slope", "da", "message"], by_alpha))
        rows = summed(edge, "src", F.zip_with("alpha", "da", lambda a, d: a * d), "row")
        scores = by_rows(edge.join(rows, "src"), ["src", "dst"], ["alpha", "slope", "da", "row"], ["d"], lambda a, k, da, row: (a * (da - row) * k,))
        scores = self.scratch.keep(scores)
        met = back
        for name, part in (("dl", summed(scores, "src", "d", "dl")), ("dr", summed(scores, "dst", "d", "dr")), ("t", summed(edge, "dst", "message", "t"))):
            met = met.join(part.withColumnRenamed(part.columns[0], "node"), "node", "left").withColumn(name, _or_zeros(name, net.width if name == "t" else heads))
        met = self.scratch.keep(met)

        def by_h(dl, dr, t):
            return (split(t) + dl[:, :, None] * left + dr[:, :, None] * right).reshape(len(t), -1)

        def sums(hashes, x, dz, dl, dr, t):
            x = at(hashes, x)
            h = split(x @ w)
            return {f"{i}.w": x.T @ by_h(dl, dr, t), f"{i}.c": dz.sum(axis=0), f"{i}.l": (dl[:, :, None] * h).sum(axis=0), f"{i}.r": (dr[:, :, None] * h).sum(axis=0)}

        grads |= totals(met, [*self._inputs(i), "dz", "dl", "dr", "t"], sums)
        return by_rows(met, held, ["dl", "dr", "t"], ["g"], lambda dl, dr, t: (by_h(dl, dr, t) @ w.T,)) if i else None


def _scores(h: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    heads = h.reshape(len(h), *left.shape)
    return h, (heads * left).sum(axis=2), (heads * right).sum(axis=2)


def attention_weights(edges: DataFrame, scored: DataFrame, heads: int, value: str = "value") -> DataFrame:
    """(src, dst, alpha, slope): a head's weights of each source's edges sum to 1; slope is the score's derivative by left
    or right, the edge's value included."""
    a, b = scored.select(F.col("node").alias("src"), "left"), scored.select(F.col("node").alias("dst"), "right")
    e = edges.select("src", "dst", F.col(value).alias("v")).join(b, "dst").join(a, "src")
    w, v = Window.partitionBy("src"), F.col("v")
    raw = [v * (F.col("left")[k] + F.col("right")[k]) for k in range(heads)]
    e = e.select("src", "dst", *[G.leaky_relu(r, SLOPE).alias(f"e{k}") for k, r in enumerate(raw)], F.array(*[F.when(r >= 0, v).otherwise(v * SLOPE) for r in raw]).alias("slope"))
    e = e.select("src", "dst", "slope", *[F.exp(F.col(f"e{k}") - F.max(f"e{k}").over(w)).alias(f"e{k}") for k in range(heads)])
    return e.select("src", "dst", F.array(*[F.col(f"e{k}") / F.sum(f"e{k}").over(w) for k in range(heads)]).alias("alpha"), "slope")


def weighted_messages(attention: DataFrame, scored: DataFrame, heads: int, size: int) -> DataFrame:
    """(src, message): the far end's vector with each head's part times that head's weight."""
    met = attention.join(scored.select(F.col("node").alias("dst"), "h"), "dst")
    return by_rows(met, ["src"], ["alpha", "h"], ["message"], lambda a, h: ((a[:, :, None] * h.reshape(len(h), heads, size)).reshape(len(h), -1),))


def attended(edges: Blocks, scored: DataFrame, heads: int, size: int) -> DataFrame:
    """(node, near): of each head the sum of the far ends' vectors by attention_weights, no edge or weight being written.

    A block gives each node its largest score, the sum of the others' powers below it and their vectors by these; a node's
    parts are then brought to the largest score of all."""

    def step(near: np.ndarray, far: np.ndarray, value: np.ndarray, x: np.ndarray) -> np.ndarray:
        h, left, right = x[:, : heads * size].reshape(len(x), heads, size), x[:, heads * size : heads * (size + 1)], x[:, heads * (size + 1) :]
        parts = []
        for k in range(heads):
            raw = value * (left[near, k] + right[far, k])
            e = np.where(raw >= 0, raw, SLOPE * raw)
            most = np.full(len(x), -np.inf)
            np.maximum.at(most, near, e)
            power = np.exp(e - most[near])
            parts += [most[:, None], np.bincount(near, power, len(x))[:, None], added(near, far, power, h[:, k])]
        return np.hstack(parts)

    parts, wide = edges.meet(scored, F.concat("h", "left", "right"), step), size + 2
    w, at = Window.partitionBy("node"), lambda k, wide: F.col("part")[k * wide]
    parts = parts.select("node", "part", *[F.exp(at(k, wide) - F.max(at(k, wide)).over(w)).alias(f"__{k}") for k in range(heads)])
    scaled = lambda values, by: F.transform(values, lambda p: p * by)
    parts = parts.select("node", F.concat(*[scaled(F.slice("part", k * wide + 2, size + 1), F.col(f"__{k}")) for k in range(heads)]).alias("part"))
    sums, wide = summed(parts, "node", "part", "part", heads * (size + 1)), size + 1
    return sums.select("node", F.concat(*[scaled(F.slice("part", k * wide + 2, size), 1.0 / at(k, wide)) for k in range(heads)]).alias("near"))


def pair_gradients(pairs: DataFrame, embedded: DataFrame) -> DataFrame:
    """(node, g, loss) summed by node: cross-entropy with cosines as logits of pairs (src, dst, y, share), times share; a
    pair's loss is at its src."""
    a, b = embedded.select(F.col("node").alias("src"), F.col("emb").alias("a")), embedded.select(F.col("node").alias("dst"), F.col("emb").alias("b"))

    def step(y, share, a, b):
        na, nb = (np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12) for x in (a, b))
        c = ((a / na) * (b / nb)).sum(axis=1, keepdims=True)
        y, share = y[:, None], share[:, None]
        g = share * (1.0 / (1.0 + np.exp(-c)) - y)
        loss = share * (np.logaddexp(0.0, c) - y * c)
        return np.hstack([loss, g * (b / nb - c * a / na) / na]), np.hstack([np.zeros_like(loss), g * (a / na - c * b / nb) / nb])

    met = by_rows(pairs.join(a, "src").join(b, "dst"), ["src", "dst"], ["y", "share", "a", "b"], ["ga", "gb"], step)
    ends = met.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.col("ga").alias("g")), F.struct(F.col("dst").alias("node"), F.col("gb").alias("g")))).alias("e"))
    both = summed(ends.select("e.node", "e.g"), "node", "g", "g")
    return both.select("node", F.slice("g", 2, F.size("g") - 1).alias("g"), F.col("g")[0].alias("loss"))


def gradients(net: Net, state: State, nodes: DataFrame, edges: DataFrame, pairs: DataFrame, scratch: Scratch, salt: int = 0) -> tuple[float, State]:
    """(loss, gradients) of one full pass in training, over pairs (src, dst, y, share)."""
    run = Pass(net, state, nodes, edges, scratch, True, salt)
    found = scratch.keep(pair_gradients(pairs, scratch.keep(run.embedded)))
    loss = found.agg(F.coalesce(F.sum("loss"), F.lit(0.0))).first()[0]
    return float(loss), run.backward(found.select("node", "g"))


def embed(net: Net, state: State, nodes: DataFrame, edges: DataFrame | Blocks, concat: bool = True, own_statistics: bool = False) -> DataFrame:
    """(node, emb) by the running statistics, or by those of these nodes; after the node's own vector if `concat`."""
    scratch = Scratch(nodes.sparkSession)
    out = Pass(replace(net, dropout=0.0), dict(state), nodes, edges, scratch, own_statistics).embedded
    out = scratch.keep(nodes.join(out, "node").select("node", F.concat("x", "emb").alias("emb")) if concat else out, last=True)
    scratch.clear()
    return out


def train(net: Net, nodes: DataFrame, edges: DataFrame, links: DataFrame, epochs: int, losses: Losses = Losses(), seed: int = 0, differ: DataFrame | None = None,
          evaluate: Callable[[int, State], float] | None = None, every: int = 10, skip: int = 0) -> tuple[State, list[dict[str, float]]]:
    """(state, losses of each epoch); an epoch is one step over the whole graph, as the reference statistics are of all nodes.

    nodes (node, x), edges (src, dst, value) for the layers, links (src, dst) that should be near, each with
    `losses.negatives` drawn ends that should not, differ (src, dst) that must not. evaluate(epoch, state) is a score, taken
    every `every` epochs after `skip` and at the last: the state of the best is returned, the first of equal ones.
    """
    state, history, best = initial_state(net, seed), [], None
    shared = Scratch(nodes.sparkSession)
    nodes, edges, links = (shared.keep(df) for df in (nodes.select("node", F.col("x").cast("array<double>").alias("x")), edges.select("src", "dst", F.col("value").cast("double").alias("value")), links.select("src", "dst")))
    n = links.count() * (1 + losses.negatives)
    apart = shared.keep(differ.select("src", "dst")) if differ is not None else None
    m = apart.count() if apart is not None else 0
    pair = lambda df, y, share: df.select("src", "dst", F.lit(y).alias("y"), F.lit(share).alias("share"))
    for number in range(epochs):
        scratch = Scratch(nodes.sparkSession)
        pairs = pair(links, 1.0, losses.links / max(n, 1))
        if losses.negatives:
            drawn = scratch.keep(negative_edges(links, nodes, "node", losses.negatives, seed * 7919 + number))
            pairs = pairs.unionByName(pair(drawn, 0.0, losses.links / max(n, 1)))
        if m:
            pairs = pairs.unionByName(pair(apart, 0.0, losses.markers / (m + 1)))
        loss, grads = gradients(net, state, nodes, edges, pairs, scratch, number)
        scratch.clear()
        adam(state, grads, losses.step)
        history.append({"loss": loss})
        if evaluate is not None and (number == epochs - 1 or (number >= skip and (number - skip) % every == 0)):
            history[-1]["score"] = evaluate(number, state)
            if best is None or history[-1]["score"] > best[0]:
                best = (history[-1]["score"], dict(state))
    shared.clear()
    return (best[1] if best else state), history
