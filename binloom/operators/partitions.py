"""More ways to cluster vectors: spectral, by clustering features, in mini-batches, and under bounds on the sizes.

Rows stay where they are; what meets on the driver is of the size of the clusters (centroids, leaves of a bounded tree,
small matrices), not of the data. Keys are longs; vectors have no nulls; ties go to the lower cluster; an empty table gives
an empty result.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from binloom import functions as G
from binloom.operators import gnn, graph, similarity
from binloom.operators.similarity import matrix
from binloom.sources.store import Scratch

#: Partial results that one task merges.
FAN_IN = 16


def _rows(df: DataFrame, key: str, vector: str) -> DataFrame:
    return df.select(F.col(key).cast("long").alias("k"), F.col(vector).cast("array<double>").alias("v"))


def _first_rows(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The vectors of k rows, the first by hash."""
    chosen = rows.orderBy(F.xxhash64("k", F.lit(seed)), "k").limit(k).collect()  # a row a cluster
    return np.array([r["v"] for r in chosen], np.float64)


def _gaps(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances."""
    return np.maximum((x**2).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres**2).sum(axis=1)[None, :], 0.0)


def nearest(rows: DataFrame, key: str, centres: np.ndarray, labels: np.ndarray | None = None) -> DataFrame:
    """(key, bin): the nearest of the centres, or its label."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one in batches:
            if one.num_rows:
                best = _gaps(matrix(one.column(1)), centres).argmin(axis=1)
                yield pa.RecordBatch.from_arrays([one.column(0), pa.array((best if labels is None else labels[best]).astype(np.int32))], [key, "bin"])

    return rows.select("k", "v").mapInArrow(kernel, f"`{key}` long, bin int")


def _merged(parts: DataFrame, merge: Callable[[list], object]) -> object | None:
    """The parts (part, state) merged in a tree: FAN_IN at a time in tasks, what is left on the driver."""

    def up(pdf: pd.DataFrame) -> pd.DataFrame:
        done = merge([pickle.loads(s) for s in pdf.sort_values("part")["state"]])
        return pd.DataFrame({"part": [int(pdf["part"].min()) // FAN_IN], "state": [pickle.dumps(done)]})

    tasks = parts.rdd.getNumPartitions()
    while tasks > FAN_IN:
        parts = parts.groupBy(F.floor(F.col("part") / FAN_IN).alias("up")).applyInPandas(up, "part long, state binary")
        tasks = -(-tasks // FAN_IN)
    rows = parts.toPandas()  # FAN_IN at most
    return pickle.loads(up(rows)["state"][0]) if len(rows) else None


def _by_task(rows: DataFrame, work: Callable[[Iterator[np.ndarray]], object]) -> DataFrame:
    """(part, state): what `work` makes of a task's vectors, batch by batch."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full = (matrix(one.column(0)) for one in batches if one.num_rows)
        first = next(full, None)
        if first is not None:

            def every() -> Iterator[np.ndarray]:
                yield first
                yield from full

            yield pa.RecordBatch.from_pylist([{"part": TaskContext.get().partitionId(), "state": pickle.dumps(work(every()))}], pa.schema([("part", pa.int64()), ("state", pa.binary())]))

    return rows.select("v").mapInArrow(kernel, "part long, state binary")


# Spectral


def top_eigenvectors(adjacency: DataFrame, nodes: DataFrame, k: int, tolerance: float = 1e-7, most: int | None = None, seed: int = 0, guard: int = 0) -> tuple[DataFrame, np.ndarray, int]:
    """((node, x), values, rounds): the k largest eigenvalues of a symmetric matrix (src, dst, value) with orthonormal vectors.

    Locally optimal block iteration: each round adds the residuals to the vectors and the last directions, multiplies those
    once by the matrix (a join), and takes the best combinations, from inner products summed over all nodes. It ends when
    each of the k residuals is shorter than the tolerance, however many rounds that takes; with `most` it raises where more
    are needed. `guard` further vectors go along, so that values just below the k-th one hold it up less."""
    scratch, wanted, k = Scratch(nodes.sparkSession), k, k + guard
    start = F.array(*[F.hash("node", F.lit(seed * 1000 + c)).cast("double") / float(1 << 31) for c in range(k)])
    frame = scratch.keep(nodes.select("node", start.alias("x")))
    frame = scratch.keep(frame.join(gnn.spread_along(adjacency, frame, "x", out="mx", width=k), "node", "left").withColumn("mx", F.coalesce("mx", F.array_repeat(F.lit(0.0), k))))
    frame = frame.select("node", F.col("x").alias("s"), F.col("mx").alias("ms"))
    coefficients = _ritz(frame, k)
    x, mx = coefficients[0], coefficients[0]
    values, rounds, width = coefficients[1], 0, k
    frame = scratch.keep(gnn.by_rows(frame, ["node"], ["s", "ms"], ["s", "ms", "r"], lambda s, ms, c=x, v=values: (s @ c, ms @ c, ms @ c - s @ c * v)))
    while True:
        norms = np.sqrt(np.maximum(gnn.totals(frame, ["r"], lambda r: {"r": (r**2).sum(axis=0)}).get("r", np.zeros(k)), 0.0))
        if not np.isfinite(norms).all():
            raise ValueError("the matrix has values that are no numbers")
        if norms[:wanted].max(initial=0.0) < tolerance:
            break
        if rounds == most:
            scratch.clear()
            raise RuntimeError(f"eigenvectors still change after {rounds} rounds")
        step = Scratch(nodes.sparkSession)
        scale = 1.0 / np.maximum(norms, 1e-300)
        frame = gnn.by_rows(frame, ["node"], ["s", "ms", "r"], ["s", "ms", "r"], lambda s, ms, r, c=scale: (s, ms, r * c))
        frame = step.keep(frame)
        frame = frame.join(gnn.spread_along(adjacency, frame, "r", out="mr", width=k), "node", "left").withColumn("mr", F.coalesce("mr", F.array_repeat(F.lit(0.0), k)))
        frame = step.keep(gnn.by_rows(frame, ["node"], ["s", "ms", "r", "mr"], ["s", "ms"], lambda s, ms, r, mr: (np.hstack([s[:, :k], r, s[:, k:]]), np.hstack([ms[:, :k], mr, ms[:, k:]]))))
        c, values = _ritz(frame, k)
        direction = c.copy()
        direction[:k] = 0.0
        both, width = np.hstack([c, direction]), 2 * k

        def combine(s, ms, both=both, values=values):
            s, ms = s @ both, ms @ both
            return s, ms, ms[:, :k] - s[:, :k] * values

        frame = step.keep(gnn.by_rows(frame, ["node"], ["s", "ms"], ["s", "ms", "r"], combine))
        scratch.clear(shuffles=True)
        scratch, rounds = step, rounds + 1
    out = scratch.keep(frame.select("node", F.slice("s", 1, wanted).alias("x")), last=True)
    scratch.clear()
    return out, values[:wanted], rounds


def _ritz(frame: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients of the k best orthonormal combinations of the columns of s, whose images are ms, and their values."""
    found = gnn.totals(frame, ["s", "ms"], lambda s, ms: {"g": s.T @ s, "t": s.T @ ms})
    if not found:
        return np.zeros((k, k)), np.zeros(k)
    scale = 1.0 / np.sqrt(np.maximum(np.diag(found["g"]), 1e-300))
    g, t = found["g"] * np.outer(scale, scale), found["t"] * np.outer(scale, scale)
    weight, basis = np.linalg.eigh(g)
    keep = weight > 1e-12 * weight[-1]
    basis = basis[:, keep] / np.sqrt(weight[keep])
    values, vectors = np.linalg.eigh(basis.T @ ((t + t.T) / 2) @ basis)
    best = np.argsort(-values)[:k]
    c = scale[:, None] * (basis @ vectors[:, best])
    pad = k - len(best)  # fewer nodes than vectors
    return (np.hstack([c, np.zeros((len(c), pad))]), np.concatenate([values[best], np.zeros(pad)])) if pad else (c, values[best])


def spectral(df: DataFrame, key: str, vector: str, k: int, neighbours: int = 10, seed: int = 0, tolerance: float = 1e-3, most: int | None = None) -> DataFrame:
    """(key, bin): k-means on the rows, of length 1, of the first k eigenvectors of the normalised graph of nearest
    neighbours by cosine (a link's weight is the share of its ends that name it, and each row is its own neighbour).

    The eigenvectors are taken to the tolerance in as many rounds as that takes, k guards beside them; `most` is an error."""
    unit = df.select(F.col(key).cast("long").alias("node"), F.transform(G.medoid_normalise(F.col(vector)), lambda x: x * F.sqrt(F.lit(2.0))).alias("u"))
    scratch = Scratch(df.sparkSession)
    near = similarity.top_products(scratch.keep(unit), "node", "u", neighbours + 1).where("i <> j").select(F.col("i").alias("src"), F.col("j").alias("dst"), F.lit(0.5).alias("weight"))
    links = scratch.keep(near.unionByName(gnn.reversed_(near.withColumnRenamed("weight", "value")).withColumnRenamed("value", "weight")))
    nodes = unit.select("node")
    adjacency = scratch.keep(graph.with_loops(graph.normalised_adjacency(links), nodes, "node", "norm").withColumnRenamed("norm", "value"))
    embedded, _, _ = top_eigenvectors(adjacency, nodes, k, tolerance, most, seed, guard=k)
    scratch.clear()
    rows = embedded.select("node", F.transform("x", lambda x: x / F.greatest(G.norm(F.col("x")), F.lit(1e-12))).alias("x"))
    if rows.isEmpty():
        return rows.select(F.col("node").alias(key), F.lit(0).alias("bin"))
    data = rows.select("node", array_to_vector("x").alias("features"))
    return KMeans(k=k, seed=seed, predictionCol="bin").fit(data).transform(data).select(F.col("node").alias(key), "bin")


# Clustering features


@dataclass
class Leaves:
    """A clustering-feature tree: leaves (rows, sum, sum of squares) of a radius up to `radius`, `most` at most.

    Over `most` leaves the radius grows and the leaves go into a new tree, so memory is bounded whatever is added."""

    radius: float
    most: int
    branching: int = 50
    root: dict | None = field(default=None)
    count: int = 0

    def add(self, n: float, total: np.ndarray, squares: float) -> None:
        if self.root is None:
            self.root, self.count = _tree_node([(n, total, squares)], None), 1
            return
        split = self._insert(self.root, (n, total, squares))
        if split:
            self.root = _tree_node([_feature(s) for s in split], list(split))
        if self.count > self.most:
            self._rebuild()

    def features(self) -> list[tuple[float, np.ndarray, float]]:
        out, todo = [], [self.root] if self.root else []
        while todo:
            node = todo.pop()
            if node["below"] is None:
                out += [(float(node["n"][i]), node["sum"][i], float(node["squares"][i])) for i in range(len(node["n"]))]
            else:
                todo += reversed(node["below"])
        return out

    def _rebuild(self) -> None:
        held = self.features()
        centres = np.array([s / n for n, s, _ in held])
        near = _gaps(centres, centres)
        near[np.arange(len(held)), np.arange(len(held))] = np.inf
        self.radius = max(self.radius * 1.5, float(np.sqrt(np.median(near.min(axis=1)))), 1e-12)
        self.root, self.count = None, 0
        for one in held:
            self.add(*one)

    def _insert(self, node: dict, entry: tuple) -> tuple[dict, dict] | None:
        n, total, squares = entry
        at = int(_gaps((total / n)[None, :], node["sum"] / node["n"][:, None])[0].argmin())
        if node["below"] is None:
            m, s, q = node["n"][at] + n, node["sum"][at] + total, node["squares"][at] + squares
            if max(q / m - ((s / m) ** 2).sum(), 0.0) <= self.radius**2:
                node["n"][at], node["sum"][at], node["squares"][at] = m, s, q
                return None
            _append(node, entry)
            self.count += 1
        else:
            split = self._insert(node["below"][at], entry)
            if not split:
                node["n"][at] += n
                node["sum"][at] += total
                node["squares"][at] += squares
                return None
            node["below"][at : at + 1] = list(split)
            _refill(node, [_feature(b) for b in node["below"]])
        return _halved(node) if len(node["n"]) > self.branching else None


def _tree_node(entries: list[tuple], below: list | None) -> dict:
    node: dict = {"below": below}
    _refill(node, entries)
    return node


def _refill(node: dict, entries: list[tuple]) -> None:
    node["n"], node["sum"], node["squares"] = np.array([e[0] for e in entries], np.float64), np.array([e[1] for e in entries], np.float64), np.array([e[2] for e in entries], np.float64)


def _append(node: dict, entry: tuple) -> None:
    node["n"], node["sum"], node["squares"] = np.append(node["n"], entry[0]), np.vstack([node["sum"], entry[1]]), np.append(node["squares"], entry[2])


def _feature(node: dict) -> tuple:
    return node["n"].sum(), node["sum"].sum(axis=0), node["squares"].sum()


def _halved(node: dict) -> tuple[dict, dict]:
    """Two nodes, by the nearer of the two entries furthest apart."""
    centres = node["sum"] / node["n"][:, None]
    gaps = _gaps(centres, centres)
    a, b = np.unravel_index(int(gaps.argmax()), gaps.shape)
    right = gaps[:, b] < gaps[:, a]
    right[b], right[a] = True, False
    out = []
    for pick in (~right, right):
        at = np.flatnonzero(pick)
        out.append({"below": None if node["below"] is None else [node["below"][i] for i in at], "n": node["n"][at], "sum": node["sum"][at], "squares": node["squares"][at]})
    return out[0], out[1]


def feature_leaves(df: DataFrame, key: str, vector: str, radius: float = 0.5, most: int = 1024) -> list[tuple[float, np.ndarray, float]]:
    """The leaves (rows, sum, sum of squares) of the whole table: a tree in each task, merged FAN_IN at a time."""

    def grow(batches: Iterator[np.ndarray]) -> tuple[float, list]:
        tree = Leaves(radius, most)
        for x in batches:
            squares = (x**2).sum(axis=1)
            for row, square in zip(x, squares):
                tree.add(1.0, row, float(square))
        return tree.radius, tree.features()

    def merge(states: list) -> tuple[float, list]:
        tree = Leaves(max(r for r, _ in states), most)
        for _, features in states:
            for one in features:
                tree.add(*one)
        return tree.radius, tree.features()

    found = _merged(_by_task(_rows(df, key, vector), grow), merge)
    return found[1] if found else []


def ward(n: np.ndarray, centres: np.ndarray, k: int) -> np.ndarray:
    """Labels 0 to k - 1 of weighted centres, joined two at a time where the squares within grow least."""
    label, n, centres = np.arange(len(n)), n.astype(np.float64).copy(), centres.copy()
    cost = _gaps(centres, centres) * np.outer(n, n) / (n[:, None] + n[None, :])
    np.fill_diagonal(cost, np.inf)
    for _ in range(len(n) - k):
        a, b = sorted(np.unravel_index(int(cost.argmin()), cost.shape))
        label[label == b] = a
        centres[a], n[a] = (n[a] * centres[a] + n[b] * centres[b]) / (n[a] + n[b]), n[a] + n[b]
        cost[b], cost[:, b] = np.inf, np.inf
        alive = np.isfinite(cost[a])
        alive[a] = False
        row = _gaps(centres[a][None, :], centres)[0] * n[a] * n / (n[a] + n)
        cost[a, alive] = cost[alive, a] = row[alive]
    return np.unique(label, return_inverse=True)[1]


def birch(df: DataFrame, key: str, vector: str, k: int, radius: float = 0.5, most: int = 1024) -> DataFrame:
    """(key, bin): the cluster of the nearest leaf; leaves of a clustering-feature tree are joined by Ward's rule into k."""
    leaves = feature_leaves(df, key, vector, radius, most)
    if not leaves:
        return _rows(df, key, vector).select(F.col("k").alias(key), F.lit(0).alias("bin"))
    n, centres = np.array([x[0] for x in leaves]), np.array([x[1] / x[0] for x in leaves])
    order = np.lexsort(centres.T[::-1])
    return nearest(_rows(df, key, vector), key, centres[order], ward(n[order], centres[order], k))


# Mini-batches


class MiniBatches:
    """Centroids that carry counts: each row of a batch, by the centroids as they were before it, moves its nearest one by
    one over that one's count. `update` takes a table, so a stream feeds it by foreachBatch."""

    def __init__(self, centres: np.ndarray, batch: int = 100):
        self.centres, self.counts, self.batch = centres, np.zeros(len(centres)), batch

    def _learn(self, centres: np.ndarray, counts: np.ndarray, batches: Iterator[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        held = np.zeros((0, centres.shape[1]))
        for x in batches:
            held = np.vstack([held, x])
            while len(held) >= self.batch:
                centres, counts = moved(centres, counts, held[: self.batch])
                held = held[self.batch :]
        return moved(centres, counts, held) if len(held) else (centres, counts)

    def update(self, rows: DataFrame, vector: str = "v") -> None:
        """Tasks learn from the common state; a centroid is the mean of what it has seen, so their sums add up."""
        centres, counts, learn = self.centres, self.counts, self._learn

        def work(batches: Iterator[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
            c, n = learn(centres, counts, batches)
            return c * n[:, None] - centres * counts[:, None], n - counts

        found = _merged(_by_task(rows.select(F.col(vector).cast("array<double>").alias("v")), work), lambda states: tuple(sum(s[i] for s in states) for i in (0, 1)))
        if found:
            n = counts + found[1]
            self.centres = np.where(n[:, None] > 0, (centres * counts[:, None] + found[0]) / np.maximum(n, 1.0)[:, None], centres)
            self.counts = n


def moved(centres: np.ndarray, counts: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centroids and counts after one batch."""
    best = _gaps(x, centres).argmin(axis=1)
    gained = np.bincount(best, minlength=len(centres)).astype(np.float64)
    sums = np.zeros_like(centres)
    np.add.at(sums, best, x)
    n = counts + gained
    return np.where(n[:, None] > 0, (centres * counts[:, None] + sums) / np.maximum(n, 1.0)[:, None], centres), n


def mini_batch_kmeans(df: DataFrame, key: str, vector: str, k: int, batch: int = 100, epochs: int = 1, seed: int = 0) -> DataFrame:
    """(key, bin), centroids learned by batches in each task, from k rows chosen by hash."""
    rows = _rows(df, key, vector)
    first = _first_rows(rows, k, seed)
    if not len(first):
        return rows.select(F.col("k").alias(key), F.lit(0).alias("bin"))
    model = MiniBatches(first, batch)
    for number in range(epochs):
        model.update(rows.sortWithinPartitions(F.xxhash64("k", F.lit(seed + number)), "k"))
    return nearest(rows, key, model.centres)


# Bounds on sizes


def _moves(rows: DataFrame, bins: DataFrame, centres: np.ndarray, listed: int) -> list:
    """(k, bin, costs) of the rows that are among the `listed` cheapest of their cluster to move to some other one."""
    m = len(centres)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one in batches:
            if not one.num_rows:
                continue
            keys, bin_, cost = one.column(0).to_numpy(), one.column(2).to_numpy(), _gaps(matrix(one.column(1)), centres)
            extra = cost - cost[np.arange(len(bin_)), bin_][:, None]
            for a in np.unique(bin_).tolist():
                own = np.flatnonzero(bin_ == a)
                for b in range(m):
                    if b != a:
                        pick = own[np.lexsort((keys[own], extra[own, b]))[:listed]]
                        n = len(pick)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, a, np.int32)), pa.array(np.full(n, b, np.int32)), pa.array(keys[pick]), pa.array(extra[pick, b]), pa.array(cost[pick].tolist(), pa.list_(pa.float64()))], ["a", "b", "k", "extra", "costs"])

    found = rows.join(bins, "k").select("k", "v", "bin").mapInArrow(kernel, "a int, b int, k long, extra double, costs array<double>")
    best = Window.partitionBy("a", "b").orderBy("extra", "k")
    return found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= listed).collect()  # listed rows a pair of clusters


def _shortest(weight: np.ndarray, sources: np.ndarray, sinks: np.ndarray) -> list[int] | None:
    """The nodes of a cheapest path from a source to a sink, by relaxing all arcs at once."""
    cost, before = np.where(sources, 0.0, np.inf), np.full(len(weight), -1)
    for _ in range(len(weight)):
        through = cost[:, None] + weight
        best = through.argmin(axis=0)
        better = through[best, np.arange(len(weight))] < cost - 1e-12
        if not better.any():
            break
        cost, before = np.where(better, through[best, np.arange(len(weight))], cost), np.where(better, best, before)
    ends = np.where(sinks, cost, np.inf)
    if not np.isfinite(ends).any():
        return None
    path = [int(ends.argmin())]
    while before[path[-1]] >= 0 and not (sources[path[-1]] and cost[path[-1]] == 0.0):
        path.append(int(before[path[-1]]))
    return path[::-1]


def assign_within(rows: DataFrame, centres: np.ndarray, least: int, most: int, listed: int | None = None) -> DataFrame:
    """(k, bin) of the least total squared distance with `least` to `most` rows a cluster: a minimum-cost flow.

    It starts from the nearest centres, which costs least without bounds, and sends rows along cheapest paths from clusters
    with too many to clusters with too few; a step of a path moves the row for which it costs least. Tasks list the
    cheapest rows of each pair of clusters, the driver sends as many as the lists prove, and asks for new ones."""
    m, n = len(centres), rows.count()
    if not least * m <= n <= most * m:
        raise ValueError(f"{n} rows cannot be {least} to {most} a cluster in {m} clusters")
    listed = listed or max(1, 100_000 // (m * m))
    spark, scratch = rows.sparkSession, Scratch(rows.sparkSession)
    bins = scratch.keep(nearest(rows, "k", centres))
    size = np.zeros(m, np.int64)
    for b, count in bins.groupBy("bin").count().collect():  # a row a cluster
        size[b] = count
    flow = np.clip(size, least, most)  # what leaves a cluster; the last node takes all of it
    excess = np.append(size - flow, flow.sum() - n)
    while (excess > 0).any():
        costs, lists = {}, {}
        for r in sorted(_moves(rows, bins, centres, listed), key=lambda r: r["place"]):
            costs[r["k"]] = np.array(r["costs"])
            lists.setdefault((r["a"], r["b"]), []).append((r["extra"], r["k"]))
        whole = {pair for pair, cheapest in lists.items() if len(cheapest) < listed}
        changed: dict[int, int] = {}  # rows that have moved, and where they are
        heads, proven = dict.fromkeys(lists, 0), True
        while (excess > 0).any():
            weight, mover = np.full((m + 1, m + 1), np.inf), {}
            for (a, b), cheapest in lists.items():
                while heads[a, b] < len(cheapest) and cheapest[heads[a, b]][1] in changed:
                    heads[a, b] += 1
                if heads[a, b] < len(cheapest):
                    weight[a, b], mover[a, b] = cheapest[heads[a, b]]
                elif (a, b) not in whole:
                    proven = False  # the cheapest row of this pair may not be listed
            if not proven:
                break
            for k, a in changed.items():
                extra = costs[k] - costs[k][a]
                for b in range(m):
                    if b != a and (extra[b], k) < (weight[a, b], mover.get((a, b), k)):
                        weight[a, b], mover[a, b] = extra[b], k
            weight[:m, m] = np.where(flow < most, 0.0, np.inf)
            weight[m, :m] = np.where(flow > least, 0.0, np.inf)
            path = _shortest(weight, excess > 0, excess < 0)
            if path is None:
                raise RuntimeError("no path from a cluster with too many rows")
            excess[path[0]] -= 1
            excess[path[-1]] += 1
            for a, b in zip(path, path[1:]):
                if b == m:
                    flow[a] += 1
                elif a == m:
                    flow[b] -= 1
                else:
                    changed[mover[a, b]] = b
        if not changed:
            raise RuntimeError("the lists of moves are too short")
        moves = spark.createDataFrame(list(changed.items()), "k long, to int")
        bins = scratch.keep(bins.join(F.broadcast(moves), "k", "left").select("k", F.coalesce("to", "bin").alias("bin")))  # as many as were listed
    out = scratch.keep(bins, last=True)
    scratch.clear()
    return out


def constrained_kmeans(df: DataFrame, key: str, vector: str, k: int, least: int, most: int, iterations: int = 10, seed: int = 0) -> DataFrame:
    """(key, bin): k-means whose clusters have `least` to `most` rows; ends when no row moves, or after the iterations."""
    scratch = Scratch(df.sparkSession)
    rows = scratch.keep(_rows(df, key, vector))
    centres, bins = _first_rows(rows, k, seed), None
    for _ in range(iterations):
        new = assign_within(rows, centres, least, most)
        if bins is not None and new.join(bins.withColumnRenamed("bin", "old"), "k").where("bin <> old").isEmpty():
            break
        bins = new
        means = rows.join(bins, "k").groupBy("bin").agg(Summarizer.mean(array_to_vector("v")).alias("c")).collect()  # a row a cluster
        for r in means:
            centres[r["bin"]] = r["c"].toArray()
    scratch.clear()
    return bins.select(F.col("k").alias(key), "bin")
