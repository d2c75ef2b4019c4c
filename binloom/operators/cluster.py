"""Clustering of embeddings: MLlib mixtures, density by a distance join, centroids, and medoid clustering."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import BisectingKMeans, GaussianMixture, KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from binloom import functions as G
from binloom.operators import similarity
from binloom.operators.features import vector_stats
from binloom.operators.graph import components
from binloom.sources.store import Scratch


def _with_mllib(estimator, df: DataFrame, key: str, vector: str) -> DataFrame:
    data = df.select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    model = estimator.setFeaturesCol("features").setPredictionCol("bin").fit(data)
    return model.transform(data).select(key, "bin")


def kmeans(df: DataFrame, key: str, vector: str, k: int, seed: int = 0, iterations: int = 20) -> DataFrame:
    return _with_mllib(KMeans(k=k, seed=seed, maxIter=iterations), df, key, vector)


def bisecting_kmeans(df: DataFrame, key: str, vector: str, k: int, seed: int = 0) -> DataFrame:
    return _with_mllib(BisectingKMeans(k=k, seed=seed), df, key, vector)


def gaussian_mixture(df: DataFrame, key: str, vector: str, k: int, seed: int = 0, iterations: int = 20) -> DataFrame:
    return _with_mllib(GaussianMixture(k=k, seed=seed, maxIter=iterations), df, key, vector)


def centroids(df: DataFrame, label: str, vector: str) -> DataFrame:
    return vector_stats(df, vector, label).select(label, "pos", "mean")


def nearest_centroid(df: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """(key, bin, distance2): the centroid at the least squared distance, ties to the lower label; centroids are few, a row
    a label, and are compared with blocks of rows."""
    packed = F.transform(F.array_sort(F.collect_list(F.struct("pos", "mean"))), lambda s: s["mean"])
    found = centroids(df, label, vector).groupBy(label).agg(packed.alias("c")).orderBy(label).collect()  # a row a label
    names, centres = [r[label] for r in found], np.array([r["c"] for r in found], np.float64)
    kind, named = df.schema[label].dataType.simpleString(), df.schema[key].dataType.simpleString()
    values = pa.array(names, to_arrow_type(df.schema[label].dataType))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one in batches:
            x = similarity.matrix(one.column(1))
            for a in range(0, len(x), 256):
                gap = ((x[a : a + 256, None, :] - centres[None]) ** 2).sum(axis=2)
                best = gap.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([one.column(0).slice(a, 256), values.take(pa.array(best)), pa.array(gap[np.arange(len(best)), best])], [key, "bin", "distance2"])

    return df.select(key, F.col(vector).cast("array<double>").alias("v")).mapInArrow(kernel, f"`{key}` {named}, bin {kind}, distance2 double")


def pair_distances(df: DataFrame, key: str, vector: str, most: float | None = None) -> DataFrame:
    """(i, j, distance), i < j, of all pairs, or of those within `most`."""
    return similarity.near_pairs(df, key, vector, most)


def top_neighbours(df: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """(i, j, score, rank): the k largest dot products of each row, itself included; ties (of 6 digits) to the lower key."""
    return similarity.top_products(df, key, vector, k)


def _unit_sums(df: DataFrame, vector: str, label: str | None = None) -> DataFrame:
    """(label, n, length2): rows, and the squared length of the sum of their vectors of length 1."""
    by = [label] if label else []
    unit = F.transform(G.medoid_normalise(F.col(vector)), lambda x: x * F.sqrt(F.lit(2.0)))
    sums = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), Summarizer.sum(array_to_vector(unit)).alias("__s"))
    return sums.select(*by, "n", G.dot(vector_to_array("__s"), vector_to_array("__s")).alias("length2"))


def label_cosines(df: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """(same, pairs, mean): the mean cosine of pairs of equal and of unequal labels.

    The cosines of all pairs add up to (|S|^2 - n) / 2, S being the sum of the n vectors of length 1: no pair is formed."""
    both = lambda t: t.agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).cast("long").alias("pairs"), F.sum((F.col("length2") - F.col("n")) / 2).alias("s"))
    same, every = both(_unit_sums(df, vector, label)), both(_unit_sums(df, vector)).toDF("pairs2", "s2")
    one = same.crossJoin(F.broadcast(every))  # single rows
    halves = F.array(F.struct(F.lit(True).alias("same"), "pairs", "s"), F.struct(F.lit(False).alias("same"), (F.col("pairs2") - F.col("pairs")).alias("pairs"), (F.col("s2") - F.col("s")).alias("s")))
    return one.select(F.explode(halves).alias("h")).select("h.*").where("pairs > 0").select("same", "pairs", (F.col("s") / F.col("pairs")).alias("mean"))


def similarity_means(df: DataFrame, key: str, vector: str, label: str, edges: DataFrame) -> DataFrame:
    """One row (label_mean, edge_mean, global_mean) of cosines: the mean over labels of two rows and more of the mean of all
    their ordered pairs, each row with itself included; over the edges; over all other ordered pairs. Null is no label."""
    labels = _unit_sums(df.where(F.col(label).isNotNull()), vector, label).where("n > 1").agg(F.avg(F.col("length2") / (F.col("n") * F.col("n"))).alias("label_mean"))
    nodes = df.select(F.col(key).alias("node"), vector)
    a, b = nodes.select(F.col("node").alias("src"), F.col(vector).alias("a")), nodes.select(F.col("node").alias("dst"), F.col(vector).alias("b"))
    cosine = 2 * G.dot(G.medoid_normalise(F.col("a")), G.medoid_normalise(F.col("b")))
    linked = edges.select("src", "dst").join(a, "src").join(b, "dst").agg(F.count(F.lit(1)).alias("m"), F.coalesce(F.sum(cosine), F.lit(0.0)).alias("e"))
    one = _unit_sums(df, vector).crossJoin(F.broadcast(linked)).crossJoin(F.broadcast(labels))  # single rows
    n2 = F.col("n") * F.col("n")
    return one.select("label_mean", (F.col("e") / F.nullif("m", F.lit(0))).alias("edge_mean"), ((F.col("length2") - F.col("e")) / F.nullif(n2 - F.col("m"), F.lit(0))).alias("global_mean"))


def dbscan(df: DataFrame, key: str, vector: str, radius: float, least: int) -> DataFrame:
    """(key, neighbours, core, bin): core points have `least` points in the radius, themselves included; bins are the
    components of core points, border points join the least one near; -1 is noise."""
    near = Scratch(df.sparkSession).keep(pair_distances(df, key, vector, radius).select("i", "j"), last=True)
    both = near.unionByName(near.select(F.col("j").alias("i"), F.col("i").alias("j")))
    counts = df.select(F.col(key).alias("i")).join(both.groupBy("i").agg(F.count(F.lit(1)).alias("n")), "i", "left")
    counts = counts.select("i", (F.coalesce("n", F.lit(0)) + 1).alias("neighbours")).withColumn("core", F.col("neighbours") >= least)
    cores = counts.where("core").select("i")
    links = both.join(cores, "i", "left_semi").join(cores.withColumnRenamed("i", "j"), "j", "left_semi")
    loops = cores.select("i", F.col("i").alias("j"))
    label = components(links.unionByName(loops).select(F.col("i").alias("src"), F.col("j").alias("dst")))
    border = both.join(label.withColumnsRenamed({"node": "j"}), "j").groupBy("i").agg(F.min("component").alias("b"))
    out = counts.join(label.withColumnsRenamed({"node": "i"}), "i", "left").join(border, "i", "left")
    return out.select(F.col("i").alias(key), "neighbours", "core", F.coalesce("component", F.when(~F.col("core"), F.col("b")), F.lit(-1)).alias("bin"))


def _smoothing() -> np.ndarray:
    pdf = np.exp(-0.5 * (np.linspace(-0.075, 0.075, 31) / 0.01) ** 2)
    return pdf / pdf.sum()


def _valley(distances: np.ndarray, ratio: float, pdf: np.ndarray) -> float | None:
    """As valley_of_counts, of a medoid's distances, its own included."""
    counts = np.histogram(distances, 60, (0.0, 0.3))[0].astype(float)
    counts[0] -= 1  # the medoid itself
    return valley_of_counts(counts, ratio, pdf)


def valley_of_counts(counts: np.ndarray, ratio: float, pdf: np.ndarray | None = None) -> float | None:
    """The distance at which the density of a medoid's neighbours, counted in 60 parts up to 0.3, falls off, None if there is
    no such valley."""
    pdf = _smoothing() if pdf is None else pdf
    if not counts[:10].any():
        return 0.025
    density = np.convolve(counts, pdf, "same")
    falls = np.flatnonzero(density < 0.6 * np.maximum.accumulate(density))
    if not len(falls) or int(density[: falls[0]].argmax()) * 0.005 > 0.1:
        return None
    peak, tail = density[: falls[0]].max(), density[falls[0] :]
    rises = np.flatnonzero(tail > 1.5 * np.minimum.accumulate(tail))
    tail = tail[: rises[0]] if len(rises) else tail
    low = int(tail.argmin())
    cut = (falls[0] + low) * 0.005
    return float(cut) if tail[low] < ratio * peak and cut <= 0.2 + ratio else None


#: Angle of the distance 0.3, the furthest that a valley is looked for.
REACH = float(np.arccos(0.4))
#: Seeds whose products are made at once, and products held at most.
SEEDS, PRODUCTS = 64, 1 << 24


class _Left:
    """Single-precision products of seeds with the rows left, which show who can be near; double precision decides.

    Seeds go next to each other in one matrix product; rows that are gone are dropped before one is made."""

    def __init__(self, x: np.ndarray, alive: np.ndarray):
        self.x, self.alive, self.compared = x, alive, 0
        self.ids, self.small = np.arange(len(x)), x.astype(np.float32)
        self.made: dict[int, np.ndarray] = {}
        self.seeds, self.used = 1, 0

    def seed(self, start: int, later: Iterator[int]) -> None:
        """Turn to a seed; `later` are those that follow it."""
        if start not in self.made:
            self.seeds = max(1, min(SEEDS, self.seeds * 2 if 2 * self.used >= self.seeds else self.seeds // 2, PRODUCTS // max(1, len(self.ids))))
            some, self.made, self.used = [start, *islice(later, self.seeds - 1)], {}, 0
            kept = self.alive[self.ids]
            if kept.sum() < 0.75 * len(kept):
                self.ids, self.small = self.ids[kept], self.small[kept]
            self.made = dict(zip(some, self.x[some].astype(np.float32) @ self.small.T))
            self.compared += len(some) * len(self.ids)
        self.used += 1
        self.start, self.products = start, self.made.pop(start)
        self.first = self._among(REACH, None)

    def _among(self, angle: float, places: np.ndarray | None) -> np.ndarray:
        """Places of rows that may be within an angle of the seed."""
        some = self.products if places is None else self.products[places]
        far = some < 0.5 * np.cos(min(angle + similarity.ANGLE_SLACK, np.pi)) - similarity.SCREEN_SLACK
        found = np.flatnonzero(~far)
        return found if places is None else places[found]

    def around(self, m: int, reach: float) -> tuple[np.ndarray, np.ndarray]:
        """(rows left, distances) of row m, of all within an angle of it and some more. They are no further from the seed
        than m and the angle together."""
        turn = 0.0 if m == self.start else float(np.arccos(np.clip(2.0 * (self.x[m] @ self.x[self.start]), -1.0, 1.0)))
        places = self._among(turn + reach, self.first if turn + reach <= REACH else None)
        places = places[self.alive[self.ids[places]]]
        self.compared += len(places)
        if m != self.start and len(places) > 1024:
            near = self.small[places] @ self.x[m].astype(np.float32)
            places = places[~(near < 0.5 * np.cos(reach) - similarity.SCREEN_SLACK)]
        rows = self.ids[places]
        d = 0.5 - np.einsum("nd,d->n", self.x[rows], self.x[m])  # the same in both directions and in whatever company
        d[rows == m] = 0.0
        return rows, d


def medoid_turns(x: np.ndarray, lone: np.ndarray | None = None, radius: float = 0.05, default: float = 0.06, seed: int = 0, tries: int = 25, window: int = 200, least: int = 20, left: _Left | None = None) -> Iterator[tuple[np.ndarray, int, float]]:
    """(rows, medoid, cut) of the medoid clusters of normalised rows, one by one: wander to a medoid of lower mean distance,
    cut at the valley of the density.

    A seed without a valley stays for later. If fewer than `least` of the last `window` seeds had one, the valley may be
    shallower by 0.1 of the peak; once that ratio is over 0.55, a seed without one is cut at `default`. `lone` rows have none
    within the radius, so they stand alone whatever else is left, and are not compared with any.
    """
    rng = np.random.default_rng(seed)
    left = left or _Left(x, np.ones(len(x), bool))
    alive, waiting = left.alive, deque(rng.permutation(len(x)).tolist())
    lone = np.zeros(len(x), bool) if lone is None else lone
    pdf = _smoothing()
    ratio, recent, inner = 0.1, deque(maxlen=window), float(np.arccos(1.0 - 2.0 * radius))
    while waiting:
        start = waiting.popleft()
        if not alive[start]:
            continue
        if lone[start]:
            medoid, cut, members = start, 0.025, np.array([start])
        else:
            left.seed(start, (i for i in waiting if alive[i] and not lone[i]))
            rows, d = left.around(start, inner)
            medoid, futile, seen, inside, mean = start, 0, {start}, rows[d <= radius], d[d <= radius].mean()
            while futile < tries:
                fresh = inside[np.isin(inside, list(seen), invert=True)]
                if not len(fresh):
                    break
                other = int(fresh[int(rng.integers(len(fresh)))])
                seen.add(other)
                rows, d = left.around(other, inner)
                if (lower := d[d <= radius].mean()) < mean:
                    medoid, futile, inside, mean = other, 0, rows[d <= radius], lower
                else:
                    futile += 1
            rows, d = left.around(medoid, REACH)
            cut = _valley(d, ratio, pdf)
            if cut is None and ratio > 0.55:
                cut = default
            members = rows[d <= cut] if cut is not None else None
        recent.append(cut is not None)
        if cut is None:
            waiting.append(start)
        else:
            alive[members] = False
            yield members, medoid, cut
            if alive[start]:
                waiting.append(start)
        if len(recent) == window and sum(recent) < least:
            ratio += 0.1
            recent.clear()


def medoid_kernel(keys: np.ndarray, x: np.ndarray, radius: float = 0.05, default: float = 0.06, seed: int = 0, tries: int = 25, window: int = 200, least: int = 20) -> list[tuple]:
    """(key, cluster, key of the medoid, cut) of medoid_turns."""
    turns = medoid_turns(x, None, radius, default, seed, tries, window, least)
    return [(keys[i], cluster, keys[medoid], cut) for cluster, (members, medoid, cut) in enumerate(turns) for i in members]


def medoid_bins(df: DataFrame, key: str, vector: str, seed: int = 0, most: int = 1_000_000) -> DataFrame:
    """(key, bin, medoid, cut): iterative medoid clustering. Rows without another in the radius are found by a join in all
    tasks; which seed comes next hangs on all before it, so the turns are taken in one task, which is refused for more than
    `most` rows: cluster parts of the graph, or take medoid_rounds, beyond."""
    n = df.count()
    if n > most:
        raise ValueError(f"medoid clustering runs in one task and is meant for {most} rows at most")
    near = similarity.near_rows(df, key, vector, 0.05).select("k", F.lit(False).alias("lone"))
    rows = df.select(F.col(key).cast("long").alias("k"), G.medoid_normalise(F.col(vector)).alias("v")).join(near, "k", "left")
    rows = rows.select("k", "v", F.coalesce("lone", F.lit(True)).alias("lone")).repartition(1).sortWithinPartitions("k")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, lone, x, at = np.empty(n, np.int64), np.empty(n, bool), None, 0
        for one in batches:
            some = slice(at, at := at + one.num_rows)
            v = similarity.matrix(one.column(1))
            x = np.empty((n, v.shape[1])) if x is None else x
            keys[some], x[some], lone[some] = one.column(0).to_numpy(), v, one.column(2).to_numpy(zero_copy_only=False)
        turns = enumerate(medoid_turns(x, lone, seed=seed) if at else ())
        while some := list(islice(turns, similarity.BATCH_ROWS)):
            sizes = [len(members) for _, (members, _, _) in some]
            of = lambda values, kind: pa.array(np.repeat(np.array(values, kind), sizes))
            members = np.concatenate([members for _, (members, _, _) in some])
            yield pa.RecordBatch.from_arrays([pa.array(keys[members]), of([c for c, _ in some], np.int64), of([keys[m] for _, (_, m, _) in some], np.int64), of([cut for _, (_, _, cut) in some], np.float64)], [key, "bin", "medoid", "cut"])

    return rows.mapInArrow(kernel, f"`{key}` long, bin long, medoid long, cut double")
