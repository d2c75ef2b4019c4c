"""Losses of given embeddings and reconstructions as one aggregate each, and layers and models without a training loop."""

from __future__ import annotations

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import PCA, IndexToString, StringIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from binloom import functions as G
from binloom.operators.blocks import Blocks, added
from binloom.operators.cluster import nearest_centroid

# Share of the k-mer part in the reconstruction loss, weight of the divergence, bounds of the log variance,
# the guard inside a logarithm, and the two guards of the fraction aggregator.
KMER_SHARE, KLD_WEIGHT, LOGVAR, LOG_GUARD, LAF_EPS, LAF_GUARD = 0.15, 1 / 200, (-2.0, 2.0), 1e-9, 1e-6, 1e-3


def softplus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def pair_cosines(pairs: DataFrame, nodes: DataFrame, node: str, vector: str) -> DataFrame:
    """The pairs with the cosine of their ends' vectors; 0 if one of them is all zeros."""
    a, b = nodes.select(F.col(node).alias("src"), F.col(vector).alias("__a")), nodes.select(F.col(node).alias("dst"), F.col(vector).alias("__b"))
    return pairs.join(a, "src").join(b, "dst").withColumn("cosine", F.coalesce(G.cosine(F.col("__a"), F.col("__b")), F.lit(0.0))).drop("__a", "__b")


def edge_loss(positive: DataFrame, negative: DataFrame, nodes: DataFrame, node: str, vector: str) -> DataFrame:
    """One row (pos, neg, loss): mean cosines of edges and of drawn pairs, and the cross-entropy with the cosines as logits."""
    both = positive.select("src", "dst", F.lit(1.0).alias("y")).unionByName(negative.select("src", "dst", F.lit(0.0).alias("y")))
    c, y = F.col("cosine"), F.col("y")
    scored = pair_cosines(both, nodes, node, vector)
    return scored.agg(F.avg(F.when(y == 1, c)).alias("pos"), F.avg(F.when(y == 0, c)).alias("neg"), F.avg(softplus(c) - y * c).alias("loss"))


def marker_loss(pairs: DataFrame, nodes: DataFrame, node: str, vector: str) -> DataFrame:
    """One row (pairs, loss): cross-entropy that pushes must-differ pairs apart, with a single positive of logit 1."""
    scored = pair_cosines(pairs, nodes, node, vector)
    one = softplus(F.lit(1.0)) - 1.0
    return scored.agg(F.count(F.lit(1)).alias("pairs"), ((F.coalesce(F.sum(softplus(F.col("cosine"))), F.lit(0.0)) + one) / (F.count(F.lit(1)) + 1)).alias("loss"))


def _mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size(values), F.lit(0))


def autoencoder_loss(df: DataFrame, x: str, x_hat: str, mu: str, logvar: str, samples: int, kmer_share: float = KMER_SHARE, kld_weight: float = KLD_WEIGHT) -> DataFrame:
    """One row (abundance, kmer, kld, loss) of given reconstructions.

    The first `samples` places are abundances (cross-entropy; squared error if there is one sample only), the others k-mers.
    """
    if samples > 1:
        terms = F.zip_with(F.slice(x, 1, samples), F.slice(x_hat, 1, samples), lambda a, b: a * F.ln(b + LOG_GUARD))
        abundance = -F.aggregate(terms, F.lit(0.0), lambda s, t: s + t)
    else:
        abundance = F.pow(F.col(x)[0] - F.col(x_hat)[0], 2)
    rest = lambda c: F.slice(c, samples + 1, F.greatest(F.size(c) - samples, F.lit(0)))
    kmer = _mean(F.zip_with(rest(x), rest(x_hat), lambda a, b: (a - b) * (a - b)))
    kld = -0.5 * _mean(F.zip_with(mu, F.transform(logvar, lambda v: G.clip(v, *LOGVAR)), lambda m, v: 1.0 + v - m * m - F.exp(v)))
    out = df.agg((F.avg(abundance) * (1 - kmer_share)).alias("abundance"), (F.avg(kmer) * kmer_share).alias("kmer"), (F.avg(kld) * kld_weight).alias("kld"))
    return out.withColumn("loss", F.col("abundance") + F.col("kmer") + F.col("kld"))


def centroid_loss(df: DataFrame, key: str, vector: str, label: str, members: DataFrame) -> DataFrame:
    """One row (points, loss): mean squared distance of the members to the nearest of all bins' centroids."""
    near = nearest_centroid(df, key, vector, label).join(members, key, "left_semi")
    return near.agg(F.count(F.lit(1)).alias("points"), F.avg("distance2").alias("loss"))


def sage(adjacency: DataFrame, features: DataFrame, value: str, columns: list[str], node: str) -> DataFrame:
    """(node, columns, near_columns): each node's own features beside its neighbours' sums, 0 without neighbours."""
    x = features.select(F.col(node).alias("dst"), *[F.col(c).alias(f"__{c}") for c in columns])
    near = adjacency.join(x, "dst").groupBy(F.col("src").alias(node)).agg(*[F.sum(F.col(value) * F.col(f"__{c}")).alias(f"near_{c}") for c in columns])
    return features.join(near, node, "left").select(node, *columns, *[F.coalesce(f"near_{c}", F.lit(0.0)).alias(f"near_{c}") for c in columns])


def learned_fraction(adjacency: DataFrame, features: DataFrame, value: str, column: str, node: str, inner: tuple[float, ...], outer: tuple[float, ...], scale: tuple[float, ...]) -> DataFrame:
    """(src, value): the learned aggregator, a fraction of two sums of powers over each node's neighbours.

    With s the sigmoid of the feature, term k is scale[k] * (sum of value * u^inner[k])^outer[k], u = s for the first and
    third term and 1 - s for the others; terms 1 and 2 are the numerator. Negative exponents count as 0.
    """
    s = G.clip(G.sigmoid(F.col(column).cast("double")), LAF_EPS, 1 - LAF_EPS)
    x = features.select(F.col(node).alias("dst"), s.alias("s"))
    u = [F.col("s"), 1 - F.col("s")] * 2
    sums = adjacency.join(x, "dst").groupBy("src").agg(*[F.sum(F.col(value) * F.pow(u[k], F.lit(max(inner[k], 0.0)))).alias(f"t{k}") for k in range(4)])
    t = [F.pow(F.col(f"t{k}") + LAF_EPS, F.lit(max(outer[k], 0.0))) * scale[k] for k in range(4)]
    below = t[2] + t[3]
    return sums.select("src", ((t[0] + t[1]) * below / (below * below + LAF_GUARD)).alias("value"))


def learned_fractions(adjacency: DataFrame | Blocks, features: DataFrame, value: str, columns: list[str], node: str, units: list[tuple[tuple[float, ...], tuple[float, ...], tuple[float, ...]]], wanted: list[tuple[int, int]] | None = None) -> DataFrame:
    """(src, out): of each column, as a list, the value of each unit (inner, outer, scale) of the learned aggregator; one
    join with the neighbours gives the sums of all. Of Blocks (which have their values), sums are made of the `wanted`
    pairs (column, unit) only, the others are null."""
    wanted = wanted or [(i, j) for i in range(len(columns)) for j in range(len(units))]
    s = [G.clip(G.sigmoid(F.col(c).cast("double")), LAF_EPS, 1 - LAF_EPS).alias(f"s{i}") for i, c in enumerate(columns)]
    if isinstance(adjacency, Blocks):
        return _fractions(_power_sums(adjacency, features.select(F.col(node).alias("node"), *s), len(columns), units, wanted), len(columns), units, wanted)
    met = adjacency.join(features.select(F.col(node).alias("dst"), *s), "dst")
    side = lambda i, k: F.col(f"s{i}") if k % 2 == 0 else 1 - F.col(f"s{i}")
    sums = {(i, j, k): F.sum(F.col(value) * F.pow(side(i, k), F.lit(max(inner[k], 0.0)))).alias(f"t{i}_{j}_{k}") for i, j in wanted for inner in [units[j][0]] for k in range(4)}
    return _fractions(met.groupBy("src").agg(*sums.values()), len(columns), units, wanted)


def _power_sums(adjacency: Blocks, features: DataFrame, columns: int, units: list, wanted: list[tuple[int, int]]) -> DataFrame:
    """(src, t of each column, unit and term) over the neighbours; a missing feature is no summand, a sum of none is null."""

    def step(near: np.ndarray, far: np.ndarray, value: np.ndarray, x: np.ndarray) -> np.ndarray:
        known = ~np.isnan(x)
        x = np.where(known, x, 0.5)
        terms = [np.where(known[:, i], np.power(x[:, i] if k % 2 == 0 else 1.0 - x[:, i], max(units[j][0][k], 0.0)), 0.0) for i, j in wanted for k in range(4)]
        out = added(near, far, value, np.stack(terms, axis=1))
        if not known.all():
            some = np.stack([np.bincount(near, known[far, i], len(x)) > 0 for i in range(columns)], axis=1)
            out = np.where(np.repeat(some[:, [i for i, _ in wanted]], 4, axis=1), out, np.nan)
        return out

    names = [f"t{i}_{j}_{k}" for i, j in wanted for k in range(4)]
    parts = adjacency.meet(adjacency.degrees.select("node").join(features, "node", "left"), F.array(*[f"s{i}" for i in range(columns)]), step)
    part = [F.col("part")[c] for c in range(len(names))]
    return parts.groupBy(F.col("node").alias("src")).agg(*[F.sum(F.when(~F.isnan(p), p)).alias(name) for p, name in zip(part, names)])


def _fractions(sums: DataFrame, columns: int, units: list, wanted: list[tuple[int, int]]) -> DataFrame:
    def fraction(i: int, j: int) -> Column:
        if (i, j) not in wanted:
            return F.lit(None).cast("double")
        _, outer, scale = units[j]
        t = [F.pow(F.col(f"t{i}_{j}_{k}") + LAF_EPS, F.lit(max(outer[k], 0.0))) * scale[k] for k in range(4)]
        return (t[0] + t[1]) * (t[2] + t[3]) / ((t[2] + t[3]) * (t[2] + t[3]) + LAF_GUARD)

    out = F.array(*[F.array(*[fraction(i, j) for j in range(len(units))]) for i in range(columns)])
    return sums.select("src", out.alias("out"))


def principal_components(df: DataFrame, key: str, vector: str, k: int = 2) -> DataFrame:
    """(key, projected): coordinates on the first k principal components."""
    data = df.select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    model = PCA(k=k, inputCol="features", outputCol="projected").fit(data)
    return model.transform(data).select(key, vector_to_array("projected").alias("projected"))


def label_classifier(labelled: DataFrame, unlabelled: DataFrame, key: str, vector: str, label: str, iterations: int = 20) -> DataFrame:
    """(key, predicted): a multinomial logistic fit on the labelled rows, applied to the others."""
    feature = array_to_vector(F.col(vector).cast("array<double>")).alias("features")
    train = labelled.select(F.col(label).cast("string").alias("label"), feature)
    indexer = StringIndexer(inputCol="label", outputCol="y").fit(train)
    steps = [LogisticRegression(featuresCol="features", labelCol="y", predictionCol="p", maxIter=iterations), IndexToString(inputCol="p", outputCol="predicted", labels=indexer.labels)]
    return Pipeline(stages=steps).fit(indexer.transform(train)).transform(unlabelled.select(key, feature)).select(key, "predicted")
