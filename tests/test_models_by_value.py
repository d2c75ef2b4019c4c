"""Clusters, mixtures, projections and classifiers against plain versions; components of hubs and chains."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from binloom.operators import cluster, graph, models
from binloom.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def blobs(k=3, n=30, d=4, seed=2):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(k, d)) * 5
    return np.concatenate([c + rng.normal(scale=0.3, size=(n, d)) for c in centres]), np.repeat(np.arange(k), n), centres


@pytest.fixture(scope="module")
def table(spark):
    x, labels, _ = blobs()
    return spark.createDataFrame([(i, v.tolist(), f"c{labels[i]}") for i, v in enumerate(x)], "k long, v array<double>, label string").repartition(3)


def inertia(x, bins):
    return sum(((x[bins == b] - x[bins == b].mean(axis=0)) ** 2).sum() for b in set(bins))


@pytest.mark.parametrize("fit", [lambda t, seed: cluster.kmeans(t, "k", "v", 3, seed), lambda t, seed: cluster.gaussian_mixture(t, "k", "v", 3, seed, 60), lambda t, seed: cluster.bisecting_kmeans(t, "k", "v", 3, seed)], ids=["kmeans", "mixture", "bisecting"])
def test_separated_groups_are_found(table, fit):
    """By some start at least: each is a local search."""
    x, labels, _ = blobs()
    found = []
    for seed in range(6):
        got = {r["k"]: r["bin"] for r in fit(table, seed).collect()}
        assert set(got) == set(range(len(x))) and set(got.values()) <= {0, 1, 2}
        found.append(len({(got[i], c) for i, c in enumerate(labels.tolist())}) == 3 == len(set(got.values())))
        if found[-1]:
            break
    assert found[-1]


def test_kmeans_is_a_fixed_point_of_its_own_step(spark):
    """Each row is in the cluster of the nearest mean, and the squares within are near those of plain runs."""
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("v")).toPandas()
    x = np.stack(vectors["v"])
    got = {r["vec_id"]: r["bin"] for r in QUERIES["kmeans_bins"](spark, SF).collect()}
    bins = np.array([got[i] for i in vectors["vec_id"]])
    best = np.inf
    for seed in range(5):
        c = x[np.random.default_rng(seed).choice(len(x), 10, replace=False)]
        for _ in range(30):
            near = ((x[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
            c = np.array([x[near == b].mean(axis=0) if (near == b).any() else c[b] for b in range(10)])
        best = min(best, inertia(x, near))
    assert inertia(x, bins) < 1.1 * best


def test_components_are_the_axes_of_largest_variance(table):
    x, _, _ = blobs()
    got = {r["k"]: r["projected"] for r in models.principal_components(table, "k", "v", 2).collect()}
    p = np.array([got[i] for i in range(len(x))])
    values, axes = np.linalg.eigh(np.cov(x.T))
    want = x @ axes[:, ::-1][:, :2]
    assert np.allclose(np.abs(p), np.abs(want), atol=1e-8)


def test_a_classifier_learns_separated_labels(table):
    known, rest = table.where("k % 2 = 0"), table.where("k % 2 = 1")
    got = {r["k"]: r["predicted"] for r in models.label_classifier(known, rest, "k", "v", "label").collect()}
    assert got == {r["k"]: r["label"] for r in rest.collect()}


def test_a_hub_and_a_chain_are_one_component_each(spark):
    hub = spark.range(2, 400).select(F.lit(1).cast("long").alias("src"), F.col("id").alias("dst"))
    chain = spark.range(1000, 1300).select((F.col("id") * 7919 % 1300 + 10_000).alias("src"), ((F.col("id") + 1) * 7919 % 1300 + 10_000).alias("dst"))
    loop = spark.range(5, 6).select((F.col("id") + 90_000).alias("src"), (F.col("id") + 90_000).alias("dst"))
    got = graph.components(hub.unionByName(chain).unionByName(loop)).collect()
    ends = {(i * 7919) % 1300 + 10_000 for i in range(1000, 1301)}
    want = {i: 1 for i in range(1, 400)} | {i: min(ends) for i in ends} | {90_005: 90_005}
    assert {r["node"]: r["component"] for r in got} == want and len(got) == len(want)
