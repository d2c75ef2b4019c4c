"""Medoid clustering in rounds: a partition within the cuts, of separated groups, the same on reruns."""

import numpy as np
import pytest

from binloom.operators import cluster, medoids, similarity


def blobs(seed=3, sizes=(60, 40, 30), scale=0.12, d=8):
    rng = np.random.default_rng(seed)
    return np.concatenate([rng.normal(size=d) * 2 + rng.normal(scale=scale, size=(n, d)) for n in sizes] + [rng.normal(size=(4, d)) * 9]), np.repeat(np.arange(len(sizes)), sizes)


@pytest.mark.parametrize("scale", [0.12, 0.6])
def test_rounds_part_the_rows_within_the_cuts(spark, scale):
    x, labels = blobs(scale=scale)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "k long, v array<double>").repartition(3)
    rows = medoids.medoid_rounds(df, "k", "v").collect()
    assert sorted(r["k"] for r in rows) == list(range(len(x)))
    u = similarity.unit(x)
    assert all(0.5 - 0.5 * u[r["k"]] @ u[r["medoid"]] <= r["cut"] + 1e-9 and r["bin"] == r["medoid"] and 0 < r["cut"] <= 0.3 for r in rows)
    assert all(r["k"] != r["medoid"] or r["bin"] == r["k"] for r in rows)
    assert len({(r["bin"], r["cut"]) for r in rows}) == len({r["bin"] for r in rows})
    assert sorted(map(tuple, rows)) == sorted(map(tuple, medoids.medoid_rounds(df.repartition(5), "k", "v").collect()))
    bins = {r["k"]: r["bin"] for r in rows}
    groups = {(bins[i], c) for i, c in enumerate(labels.tolist())}
    assert len({b for b, _ in groups}) == len(groups)  # no bin has rows of two groups
    if scale < 0.5:
        assert len(groups) == 3


def test_valleys_of_counts_are_those_of_distances():
    rng = np.random.default_rng(1)
    for _ in range(200):
        d = np.concatenate([[0.0], np.abs(rng.normal(0.03, 0.02, rng.integers(0, 60))), rng.uniform(0.1, 0.6, rng.integers(0, 200))])
        counts = np.histogram(d, 60, (0.0, 0.3))[0].astype(float)
        counts[0] -= 1
        assert cluster._valley(d, 0.1, cluster._smoothing()) == cluster.valley_of_counts(counts, 0.1)


def test_empty(spark):
    assert medoids.medoid_rounds(spark.createDataFrame([], "k long, v array<double>"), "k", "v").isEmpty()
