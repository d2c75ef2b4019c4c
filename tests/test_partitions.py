"""Spectral, clustering-feature, mini-batch and bounded clusters against plain versions."""

import itertools

import numpy as np
import pytest

from binloom.operators import partitions


def table(spark, x, parts=3):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "k long, v array<double>").repartition(parts)


def blobs(k=4, n=15, d=5, scale=0.2, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(k, d)) * 4
    return np.concatenate([c + rng.normal(scale=scale, size=(n, d)) for c in centres]), np.repeat(np.arange(k), n)


def same_parts(rows, labels, key="k"):
    got = {r[key]: r["bin"] for r in rows}
    return len(got) == len(labels) and len({(got[i], int(c)) for i, c in enumerate(labels)}) == len(set(got.values())) == len(set(labels.tolist()))


def test_eigenvectors_equal_numpy(spark):
    rng = np.random.default_rng(5)
    n, k = 40, 3
    a = rng.random((n, n)) * (rng.random((n, n)) < 0.3) * (1 + 4 * (np.arange(n)[:, None] % 3 == np.arange(n)[None, :] % 3))
    a = (a + a.T) / 2 + np.eye(n)
    s = 1 / np.sqrt(a.sum(axis=1))
    a = a * np.outer(s, s)
    edges = spark.createDataFrame([(int(i), int(j), float(a[i, j])) for i, j in zip(*np.nonzero(a))], "src long, dst long, value double").repartition(3)
    out, values, rounds = partitions.top_eigenvectors(edges, spark.range(n).withColumnRenamed("id", "node"), k, 1e-8)
    x = np.array([r["x"] for r in sorted(out.collect(), key=lambda r: r["node"])])
    want, vectors = np.linalg.eigh(a)
    assert np.allclose(values, want[::-1][:k], atol=1e-9) and rounds < 60
    top = vectors[:, ::-1][:, :k]
    assert np.abs(x.T @ x - np.eye(k)).max() < 1e-8
    assert np.linalg.norm(x - top @ (top.T @ x)) < 1e-6


def test_spectral_finds_separated_groups(spark):
    x, labels = blobs(3, 14)
    assert same_parts(partitions.spectral(table(spark, x), "k", "v", 3, neighbours=5).collect(), labels)


def test_spectral_bins_are_of_eigenvectors_to_the_tolerance(spark, monkeypatch):
    from binloom.plans import queries

    found = []

    def seen(adjacency, nodes, *more, **others):
        edges, whole = adjacency.collect(), partitions_top(adjacency, nodes, *more, **others)
        found.append((edges, whole[0].collect(), whole[1]))
        return whole

    partitions_top = partitions.top_eigenvectors
    monkeypatch.setattr(partitions, "top_eigenvectors", seen)
    assert queries.QUERIES["spectral_bins"](spark, "/root/testdata/sf0.001").count() > 0
    edges, rows, values = found[0]
    at = {r["node"]: i for i, r in enumerate(rows)}
    x, a = np.array([r["x"] for r in rows]), np.zeros((len(rows), len(rows)))
    for r in edges:
        a[at[r["src"]], at[r["dst"]]] += r["value"]
    assert np.linalg.norm(a @ x - x * values, axis=0).max() < 1e-3
    assert np.allclose(values, np.linalg.eigvalsh(a)[::-1][:8], atol=1e-3)


def test_too_few_rounds_are_an_error(spark):
    n = 30
    edges = spark.createDataFrame([(i, j, 0.5) for i in range(n) for j in (i - 1, i + 1) if 0 <= j < n], "src long, dst long, value double")
    with pytest.raises(RuntimeError, match="after 2 rounds"):
        partitions.top_eigenvectors(edges, spark.range(n).withColumnRenamed("id", "node"), 2, 1e-8, most=2)


@pytest.mark.parametrize("most, radius", [(1000, 0.3), (20, 0.01)])
def test_leaves_add_up_to_the_table(spark, most, radius):
    x, _ = blobs(4, 60)
    leaves = partitions.feature_leaves(table(spark, x, 20), "k", "v", radius, most)
    assert len(leaves) <= most
    assert sum(n for n, _, _ in leaves) == len(x)
    assert np.allclose(sum(s for _, s, _ in leaves), x.sum(axis=0)) and sum(q for _, _, q in leaves) == pytest.approx((x**2).sum())
    assert most > 20 or len(leaves) > 3


def test_a_tree_keeps_its_radius_and_order():
    x, _ = blobs(5, 100, scale=0.5)
    tree = partitions.Leaves(0.4, 10_000, branching=4)
    for row in x:
        tree.add(1.0, row, float((row**2).sum()))
    assert tree.count == len(tree.features()) > 20
    for n, s, q in tree.features():
        assert q / n - ((s / n) ** 2).sum() <= 0.16 + 1e-9


def test_birch_finds_separated_groups(spark):
    x, labels = blobs(4, 30)
    assert same_parts(partitions.birch(table(spark, x), "k", "v", 4, 0.5).collect(), labels)
    assert same_parts(partitions.birch(table(spark, x), "k", "v", 4, 0.01, 30).collect(), labels)


def test_ward_equals_a_plain_version():
    rng = np.random.default_rng(1)
    for _ in range(20):
        x, n = rng.normal(size=(9, 2)), rng.integers(1, 5, 9)
        groups = [[i] for i in range(9)]

        def within(g):
            c = np.average(x[g], axis=0, weights=n[g])
            return float((n[g][:, None] * (x[g] - c) ** 2).sum())

        while len(groups) > 3:
            a, b = min(itertools.combinations(range(len(groups)), 2), key=lambda p: within(groups[p[0]] + groups[p[1]]) - within(groups[p[0]]) - within(groups[p[1]]))
            groups[a] += groups.pop(b)
        label = partitions.ward(n, x, 3)
        assert {frozenset(g) for g in groups} == {frozenset(np.flatnonzero(label == k).tolist()) for k in range(3)}


def test_mini_batches_in_one_partition_equal_a_plain_loop(spark):
    x, _ = blobs(3, 40)
    model = partitions.MiniBatches(x[[0, 50, 100]].copy(), batch=16)
    rows = table(spark, x, 1).coalesce(1).sortWithinPartitions("k")
    model.update(rows)
    centres, counts = x[[0, 50, 100]].copy(), np.zeros(3)
    for a in range(0, len(x), 16):
        part = x[a : a + 16]
        near = ((part[:, None, :] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        for row, b in zip(part, near):
            counts[b] += 1
            centres[b] += (row - centres[b]) / counts[b]
    assert np.allclose(model.centres, centres) and np.array_equal(model.counts, counts)
    model.update(rows.limit(0))
    assert np.allclose(model.centres, centres)


def test_mini_batches_follow_a_stream(spark, tmp_path):
    x, labels = blobs(3, 40)
    table(spark, x, 6).write.parquet(f"{tmp_path}/in")
    model = partitions.MiniBatches(x[[0, 50, 100]].copy(), batch=10)
    stream = spark.readStream.schema("k long, v array<double>").option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/in")
    stream.writeStream.foreachBatch(lambda df, _: model.update(df)).option("checkpointLocation", f"{tmp_path}/at").trigger(availableNow=True).start().awaitTermination()
    assert model.counts.sum() == len(x)
    assert np.allclose(model.centres, [x[labels == c].mean(axis=0) for c in range(3)], atol=0.2)


def test_mini_batch_kmeans_finds_groups(spark):
    x, labels = blobs(3, 40)
    for seed in range(20):  # a start with a row of each group
        first = partitions._first_rows(partitions._rows(table(spark, x), "k", "v"), 3, seed)
        if len({int(np.linalg.norm(x - f, axis=1).argmin()) // 40 for f in first}) == 3:
            break
    assert same_parts(partitions.mini_batch_kmeans(table(spark, x), "k", "v", 3, 20, 2, seed).collect(), labels)


@pytest.mark.parametrize("least, most, listed", [(2, 5, 50), (4, 4, 1), (0, 6, 2), (3, 12, 1)])
def test_bounded_sizes_cost_what_brute_force_finds(spark, least, most, listed):
    rng = np.random.default_rng(least * 10 + most)
    x, centres = rng.normal(size=(12, 2)), rng.normal(size=(3, 2)) * 0.5 + np.array([0.8, 0.0])
    cost = ((x[:, None, :] - centres[None]) ** 2).sum(axis=2)
    best = min(sum(cost[i, b] for i, b in enumerate(p)) for p in itertools.product(range(3), repeat=12) if all(least <= p.count(b) <= most for b in range(3)))
    rows = table(spark, x, 2)
    got = {r["k"]: r["bin"] for r in partitions.assign_within(rows, centres, least, most, listed).collect()}
    sizes = [list(got.values()).count(b) for b in range(3)]
    assert all(least <= s <= most for s in sizes)
    assert sum(cost[i, b] for i, b in got.items()) == pytest.approx(best)


def test_constrained_kmeans(spark):
    x, _ = blobs(3, 10)
    got = [r["bin"] for r in partitions.constrained_kmeans(table(spark, x), "k", "v", 4, 5, 8, iterations=3).collect()]
    assert len(got) == 30 and all(5 <= got.count(b) <= 8 for b in range(4))
    with pytest.raises(ValueError):
        partitions.assign_within(table(spark, x), x[:2], 0, 10)
