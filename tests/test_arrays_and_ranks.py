"""Matrix and pickle files, caches, exact quantiles, numbering, stretches and sampled levels on small made-up data."""

import os
import pickle

import numpy as np
import pytest
from pyspark.sql import functions as F

from binloom.operators import graph, stats
from binloom.sources import arrays, readers, sinks, store


@pytest.mark.parametrize("shape, dtype", [((50, 7), np.float32), ((33,), np.int64), ((0, 4), np.float64), ((5, 3), ">f8")])
def test_matrices_round_trip(spark, tmp_path, shape, dtype, monkeypatch):
    monkeypatch.setattr(arrays, "PIECE_BYTES", 64)
    x = (np.random.default_rng(1).random(shape) * 100).astype(dtype)
    np.save(tmp_path / "a.npy", x)
    np.savez(tmp_path / "a.npz", x, other=x[:0])
    np.savez_compressed(tmp_path / "b.npz", arr_0=x)
    want = [np.atleast_1d(v).astype(float).tolist() for v in x]
    for path in ("a.npy", "a.npz", "b.npz"):
        for prefix in ("", "file://"):
            df = arrays.read_matrix(spark, f"{prefix}{tmp_path}/{path}", range_bytes=100)
            rows = df.orderBy("idx").collect()
            assert [r["row"] for r in rows] == want and [r["idx"] for r in rows] == list(range(len(x)))
    assert len(x) == 0 or arrays.read_matrix(spark, f"{tmp_path}/a.npy", range_bytes=100).rdd.getNumPartitions() > 1


def test_matrices_that_are_refused(spark, tmp_path):
    np.save(tmp_path / "f.npy", np.asfortranarray(np.ones((3, 2))))
    np.save(tmp_path / "o.npy", np.array([{}], object), allow_pickle=True)
    (tmp_path / "x.npy").write_bytes(b"no matrix at all")
    for name in ("f", "o", "x"):
        with pytest.raises(ValueError):
            arrays.read_matrix(spark, f"{tmp_path}/{name}.npy")


def test_depths_of_a_matrix(spark, tmp_path):
    np.savez(tmp_path / "d.npz", np.array([[1.5, 2.0], [3.0, 4.5]]))
    contigs = spark.createDataFrame([(0, "a"), (1, "b")], "idx long, name string")
    assert sorted(map(tuple, readers.read_depths_npz(spark, f"{tmp_path}/d.npz", contigs).collect())) == [("a", 0, 1.5), ("a", 1, 2.0), ("b", 0, 3.0), ("b", 1, 4.5)]


class Evil:
    def __reduce__(self):
        return os.getcwd, ()


def test_pickles_hold_plain_vectors_only(spark, tmp_path):
    (tmp_path / "e.pickle").write_bytes(pickle.dumps({"a": np.array([1.0, 2.0], np.float32), "b": [3.0, 4.0], "c": np.float64(5.0)}))
    got = {r["name"]: r["emb"] for r in readers.read_embeddings(spark, f"{tmp_path}/e.pickle").collect()}
    assert got == {"a": [1.0, 2.0], "b": [3.0, 4.0], "c": [5.0]}
    filled = readers.read_embeddings(spark, f"{tmp_path}/e.pickle", spark.createDataFrame([("a",), ("z",)], "name string")).collect()
    assert {r["name"] for r in filled} == {"a", "z"}
    for bad in ({"a": Evil()}, [1, 2]):
        (tmp_path / "bad.pickle").write_bytes(pickle.dumps(bad))
        with pytest.raises(Exception, match="not read from a pickle|no dict"):
            arrays.read_pickled_vectors(spark, f"{tmp_path}/bad.pickle").collect()


def test_a_dataset_is_made_once(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return {"a": spark.range(3), "b": spark.range(2), "unwanted": spark.range(9)}

    for _ in range(2):
        tables = store.cached_dataset(spark, f"{tmp_path}/c", make, ["a", "b"])
        assert [tables[n].count() for n in ("a", "b")] == [3, 2]
    assert made == [1] and store.has_tables(spark, f"{tmp_path}/c", ["a"]) and not store.has_tables(spark, f"{tmp_path}/c", ["a", "unwanted"])


@pytest.mark.parametrize("share", [0.0, 0.1, 0.5, 0.75, 0.9, 1.0])
def test_quantiles_are_exact(spark, share, monkeypatch):
    monkeypatch.setattr(stats, "BUCKETS", 4)
    rng = np.random.default_rng(3)
    for x in (rng.lognormal(0, 3, 500), rng.integers(0, 4, 97).astype(float), np.array([7.0]), np.array([1e300, -1e300, 0.0, 5.0])):
        df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double")
        assert stats.exact_quantile(df, "x", share) == pytest.approx(float(np.quantile(x, share)), rel=1e-12)
    assert stats.exact_quantile(spark.createDataFrame([(None,)], "x double"), "x", share) is None


def test_ranks_over_ranges(spark):
    names = [f"n{i * 7919 % 1000:04d}" for i in range(1000)]
    got = {r["name"]: r["place"] for r in stats.ranked(spark.createDataFrame([(n,) for n in names], "name string").repartition(7), "name", "place").collect()}
    assert got == {n: i for i, n in enumerate(sorted(names))}


def test_components_with_a_name(spark, tmp_path):
    parts = spark.createDataFrame([("edge_1", 1), ("read_1", 1), ("edge_2", 2)], "node string, component int")
    sinks.write_components(parts, f"{tmp_path}/c", containing="edge")
    assert [r["value"] for r in spark.read.text(f"{tmp_path}/c").collect()] == ["edge_1\t1"]


def test_points_meet_their_stretch_whatever_the_lengths(spark):
    """A key with many stretches, one of them nearly all, and short keys."""
    sizes = {"hub": [1] * 50 + [100_000] + [3] * 50, "one": [5], "two": [1, 1]}
    stretches, points, want = [], [], []
    for key, all_ in sizes.items():
        ends = np.cumsum(all_)
        stretches += [(key, int(e - s), int(e), i) for i, (e, s) in enumerate(zip(ends, all_))]
        for p in {0, 1, int(ends[-1]) - 1, *np.random.default_rng(2).integers(0, ends[-1], 40).tolist()}:
            points.append((key, int(p)))
            want.append((key, int(np.searchsorted(ends, p, "right"))))
    a, b = spark.createDataFrame(points, "key string, point long"), spark.createDataFrame(stretches, "key string, `from` long, `to` long, i int")
    for share in (1, 16, 1000):
        assert sorted(tuple(r) for r in graph.met_stretches(a, b, ["key"], share).select("key", "i").collect()) == sorted(want)


def test_inverse_weight_prefers_weak_links(spark):
    edges = spark.createDataFrame([(1, 2, 1.0), (1, 3, 4.0), (1, 4, 20.0), (2, 1, 1.0)], "src long, dst long, weight double")
    got = graph.inverse_weight_negatives(edges, 3000, 5).groupBy("src", "dst").count().collect()
    n = {(r["src"], r["dst"]): r["count"] / 9000 for r in got}
    assert n[2, 1] == pytest.approx(1 / 3)
    for dst, share in ((2, 1 / 1.3), (3, 0.25 / 1.3), (4, 0.05 / 1.3)):
        assert n[1, dst] == pytest.approx(share, abs=0.02)


def test_levels_reach_out_from_the_seeds(spark):
    edges = spark.range(40).select(F.col("id").alias("src"), F.explode(F.sequence(F.col("id") + 1, F.col("id") + 4)).alias("dst"), F.lit(1.0).alias("weight"))
    rows = graph.sample_levels(edges, spark.range(2).withColumnRenamed("id", "n"), "n", [2, 3], 1).collect()
    zero, one = ([(r["src"], r["dst"]) for r in rows if r["level"] == k] for k in (0, 1))
    assert len(zero) == 4 and {s for s, _ in zero} == {0, 1}
    assert {s for s, _ in one} == {0, 1} | {d for _, d in zero} and len(one) == 3 * len({s for s, _ in one})
    assert all(1 <= d - s <= 4 for s, d in zero + one)
