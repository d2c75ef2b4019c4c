"""Operators that SQL does not reach, or that take other inputs than the queries give them."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from binloom import functions as G
from binloom.operators import cluster, features, graph, similarity
from binloom.plans import queries as plans
from binloom.sources import readers, store

SF = "/root/testdata/sf0.001"


def test_kmers_of_a_long_sequence_in_pieces(spark):
    r = np.random.default_rng(0)
    seqs = [(k, "".join(r.choice(list("ACGTNacgt"), n))) for k, n in enumerate((0, 3, 4, 40, 5000))] + [(9, None)]
    df = spark.createDataFrame(seqs, "k int, s string")
    want = Counter((k, s[i : i + 4]) for k, s in seqs if s for i in range(len(s) - 3) if set(s[i : i + 4]) <= set("ACGT"))
    for step in (1 << 16, 7, 64):
        assert {(r["k"], r["kmer"]): r["n"] for r in features.kmer_counts(df, "k", "s", step=step).collect()} == want
    one = df.where("k = 4").select(F.size(G.kmers(F.col("s"), 4))).first()[0]
    assert one == sum(n for (k, _), n in want.items() if k == 4)


@pytest.mark.parametrize("block", [1024, 7])
def test_block_products_are_those_of_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(similarity, "BLOCK_ROWS", block)
    r = np.random.default_rng(1)
    x = np.round(r.normal(size=(40, 5)), 1)
    x[3], x[7] = 0.0, x[8]
    df = spark.createDataFrame([(i, row.tolist(), int(i % 3)) for i, row in enumerate(x)], "id long, v array<double>, label int")
    n = np.where((x.sum(axis=1) == 0)[:, None], 0.2, x)
    n /= np.linalg.norm(n, axis=1, keepdims=True)
    cos = n @ n.T
    pairs = [(i, j) for i in range(40) for j in range(i + 1, 40)]
    got = {(r["i"], r["j"]): r["distance"] for r in cluster.pair_distances(df, "id", "v").collect()}
    assert set(got) == set(pairs) and all(got[i, j] == pytest.approx(0.5 - cos[i, j] / 2) for i, j in pairs)
    near = {(r["i"], r["j"]) for r in cluster.pair_distances(df, "id", "v", 0.3).collect()}
    assert near == {p for p in pairs if got[p] <= 0.3}
    means = {r["same"]: (r["pairs"], r["mean"]) for r in cluster.label_cosines(df, "id", "v", "label").collect()}
    for same in (True, False):
        of = [cos[i, j] for i, j in pairs if (i % 3 == j % 3) == same]
        assert means[same] == (len(of), pytest.approx(np.mean(of)))
    top = {(r["i"], r["rank"]): r["j"] for r in cluster.top_neighbours(df, "id", "v", 4).collect()}
    score = np.round(x @ x.T, 6)
    assert top == {(i, k + 1): j for i in range(40) for k, j in enumerate(sorted(range(40), key=lambda j: (-score[i, j], j))[:4])}
    assert cluster.pair_distances(df.limit(0), "id", "v").count() == 0


def test_medoid_clusters_leave_a_seed_without_valley_for_later():
    """Tight groups are cut at their valley; points spread between all angles wait until the ratio has risen."""
    r = np.random.default_rng(2)
    centres = np.linalg.qr(r.normal(size=(6, 6)))[0]
    tight = np.concatenate([c + r.normal(scale=0.02, size=(80, 6)) for c in centres[:4]])
    loose = r.normal(size=(150, 6))
    x = np.concatenate([loose, tight])
    x /= np.linalg.norm(x, axis=1, keepdims=True) * np.sqrt(2)
    out = cluster.medoid_kernel(np.arange(len(x)), x)
    assert sorted(k for k, *_ in out) == list(range(len(x)))  # a partition
    group = {k: c for k, c, _, _ in out}
    medoid = {c: (m, cut) for _, c, m, cut in out}
    assert all(0.5 - x[k] @ x[medoid[c][0]] <= medoid[c][1] + 1e-12 or k == medoid[c][0] for k, c in group.items())
    for g in range(4):
        most = Counter(group[150 + 80 * g + k] for k in range(80)).most_common(1)[0][1]
        assert most >= 70
    assert out == cluster.medoid_kernel(np.arange(len(x)), x)
    cuts = [cut for _, cut in medoid.values()]
    assert 0.06 in cuts  # the last ones, after the ratio is over 0.55
    pdf = np.exp(-0.5 * (np.linspace(-0.075, 0.075, 31) / 0.01) ** 2)
    even = np.linspace(0.001, 0.299, 500)
    assert cluster._valley(np.append(even, 0.0), 0.1, pdf / pdf.sum()) is None  # no peak that falls off
    assert cluster._valley(np.array([0.0, 0.2]), 0.1, pdf / pdf.sum()) == 0.025  # alone
    two = np.concatenate([[0.0], r.normal(0.03, 0.005, 300).clip(0.001), r.normal(0.25, 0.01, 300)])
    assert 0.05 < cluster._valley(two, 0.1, pdf / pdf.sum()) <= 0.2


def test_medoid_bins_refuse_too_many_rows(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "k long, v array<double>")
    with pytest.raises(ValueError):
        cluster.medoid_bins(df, "k", "v", most=1)


def test_weighted_negatives_follow_in_degree(spark):
    rows = [(i, d, 1) for d, n in ((1, 16), (2, 81), (3, 1)) for i in range(100, 100 + n)]
    edges = spark.createDataFrame(rows, "src long, dst long, weight long")
    for groups in (1, 1024):
        got = graph.weighted_negatives(edges, 40, 3, groups=groups).groupBy("dst").count().collect()
        n = {r["dst"]: r["count"] for r in got}
        total, weight = sum(n.values()), {1: 8.0, 2: 27.0, 3: 1.0}
        assert total == 40 * len(rows) and all(abs(n[d] / total - w / 36) < 0.03 for d, w in weight.items())


def test_paths_fall_back_to_assembly_info(spark):
    none = spark.createDataFrame([], "path string, pos int, segment string")
    some = spark.createDataFrame([("c1", 0, "edge_5")], "path string, pos int, segment string")
    info = spark.createDataFrame([("c1", ["edge_1", "edge_2"]), ("c2", []), ("c3", ["edge_2"])], "name string, path array<string>")
    assert sorted(map(tuple, readers.paths_or_fallback(none, info).collect())) == [("c1", 0, "edge_1"), ("c1", 1, "edge_2"), ("c3", 0, "edge_2")]
    assert [tuple(r) for r in readers.paths_or_fallback(some, info).collect()] == [("c1", 0, "edge_5")]


def test_averaged_heads(spark):
    edges = spark.createDataFrame([(1, 2, 1.0), (1, 3, 1.0), (2, 1, 1.0)], "src long, dst long, weight double")
    nodes = spark.createDataFrame([(1, 0.0, 0.0, 5.0), (2, 0.0, 0.0, 1.0), (3, 0.0, 0.0, 3.0)], "n long, l double, r double, x double")
    heads = [("l", "r", "x"), ("l", "r", "x")]
    assert {r["src"]: r["out"] for r in graph.attention_layer(edges, nodes, "n", heads, average=True).collect()} == {1: 2.0, 2: 5.0}
    assert {r["src"]: list(r["out"]) for r in graph.attention_layer(edges, nodes, "n", heads).collect()} == {1: [2.0, 2.0], 2: [5.0, 5.0]}


def test_no_machine_local_folder_on_a_cluster():
    class Context:
        master = "spark://somewhere:7077"
        getCheckpointDir = staticmethod(lambda: None)
        getConf = staticmethod(dict)

    class Frame:
        class sparkSession:  # noqa: N801
            sparkContext = Context

    with pytest.raises(RuntimeError):
        store.durable(Frame)


def test_leftover_and_unrecovered_rows_are_there(spark):
    parts = spark.read.parquet(f"{SF}/part.parquet")
    rows = plans.QUERIES["leftover_bins"](spark, SF).collect()
    alone = {r["name"] for r in rows if "/" not in r["bin"]}
    assert alone and len(rows) > len(alone) and alone <= {str(r["p_partkey"]) for r in parts.where("p_size > 40").collect()}
    assert [r["recall_bp"] for r in plans.QUERIES["amber_unrecovered"](spark, SF).where("genome = 'Brand#13'").collect()] == [0.0]
