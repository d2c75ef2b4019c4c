"""The micro assembly of FIXTURES.md through readers and operators, and edge cases of the readers."""

import pytest

from binloom import functions as G
from binloom.operators import features, graph, metrics, stats
from binloom.sources import readers, sinks

CONTIGS = [(0, "edge_1", 1200), (1, "edge_2", 3000), (2, "edge_3", 1500), (3, "edge_4", 800), (4, "edge_5", 2500), (5, "edge_6", 2000)]
GOLD = {"edge_1": "A", "edge_2": "A", "edge_3": "B", "edge_4": "NA", "edge_5": "C", "edge_6": "C"}
BIN_X = {"edge_1": "b0", "edge_2": "b0", "edge_3": "b1", "edge_4": "b1", "edge_5": "b2", "edge_6": "b2"}
BIN_Y = {"edge_1": "b0", "edge_2": "b1", "edge_3": "b0", "edge_5": "b2", "edge_6": "b2"}
MARKERS = [("edge_1", "G1", 1), ("edge_1", "G2", 1), ("edge_2", "G1", 1), ("edge_2", "G3", 1), ("edge_3", "G3", 2), ("edge_5", "G2", 1), ("edge_5", "G4", 1), ("edge_6", "G1", 1), ("edge_6", "GX", 1)]
SETS = [(0, "G1"), (0, "G2"), (1, "G3"), (2, "G4")]
LINKS = [("edge_1", "edge_2", 10), ("edge_2", "edge_3", 4), ("edge_3", "edge_3", 2), ("edge_3", "edge_4", 7), ("edge_5", "edge_6", 5)]


@pytest.fixture(scope="module")
def t(spark):
    make = spark.createDataFrame
    return {
        "contigs": make(CONTIGS, "idx long, name string, length long"),
        "gold": make(list(GOLD.items()), "name string, genome string"),
        "x": make(list(BIN_X.items()), "name string, bin string"),
        "y": make(list(BIN_Y.items()), "name string, bin string"),
        "markers": make(MARKERS, "name string, gene string, copies int"),
        "sets": make(SETS, "set_id int, gene string"),
        "links": make(LINKS, "src string, dst string, weight long"),
    }


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_edges_and_pairs(t):
    edges = graph.link_edges(t["links"], t["contigs"], 1000)
    assert rows(edges) == [(0, 1, 10), (1, 0, 10), (1, 2, 4), (2, 1, 4), (2, 2, 2), (4, 5, 5), (5, 4, 5)]
    labels = t["contigs"].join(t["gold"], "name").where("genome <> 'NA'")
    assert graph.homophily(edges, labels, "idx", "genome").first()["share"] == pytest.approx(5 / 7)
    marked = t["markers"].join(t["contigs"], "name")
    assert rows(graph.must_differ_pairs(marked, "idx", "gene")) == [(0, 1), (0, 4), (0, 5), (1, 2), (1, 5)]
    assert rows(graph.same_marker_edges(edges, marked, "idx", "gene")) == [(0, 1, 1), (1, 0, 1), (1, 2, 1), (2, 1, 1)]
    got = {(r[0], r[1]): r[2] for r in graph.weighted_adjacency(edges).collect()}
    assert got[0, 0] == 1.0 and got[0, 1] == pytest.approx(0.778499, abs=1e-6) and got[1, 2] == pytest.approx(0.184752, abs=1e-6) and got[4, 5] == pytest.approx(0.416667, abs=1e-6)


def test_markers(t):
    scores = metrics.marker_scores(metrics.gene_totals(t["markers"], t["x"], "name"), t["sets"])
    got = {r["bin"]: (round(r["comp"], 4), round(r["cont"], 4)) for r in scores.collect()}
    assert got == {"b0": (66.6667, 16.6667), "b1": (33.3333, 33.3333), "b2": (66.6667, 0.0)}
    left = metrics.unresolved(t["x"], t["markers"], scores, t["sets"], "name").first()
    assert tuple(left) == (6, 5, 1)
    estimate = stats.genome_count_estimate(t["sets"], t["markers"], "gene", "copies").first()
    assert (estimate["p75"], estimate["k_max"]) == (3, 3)


def test_amber(t):
    gold = t["gold"].where("genome <> 'NA'").join(t["contigs"], "name")
    table = metrics.confusion(t["y"].join(gold, "name"), "bin", "genome", "length")
    s = metrics.summary(metrics.bin_precision(table), metrics.genome_recall(table, gold, "genome", "length")).first()
    want = {"precision_avg_bp": 0.851852, "precision_sem_bp": 0.148148, "precision_var_bp": 0.065844, "precision_avg_seq": 0.833333, "precision_weighted_bp": 0.882353, "recall_avg_bp": 0.904762, "recall_sem_bp": 0.095238, "recall_var_bp": 0.027211, "recall_avg_seq": 0.833333, "accuracy_bp": 0.882353, "accuracy_seq": 0.8, "f1_avg_bp": 0.877510}
    for name, value in want.items():
        assert s[name] == pytest.approx(value, abs=1e-6), name
    x = t["x"].join(t["gold"], "name")
    got = metrics.count_prf(x, "bin", "genome").first()
    assert (got["precision"], got["recall"], got["f1"]) == pytest.approx((0.833333, 1.0, 0.909091), abs=1e-6)


def test_n50_and_depths(t, spark):
    assert stats.n50(t["contigs"], "length").first()["n50"] == 2500
    d = spark.createDataFrame([("a", 0, 4.0), ("a", 1, 1.0), ("b", 0, 0.0), ("b", 1, 0.0)], "name string, sample int, depth double")
    got = {(r["name"], r["sample"]): round(r["share"], 6) for r in features.normalise_rows(d, "name", "depth", "share").collect()}
    assert got == {("a", 0): 0.8, ("a", 1): 0.2, ("b", 0): 0.0, ("b", 1): 0.0}


def test_kmers_of_short_and_odd_sequences(spark):
    s = spark.createDataFrame([(1, "ACGTA"), (2, "ACG"), (3, "NNNNNN"), (4, "acgtacgt"), (5, None), (6, "")], "id long, seq string")
    assert rows(features.kmer_counts(s, "id", "seq")) == [(1, "ACGT", 1), (1, "CGTA", 1)]
    freq = features.kmer_frequencies(s, "id", "seq")
    assert freq.count() == 256 and freq.agg({"freq": "sum"}).first()[0] == pytest.approx(0, abs=1e-9)
    assert rows(features.kmer_counts(s, "id", "seq", canonical=True)) == [(1, "ACGT", 1), (1, "CGTA", 1)]


def test_files(spark, tmp_path, t):
    (tmp_path / "a.fasta").write_text(">edge_1_x_y extra words\nACGT\nAC\n>edge_2\nGGG\n>edge_3\n")
    got = rows(readers.read_fasta(spark, str(tmp_path / "a.fasta")))
    assert got == [(0, "edge_1", "ACGTAC", 6), (1, "edge_2", "GGG", 3), (2, "edge_3", "", 0)]
    (tmp_path / "g.gfa").write_text("H\tVN\nS\tedge_1\tACG\nL\tedge_1\t+\tedge_2\t-\t0M\tRC:i:12\nL\tedge_2\t+\tedge_2\t+\t0M\nP\tc1\tedge_1+,edge_2-\t*\n")
    assert [r["weight"] for r in readers.read_gfa_links(spark, str(tmp_path / "g.gfa")).orderBy("ord").collect()] == [12, 1]
    assert rows(readers.read_gfa_paths(spark, str(tmp_path / "g.gfa"))) == [("c1", 0, "edge_1"), ("c1", 1, "edge_2")]
    assert [r["name"] for r in readers.read_gfa_segments(spark, str(tmp_path / "g.gfa")).collect()] == ["edge_1"]
    (tmp_path / "d.txt").write_text("contigName\tcontigLen\ttotalAvgDepth\ts1\ts1-var\ts2\nedge_1\t1200\t5\t4\t0\t1\n")
    depths = readers.read_depths(spark, str(tmp_path / "d.txt"))
    assert rows(depths) == [("edge_1", 0, 4.0), ("edge_1", 1, 1.0)]
    assert readers.align_depths(t["contigs"], depths, 2).where("depth = 0").count() == 10
    (tmp_path / "m.tsv").write_text("edge_1\t{'o1': {'G1': [[1, 2]]}, 'o2': {'G1': [], 'G2': []}}\nedge_2\t{}\n")
    assert rows(readers.read_marker_stats(spark, str(tmp_path / "m.tsv"))) == [("edge_1", "G1", 2), ("edge_1", "G2", 1)]
    (tmp_path / "s.ms").write_text("# header\nx\t1\t[set(['G1', 'G2']), set(['G3'])]\n")
    assert rows(readers.read_marker_sets(spark, str(tmp_path / "s.ms"))) == [(0, "G1"), (0, "G2"), (1, "G3")]
    (tmp_path / "l.csv").write_text("edge_1,A\nedge_1,B\n")
    assert rows(readers.read_labels(spark, str(tmp_path / "l.csv"), t["contigs"]))[:2] == [("edge_1", "B"), ("edge_2", "NA")]
    (tmp_path / "e.tsv").write_text("edge_1 0.5 1\n")
    emb = {r["name"]: r["emb"] for r in readers.read_embeddings(spark, str(tmp_path / "e.tsv"), t["contigs"]).collect()}
    assert emb["edge_1"] == [0.5, 1.0] and len(emb["edge_2"]) == 2 and all(1e-4 <= x < 1 for x in emb["edge_2"])
    (tmp_path / "info.txt").write_text("#seq_name\tlength\tcov.\tcirc.\trepeat\tmult.\talt\tpath\nc1\t200000\t5\tY\tN\t2\t*\t1,-2,*\n")
    assert rows(readers.read_assembly_info(spark, str(tmp_path / "info.txt"))) == [("c1", 200000, True, False, 2, ["edge_1", "edge_2"])]


def test_bins_round_trip(spark, tmp_path, t):
    sinks.write_contig2bin(t["x"], str(tmp_path / "bins"))
    assert rows(readers.read_bins(spark, str(tmp_path / "bins")).select("name", "bin")) == sorted(BIN_X.items())
    kept = sinks.bins_with_leftovers(t["y"], t["contigs"], 2600)
    assert {r["bin"] for r in kept.collect()} == {"b0", "b1", "b2"}
    alone = sinks.bins_with_leftovers(t["y"].where("bin = 'b1'"), t["contigs"], 2200)
    assert rows(alone) == [("edge_2", "b1"), ("edge_5", "1")]


def test_scalar_functions(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(" a_b_c d", [1.0, 0.0], [0.0, 0.0])], "n string, v array<double>, z array<double>")
    got = df.select(G.contig_name(F.col("n")), G.cosine(F.col("v"), F.col("z")), G.medoid_distance(G.medoid_normalise(F.col("v")), G.medoid_normalise(F.col("v"))), G.f1(F.lit(0.0), F.lit(1.0)), G.reverse_complement(F.lit("AACG"))).first()
    assert got[0] == "a_b" and got[1] is None and got[2] == pytest.approx(0) and got[3] == 0 and got[4] == "CGTT"


def test_components_and_empty_tables(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (7, 8), (9, 9)], "src long, dst long")
    assert rows(graph.components(e)) == [(1, 1), (2, 1), (3, 1), (7, 7), (8, 7), (9, 9)]
    assert graph.components(e.limit(0)).count() == 0


def test_components_of_names_and_of_a_long_path(spark):
    named = spark.createDataFrame([("b", "a"), ("c", "b"), ("x", "y"), ("z", "z")], "src string, dst string")
    assert rows(graph.components(named)) == [("a", "a"), ("b", "a"), ("c", "a"), ("x", "x"), ("y", "x"), ("z", "z")]
    path = spark.range(40).selectExpr("id as src", "id + 1 as dst")
    assert {r["component"] for r in graph.components(path).collect()} == {0}
    assert graph.components(named.limit(0)).count() == 0
    with pytest.raises(RuntimeError):
        graph.components(path, rounds=1)


def test_graph_filters(t):
    links, contigs = t["links"], t["contigs"]
    assert rows(graph.undirected_edges(links, contigs)) == [("edge_1", "edge_2"), ("edge_2", "edge_3"), ("edge_3", "edge_3"), ("edge_5", "edge_6")]
    assert len(rows(graph.undirected_edges(links, contigs, 1000, "root"))) == 9
    assert [r[2] for r in rows(graph.edges_over(links, -1))] == [10, 7]  # the mean is 5.6
    assert [r[2] for r in rows(graph.edges_over(links, 5))] == [10, 7, 5]
    gone = contigs.where("name = 'edge_3'")
    assert rows(graph.without_nodes(links, gone, "name")) == [("edge_1", "edge_2", 10), ("edge_5", "edge_6", 5)]
    one = tuple(graph.density(links).first())
    assert one[:2] == (6, 4) and one[2] == pytest.approx(8 / 30)


def test_negative_edges_are_even_and_repeatable(spark):
    edges, nodes = spark.range(3000).selectExpr("id as src", "id + 1 as dst"), spark.range(10).withColumnRenamed("id", "n")
    first = rows(graph.negative_edges(edges, nodes, "n", 2, 7))
    assert first == rows(graph.negative_edges(edges.repartition(7), nodes, "n", 2, 7)) and len(first) == 6000
    per = [sum(r[1] == k for r in first) for k in range(10)]
    assert min(per) > 480 and max(per) < 720


def test_losses_by_hand(spark):
    from math import exp, log

    from binloom.operators import models

    nodes = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 5.0]), (4, [0.0, 0.0])], "n int, v array<double>")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (1, 4)], "src int, dst int")
    assert [r["cosine"] for r in models.pair_cosines(pairs, nodes, "n", "v").orderBy("dst").collect()] == [1.0, 0.0, 0.0]
    got = models.edge_loss(pairs.where("dst = 2"), pairs.where("dst = 3"), nodes, "n", "v").first()
    assert got["loss"] == pytest.approx((log(1 + exp(1)) - 1 + log(2)) / 2)
    assert models.marker_loss(pairs.limit(0), nodes, "n", "v").first()["loss"] == pytest.approx(log(1 + exp(1)) - 1)
    x = spark.createDataFrame([([0.5, 1.0], [0.25, 3.0], [0.0], [9.0])], "x array<double>, y array<double>, mu array<double>, lv array<double>")
    one = models.autoencoder_loss(x, "x", "y", "mu", "lv", 1).first()
    assert tuple(one)[:3] == pytest.approx((0.85 * 0.0625, 0.15 * 4, -0.5 * (1 + 2 - exp(2)) / 200))
