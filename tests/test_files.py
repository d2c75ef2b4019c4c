"""Readers and writers on small files written here."""

import numpy as np
import pytest

from binloom.sources import readers, sinks, store


def text(folder, name, *lines):
    path = folder / name
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def lines_of(spark, path):
    return [r["value"] for r in spark.read.text(path).collect()]


@pytest.fixture
def contigs(spark):
    rows = [(0, "edge_1", 1200, "ACGT"), (1, "edge_2", 3000, "GGGG"), (2, "edge_3", 500, "TTTT")]
    return spark.createDataFrame(rows, "idx long, name string, length long, seq string")


def test_depths_of_a_matrix(spark, tmp_path, contigs):
    np.savez(tmp_path / "depth.npz", np.array([[1.0, 2.0], [3.0, 4.5], [0.0, 6.0]]))
    got = sorted(map(tuple, readers.read_depths_npz(spark, str(tmp_path / "depth.npz"), contigs).collect()))
    assert got == [("edge_1", 0, 1.0), ("edge_1", 1, 2.0), ("edge_2", 0, 3.0), ("edge_2", 1, 4.5), ("edge_3", 0, 0.0), ("edge_3", 1, 6.0)]


def test_labels_of_a_tsv(spark, tmp_path, contigs):
    path = text(tmp_path, "labels.tsv", "@Version:0.9", "#comment", "edge_1\tA\t1200", "edge_2\tB\t3000", "edge_1\tC\t1200")
    got = dict(map(tuple, readers.read_labels(spark, path, contigs).select("name", "label").collect()))
    assert got == {"edge_1": "C", "edge_2": "B", "edge_3": "NA"}


def test_gtdb_tables(spark, tmp_path):
    path = text(tmp_path, "summary.tsv", "user_genome\tclassification", "edge_1_x_y\td__B;g__G;s__G one", "edge_2\tUnclassified Bacteria", "edge_3\td__B;s__")
    assert [tuple(r) for r in readers.read_gtdb_labels(spark, path).collect()] == [("edge_1", "s__G one")]
    path = text(tmp_path, "markers.tsv", "name\tunique\tm\tu\tmissing\tgenes\tgone", "edge_1\t2\t0\t0\t1\tG1,G2\tG3", "edge_2\t1\t0\t0\t2\tG2\tG1,G3")
    found, genes = readers.read_gtdb_markers(spark, path)
    assert sorted(map(tuple, found.collect())) == [("edge_1", "G1", 1), ("edge_1", "G2", 1), ("edge_2", "G2", 1)]
    assert sorted(r["gene"] for r in genes.collect()) == ["G1", "G2", "G3"]


def test_bins_with_and_without_the_comment_come_back(spark, tmp_path):
    bins = spark.createDataFrame([("edge_2", "1"), ("edge_1", "0")], "name string, bin string")
    head = ["@Version:0.9.0", "@SampleID:S", "@@SEQUENCEID\tBINID"]
    for extra in (False, True):
        path = str(tmp_path / f"bins{extra}")
        sinks.write_contig2bin(bins, path, "S", extra)
        assert lines_of(spark, path) == ["#CLUSTERING"] * extra + head + ["edge_1\t0", "edge_2\t1"]
        assert sorted((r["name"], r["bin"]) for r in readers.read_bins(spark, path).collect()) == [("edge_1", "0"), ("edge_2", "1")]


def test_features_come_back(spark, tmp_path):
    df = spark.createDataFrame([("edge_1", [1.5, -2.0]), ("edge_2", [0.0, 3.25])], "name string, emb array<double>")
    sinks.write_features(df, str(tmp_path / "emb"))
    assert sorted(map(tuple, readers.read_embeddings(spark, str(tmp_path / "emb")).collect())) == [("edge_1", [1.5, -2.0]), ("edge_2", [0.0, 3.25])]


def test_edges_components_and_scores(spark, tmp_path):
    edges = spark.createDataFrame([(1, 2, 3), (2, 1, 3)], "src long, dst long, weight long")
    sinks.write_edges(edges, str(tmp_path / "edges"))
    assert sorted(lines_of(spark, str(tmp_path / "edges"))) == ["1\t2\t3", "2\t1\t3"]
    comps = spark.createDataFrame([("a", "a"), ("b", "a"), ("c", "c")], "node string, component string")
    sinks.write_components(comps, str(tmp_path / "comps"))
    assert sorted(lines_of(spark, str(tmp_path / "comps"))) == ["a\ta", "b\ta"]
    scores = spark.createDataFrame([(0, 1.0)], "bin int, comp double")
    for _ in range(2):
        sinks.append_scores(scores, str(tmp_path / "scores"))
    assert spark.read.parquet(str(tmp_path / "scores")).count() == 2


def test_a_dataset_comes_back(spark, tmp_path, contigs):
    store.save_dataset({"contigs": contigs}, str(tmp_path))
    assert sorted(map(tuple, store.load_table(spark, str(tmp_path), "contigs").collect())) == sorted(map(tuple, contigs.collect()))
