"""Scoring of bins from files, and the command line over it and over binning."""

import pytest

from binloom.plans import cli
from binloom.plans.scoring import score_bins


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    d = tmp_path_factory.mktemp("score")
    genes = {"c1": "G0 G1", "c2": "G2", "c3": "G0 G1 G2", "c4": "G0", "c5": ""}
    (d / "m.tsv").write_text("".join(f"{c}\t{ {f'{c}_{i}': {g: [[1, 2]]} for i, g in enumerate(gs.split())} }\n" for c, gs in genes.items()))
    (d / "b.ms").write_text("# marker sets\nx\ty\t[{'G0'}, {'G1'}, {'G2'}]\n")
    head = "@Version:0.9.0\n@SampleID:S\n@@SEQUENCEID\tBINID\n"
    (d / "bins.tsv").write_text(head + "c1\tA\nc2\tA\nc3\tB\nc4\tB\nc5\tC\n")
    (d / "gold.tsv").write_text("@Version:0.9.0\n@SampleID:S\n@@SEQUENCEID\tBINID\tLENGTH\n" + "c1\tg1\t100\nc2\tg1\t300\nc3\tg2\t500\nc4\tg1\t50\nc6\tg3\t70\n")
    return d


def test_given_bins_against_a_gold_standard(spark, files):
    got = score_bins(spark, f"{files}/m.tsv", f"{files}/b.ms", f"{files}/bins.tsv", f"{files}/gold.tsv")
    assert sorted(map(tuple, got.bins.collect())) == [("A", pytest.approx(100), 0.0), ("B", pytest.approx(100), pytest.approx(100 / 3))]
    counts = got.counts.first()
    assert (counts["bins"], counts["hq"], counts["mq"], counts["contigs"], counts["with_markers"], counts["genomes"]) == (2, 1, 1, 3, 2, 0)
    summary = got.summary.first()
    assert summary["precision_avg_bp"] == pytest.approx((1 + 500 / 550) / 2)
    assert summary["recall_avg_bp"] == pytest.approx((400 / 450 + 1 + 0) / 3)
    assert {(r["min_comp"], r["max_cont"]): r["genomes"] for r in got.recovered.collect()} == {(0.9, 0.05): 0, (0.9, 0.1): 1, (0.5, 0.05): 1, (0.5, 0.1): 2}
    assert got.estimate.first()["k_max"] == 3


def test_without_bins_each_contig_is_one(spark, files):
    got = score_bins(spark, f"{files}/m.tsv", f"{files}/b.ms", strict=True)
    assert {r["bin"]: round(r["comp"]) for r in got.bins.collect()} == {"c1": 67, "c2": 33, "c3": 100, "c4": 33}
    assert got.summary is None and got.counts.first()["hq"] == 1


def test_every_setting_is_an_option(spark, files, tmp_path):
    (tmp_path / "settings").write_text("--gnn-epochs 7 --model gat  # a network\n--binarise --min-bin 5\n")
    got = cli.parse(["bin", "--settings", f"{tmp_path}/settings", "--contigs", "a.fasta", "--min-bin", "9"])
    assert (got.gnn_epochs, got.model, got.binarise, got.min_bin, got.contigs, got.gnn_dropout, got.bins) == (7, "gat", True, 9, "a.fasta", 0.5, None)
    assert cli.parse(["bin", "--contigs", "a", "--bins", "4"]).bins == 4
    with pytest.raises(SystemExit):
        cli.parse(["bin"])
    said = []
    cli.main(["score", "--markers", f"{files}/m.tsv", "--marker-sets", f"{files}/b.ms", "--bins", f"{files}/bins.tsv", "--strict"], spark, said.append)
    assert said[0].split("\n")[0].split("\t")[:2] == ["bins", "hq"] and said[0].split("\n")[1].split("\t")[0] == "2"
