"""The whole way from files to bins on two made-up genomes of unlike composition."""

import random

import pytest

from binloom.plans.binning import BinningConfig, run_binning


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    d = tmp_path_factory.mktemp("assembly")
    draw = random.Random(5)
    names = [f"edge_{i}" for i in range(1, 13)]
    kind = {n: i % 2 for i, n in enumerate(names)}
    seq = lambda n: "".join(draw.choices("ACGT", (4, 1, 1, 4) if kind[n] else (1, 4, 4, 1), k=1200))
    (d / "a.fasta").write_text("".join(f">{n} x\n{seq(n)}\n" for n in names) + ">edge_99\nACGT\n")
    links = [(a, b) for a, b in zip(names, names[2:])]
    (d / "a.gfa").write_text("".join(f"S\t{n}\tA\n" for n in names) + "".join(f"L\t{a}\t+\t{b}\t-\t0M\tRC:i:5\n" for a, b in links))
    (d / "d.txt").write_text("contigName\tcontigLen\ttotalAvgDepth\ts1\ts1-var\ts2\ts2-var\n" + "".join(f"{n}\t1200\t9\t{8 - 6 * kind[n]}\t1\t{1 + 7 * kind[n]}\t1\n" for n in names))
    (d / "m.tsv").write_text("".join(f"{n}\t{{'{n}_1': {{'G{i // 2}': [[1, 2]]}}}}\n" for i, n in enumerate(names)))
    (d / "b.ms").write_text("# marker sets\nx\ty\t[" + ", ".join(f"{{'G{g}'}}" for g in range(6)) + "]\n")
    return d, kind


@pytest.mark.parametrize("layers, epochs", [(0, 0), (1, 0), (1, 2)])
def test_two_genomes_part(spark, files, layers, epochs):
    d, kind = files
    config = BinningConfig(f"{d}/a.fasta", f"{d}/a.gfa", f"{d}/d.txt", f"{d}/m.tsv", f"{d}/b.ms", f"{d}/out{layers}{epochs}", samples=2, min_bin=1000, layers=layers, bins=2, epochs=epochs, hidden=16, latent=4, eval_every=1)
    bins, scores = run_binning(spark, config)
    got = {r["name"]: r["bin"] for r in bins.collect()}
    assert set(got) == set(kind)  # the short contig is not binned
    assert len({(kind[n], b) for n, b in got.items()}) == 2
    assert sorted((r["comp"], r["cont"]) for r in scores.collect()) == [(pytest.approx(100), 0.0)] * 2
    lines = spark.read.text(f"{d}/out{layers}{epochs}/contig2bin").count()
    assert lines == 3 + len(kind)
    assert len([p for p in (d / f"out{layers}{epochs}" / "bins").iterdir() if p.is_dir()]) == 2


@pytest.mark.parametrize("model, more", [("sage", {}), ("gat", {"gnn_heads": 2, "binarise": True}), ("gcn", {"loops_only": True, "marked_only": True, "same_marker_edges": True})])
def test_graph_networks_in_the_flow(spark, files, model, more):
    """The vectors tell the genomes apart, and their network does not lose that; the best epoch's bins are kept."""
    d, kind = files
    config = BinningConfig(f"{d}/a.fasta", f"{d}/a.gfa", f"{d}/d.txt", f"{d}/m.tsv", f"{d}/b.ms", samples=2, bins=2, model=model, gnn_epochs=2, gnn_hidden=4, gnn_out=2, gnn_layers=1, gnn_dropout=0.0, eval_every=1, **more)
    bins, scores = run_binning(spark, config)
    got = {r["name"]: r["bin"] for r in bins.collect()}
    assert set(got) == set(kind)
    assert len({(kind[n], b) for n, b in got.items()}) == 2
    assert [(r["comp"], r["cont"]) for r in scores.collect()] == [(pytest.approx(100), 0.0)] * 2


def test_a_network_needs_a_graph(spark, files):
    d, _ = files
    with pytest.raises(ValueError):
        run_binning(spark, BinningConfig(f"{d}/a.fasta", model="gcn", bins=2))
