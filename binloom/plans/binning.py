"""From assembly files to scored bins: read, featurise, clean and propagate over the graph, cluster, score, write."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binloom import functions as G
from binloom.operators import cluster, features, gnn, graph, medoids, metrics, training
from binloom.sources import readers, sinks
from binloom.sources.store import durable


@dataclass(frozen=True)
class BinningConfig:
    """Files and settings of a run; files that are None are left out, and what needs them with them."""

    contigs: str
    graph: str | None = None
    depths: str | None = None
    markers: str | None = None
    marker_sets: str | None = None
    out: str | None = None
    samples: int = 1
    kmer: int = 4
    min_contig: int = 1000
    min_bin: int = 200_000
    edge_threshold: float = 0.0
    layers: int = 0
    bins: int | None = None  # k-means with as many bins; medoid clustering, in rounds, if None
    seed: int = 0
    epochs: int = 0  # of the autoencoder; clusters the vectors themselves if 0
    hidden: int = 512
    latent: int = 64
    batch: int = 256
    eval_every: int = 10
    eval_skip: int = 0
    binarise: bool = False  # of the links those from the 90th percentile of the weights, with weight 1
    loops_only: bool = False  # no links at all
    marked_only: bool = False  # bins of contigs with markers only
    same_marker_edges: bool = False  # keep links between contigs that share a marker
    model: str | None = None  # gcn, sage or gat: a graph network over the vectors
    gnn_epochs: int = 100
    gnn_hidden: int = 128
    gnn_out: int = 64
    gnn_layers: int = 3
    gnn_heads: int = 1
    gnn_dropout: float = 0.5
    gnn_step: float = 1e-2
    negatives: int = 1
    graph_weight: float = 1.0
    marker_weight: float = 1.0


def contig_vectors(spark: SparkSession, contigs: DataFrame, config: BinningConfig) -> DataFrame:
    """(idx, emb): depths, if any, before the standardised k-mer frequencies; a contig without k-mers has zeros there."""
    freq = features.kmer_frequencies(contigs, "name", "seq", config.kmer)
    stats = freq.groupBy("kmer").agg(F.avg("freq").alias("m"), F.stddev_pop("freq").alias("s"))
    scaled = freq.join(F.broadcast(stats), "kmer").withColumn("z", F.coalesce((F.col("freq") - F.col("m")) / F.nullif("s", F.lit(0.0)), F.lit(0.0)))  # 4^k rows
    packed = scaled.groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("kmer", "z"))), lambda r: r["z"]).alias("k"))
    out = contigs.select("idx", "name").join(packed, "name", "left").withColumn("k", F.coalesce("k", F.array_repeat(F.lit(0.0), 4**config.kmer)))
    if config.depths is None:
        return out.select("idx", F.col("k").alias("emb"))
    depth = readers.align_depths(contigs, readers.read_depths(spark, config.depths), config.samples)
    depth = features.normalise_rows(depth, "name", "depth", "d") if config.samples > 1 else features.zscore(depth, ["depth"]).select("name", "sample", F.coalesce("depth", F.lit(0.0)).alias("d"))
    row = depth.groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("sample", "d"))), lambda r: r["d"]).alias("d"))
    return out.join(row, "name").select("idx", F.concat("d", "k").alias("emb"))


def smooth(vectors: DataFrame, edges: DataFrame, layers: int) -> DataFrame:
    """(idx, emb) after that many steps of the normalised adjacency; a contig without edges keeps its vector."""
    adjacency = graph.normalised_adjacency(edges)
    for _ in range(layers):
        near = gnn.spread_along(adjacency, vectors.withColumnRenamed("idx", "node"), "emb", "norm").withColumnRenamed("node", "idx")
        vectors = vectors.join(near, "idx", "left").select("idx", F.coalesce("near", "emb").alias("emb"))
    return vectors


def trained_vectors(vectors: DataFrame, edges: DataFrame | None, differ: DataFrame | None, config: BinningConfig, binned: Callable) -> DataFrame:
    """(idx, emb): the vectors before their latent means, of the epoch with most high-quality bins where bins are scored."""
    shape = training.Shape(config.samples if config.depths else 0, 4**config.kmer, config.hidden, config.latent)
    links = None
    if edges is not None:
        drawn = graph.negative_edges(edges, vectors.select("idx"), "idx", 1, config.seed)
        links = edges.select("src", "dst", F.lit(1.0).alias("y")).unionByName(drawn.select("src", "dst", F.lit(0.0).alias("y")))
    encoded = lambda state: durable(training.encode(vectors, "idx", "emb", state, shape, concat=True))

    def evaluate(_: int, state: training.State) -> float:
        good = G.is_hq(F.col("comp"), F.col("cont"))
        return float(binned(encoded(state))[1].agg(F.count_if(good)).first()[0])

    scored = config.markers is not None and config.marker_sets is not None
    state, _ = training.train(vectors, "idx", "emb", shape, config.epochs, config.batch, seed=config.seed, links=links, differ=differ, evaluate=evaluate if scored else None, every=config.eval_every, skip=config.eval_skip)
    return encoded(state)


def networked_vectors(vectors: DataFrame, edges: DataFrame, differ: DataFrame | None, config: BinningConfig, binned: Callable) -> DataFrame:
    """(idx, emb): the vectors before what a graph network makes of them, of the epoch with most high-quality bins."""
    nodes = vectors.select(F.col("idx").alias("node"), F.col("emb").alias("x"))
    value = graph.weighted_adjacency(edges) if not config.loops_only else graph.self_loops(nodes, "node").select("src", "dst", F.col("weight").cast("double").alias("value"))
    adjacency = durable(graph.with_loops(value, nodes, "node", "value"))
    first = nodes.select(F.size("x")).first()
    net = gnn.Net(config.model, first[0] if first else 0, config.gnn_hidden, config.gnn_out, config.gnn_layers, config.gnn_heads, config.gnn_dropout)
    encoded = lambda state: gnn.embed(net, state, nodes, adjacency).withColumnRenamed("node", "idx")

    def evaluate(_: int, state: training.State) -> float:
        return float(binned(encoded(state))[1].agg(F.count_if(G.is_hq(F.col("comp"), F.col("cont")))).first()[0])

    scored = config.markers is not None and config.marker_sets is not None
    losses = gnn.Losses(config.graph_weight, config.marker_weight, config.negatives, config.gnn_step)
    links = edges.where("src <> dst").select("src", "dst")
    state, _ = gnn.train(net, nodes, adjacency, links, config.gnn_epochs, losses, config.seed, differ, evaluate if scored else None, config.eval_every, config.eval_skip)
    return encoded(state)


def run_binning(spark: SparkSession, config: BinningConfig) -> tuple[DataFrame, DataFrame | None]:
    """(name, bin) of every contig of min_contig and more, and (bin, comp, cont) where markers and sets are given."""
    every = readers.read_fasta(spark, config.contigs)
    contigs = every.where(F.col("length") >= config.min_contig)
    markers = readers.read_marker_stats(spark, config.markers) if config.markers else None
    vectors = durable(contig_vectors(spark, contigs, config))  # clustering reads them many times
    edges = differ = None
    marked = markers.join(contigs.select("name", "idx"), "name") if markers is not None else None
    if config.graph and (config.layers or config.epochs or config.model):
        links = readers.read_gfa_links(spark, config.graph).select("src", "dst", "weight")
        edges = graph.edges_over(graph.link_edges(links, contigs, config.min_contig), config.edge_threshold)
        edges = graph.binarise(edges) if config.binarise else edges
        if marked is not None and not config.same_marker_edges:
            edges = graph.remove_edges(edges, graph.same_marker_edges(edges, marked, "idx", "gene"))
        edges = durable(edges)
    if marked is not None and (config.epochs or config.model):
        differ = graph.must_differ_pairs(marked, "idx", "gene").toDF("src", "dst")

    def binned(emb: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        emb = durable(smooth(emb, edges, config.layers)) if edges is not None and config.layers else emb
        emb = emb.join(marked.select("idx").distinct(), "idx", "left_semi") if config.marked_only and marked is not None else emb
        found = cluster.kmeans(emb, "idx", "emb", config.bins, config.seed) if config.bins else medoids.medoid_rounds(emb, "idx", "emb")
        bins = durable(found.join(contigs.select("idx", "name"), "idx").select("name", F.col("bin").cast("string").alias("bin")))
        if markers is None or not config.marker_sets:
            return bins, None
        return bins, metrics.marker_scores(metrics.gene_totals(markers, bins, "name"), readers.read_marker_sets(spark, config.marker_sets))

    if config.epochs:
        vectors = trained_vectors(vectors, edges, differ, config, binned)
    if config.model:
        if edges is None:
            raise ValueError("a graph network needs a graph file")
        vectors = networked_vectors(vectors, edges, differ, config, binned)
    bins, scores = binned(vectors)
    if config.out:
        sinks.write_contig2bin(bins, f"{config.out}/contig2bin")
        sinks.write_bin_fasta(bins, contigs, f"{config.out}/bins", config.min_bin)
    return bins, scores
