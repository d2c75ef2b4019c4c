"""Scores of given bins from marker files: completeness, contamination, counts, and against a gold standard."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binloom.operators import metrics, stats
from binloom.sources import readers


@dataclass(frozen=True)
class Scores:
    """Tables of a scoring: a row a bin, counts and unresolved genomes in a row, the estimate of genomes in a row, and with a
    gold standard (name, bin, length) its summary in a row and the grid of recovered genomes."""

    bins: DataFrame
    counts: DataFrame
    estimate: DataFrame
    summary: DataFrame | None = None
    recovered: DataFrame | None = None


def score_bins(spark: SparkSession, markers: str, marker_sets: str, bins: str | None = None, gold: str | None = None, strict: bool = False) -> Scores:
    """Without a bin file each contig with markers is a bin of its own. Names that a gold standard repeats count once, by the
    lowest bin; a contig of the gold standard in no bin counts as not recovered."""
    found, sets = readers.read_marker_stats(spark, markers), readers.read_marker_sets(spark, marker_sets)
    if bins is None:
        placed = found.select("name", F.col("name").alias("bin")).distinct()
    else:
        placed = readers.read_bins(spark, bins).select("name", "bin")
    scores = metrics.marker_scores(metrics.gene_totals(found, placed, "name"), sets)
    counts = metrics.quality_counts(scores, strict=strict).crossJoin(F.broadcast(metrics.unresolved(placed, found, scores, sets, "name")))  # single rows
    estimate = stats.genome_count_estimate(sets.select("gene"), found.select("gene", F.col("copies").alias("n")), "gene", "n")
    if gold is None or bins is None:
        return Scores(scores, counts, estimate)
    true = metrics.first_rows(readers.read_bins(spark, gold).select("name", F.col("bin").alias("genome"), F.coalesce("length", F.lit(0)).alias("length")), "name", "genome")
    table = metrics.confusion(placed.join(true, "name"), "bin", "genome", "length")
    precision, recall = metrics.bin_precision(table), metrics.genome_recall(table, true, "genome", "length")
    return Scores(scores, counts, estimate, metrics.summary(precision, recall), metrics.recovered_grid(precision, recall, [0.9, 0.5], [0.05, 0.1]))
