"""Medoid clustering in rounds of joins: all medoids that no better one disputes are cut at once.

The sequential way takes a seed, wanders to a medoid of lower mean distance, cuts off what is nearer than the valley in the
medoid's distances, and goes on with the rest. Here every row walks, along its neighbour of the lowest mean distance, to
the medoid it would wander to; each medoid's distances are counted into a histogram; a medoid's cluster is cut if each of
its rows would go to no medoid of lower mean distance. What is left is the next round. No draws are made, so reruns agree.

Pairs within the histogram's reach are computed once, pruned by pivots, and only those of rows left go on. A round settles
the best medoid at least; where valleys are rare they may be shallower, as in the sequential way, and in the end a medoid
without one is cut at the default, so every row is in a cluster. Keys are longs; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binloom.operators.cluster import valley_of_counts
from binloom.operators.similarity import near_pairs
from binloom.sources.store import Scratch

# Radius of a medoid's mean, cut without a valley, reach and width of the histogram, bounds of the ratio.
RADIUS, DEFAULT, REACH, WIDTH, FIRST_RATIO, LAST_RATIO = 0.05, 0.06, 0.3, 0.005, 0.1, 0.55
BINS = 60
#: Share of medoids that should have a valley before shallower ones count.
SHARE = 0.1


def _roots(pointers: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) of (node, next), a root pointing to itself, by doubling."""
    at = pointers
    while True:
        ahead = at.select(F.col("node").alias("next"), F.col("next").alias("after"))
        step = scratch.keep(at.join(ahead, "next").select("node", F.col("after").alias("next"), (F.col("after") != F.col("next")).alias("moved")))
        at = step.select("node", "next")
        if step.where("moved").isEmpty():
            return at.withColumnRenamed("next", "root")


def _cuts(histograms: DataFrame, ratio: float) -> DataFrame:
    """(m, cut) of (m, bins, counts): null without a valley."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one in batches:
            cuts = []
            for bins, counts in zip(one.column(1).to_pylist(), one.column(2).to_pylist()):
                full = np.zeros(BINS)
                full[bins] = counts
                cut = valley_of_counts(full, ratio)
                cuts.append(DEFAULT if cut is None and ratio > LAST_RATIO else cut)
            yield pa.RecordBatch.from_arrays([one.column(0), pa.array(cuts, pa.float64())], ["m", "cut"])

    return histograms.mapInArrow(kernel, "m long, cut double")


def medoid_rounds(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, bin, medoid, cut): each row in the cluster of a medoid within the cut, named by the medoid."""
    spark, kept = df.sparkSession, Scratch(df.sparkSession)
    near = near_pairs(df, key, vector, REACH)
    loops = df.select(F.col(key).cast("long").alias("i"), F.col(key).cast("long").alias("j"), F.lit(0.0).alias("d"))
    both = F.explode(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))).alias("e")
    pairs = near.select(both, F.col("distance").alias("d")).select("e.i", "e.j", "d").unionByName(loops)
    scratch = Scratch(spark)
    pairs, ratio, done = scratch.keep(pairs), FIRST_RATIO, []
    while not pairs.isEmpty():
        step = Scratch(spark)
        mean = step.keep(pairs.where(F.col("d") <= RADIUS).groupBy(F.col("i").alias("node")).agg(F.avg("d").alias("mean")))
        other = mean.select(F.col("node").alias("j"), F.struct("mean", F.col("node").alias("j")).alias("rank"))
        pointers = step.keep(pairs.where(F.col("d") <= RADIUS).join(other, "j").groupBy(F.col("i").alias("node")).agg(F.min("rank")["j"].alias("next")))
        medoids = step.keep(_roots(pointers, step).select(F.col("root").alias("m")).distinct())
        around = pairs.join(medoids, pairs["i"] == medoids["m"]).select("m", "j", "d")
        counted = around.where("m <> j").groupBy("m", F.least(F.floor(F.col("d") / WIDTH), F.lit(BINS - 1)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
        lists = counted.groupBy("m").agg(F.collect_list(F.struct("bin", "n")).alias("h"))  # BINS entries at most
        histograms = medoids.join(lists, "m", "left").select("m", F.coalesce(F.col("h")["bin"], F.array().cast("array<int>")).alias("bins"), F.coalesce(F.col("h")["n"], F.array().cast("array<bigint>")).alias("counts"))
        cuts = step.keep(_cuts(histograms, ratio).where("cut is not null"))
        found, every = cuts.count(), medoids.count()
        if found:
            rank = F.struct("mean", "m").alias("rank")
            claims = step.keep(around.join(cuts, "m").where("d <= cut").join(mean.withColumnRenamed("node", "m"), "m").select("m", "j", "cut", rank))
            first = claims.groupBy("j").agg(F.min("rank")["m"].alias("first"))
            disputed = claims.join(first, "j").where("first <> m").select("m").distinct()
            taken = kept.keep(claims.join(disputed, "m", "left_anti").select(F.col("j").alias(key), F.col("m").alias("bin"), F.col("m").alias("medoid"), "cut"))
            done.append(taken)
            gone = taken.select(F.col(key).alias("i"))
            pairs = pairs.join(gone, "i", "left_anti").join(gone.withColumnRenamed("i", "j"), "j", "left_anti").select("i", "j", "d")
            pairs = step.keep(pairs)
            scratch.clear()
            scratch = step
        else:
            step.clear()
        if found < SHARE * every:
            ratio += 0.1
    out = spark.createDataFrame([], f"`{key}` long, bin long, medoid long, cut double")
    for some in done:
        out = out.unionByName(some)
    out = kept.keep(out, last=True)
    scratch.clear()
    kept.clear()
    return out
