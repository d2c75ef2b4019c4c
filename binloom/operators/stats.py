"""Statistics of an assembly and of its marker genes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from binloom.sources.store import durable


#: Buckets that a step of a quantile counts.
BUCKETS = 4096


def ranked(df: DataFrame, by: str, out: str) -> DataFrame:
    """df with `out`, 0, 1, 2 ... in the order of a column: ranges of it are numbered each for itself, behind those before it."""
    placed = df.repartitionByRange(F.col(by)).sortWithinPartitions(by).withColumn("__at", F.monotonically_increasing_id())
    placed = durable(placed.withColumn("__range", F.shiftright("__at", 33)))  # the numbers of a written table stay
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("__range").agg(F.count(F.lit(1)).alias("__n")).select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))  # a row a range
    return placed.join(F.broadcast(starts), "__range").withColumn(out, F.col("__start") + F.col("__at") - F.shiftleft(F.col("__range"), 33)).drop("__at", "__range", "__start")


def exact_quantile(df: DataFrame, column: str, share: float) -> float | None:
    """The linear quantile of a column, None without values: buckets are counted, then the one that holds the place is cut
    into buckets again, from its least to its largest value, until it is a single value."""
    x = df.select(F.col(column).cast("double").alias("x")).where("x is not null")
    n, low, high = x.agg(F.count(F.lit(1)), F.min("x"), F.max("x")).first()
    if not n:
        return None
    place = share * (n - 1)
    first = int(place)
    skipped, inside = 0, n
    while low < high:
        at = F.least(F.floor((F.col("x") - low) / (high - low) * BUCKETS), F.lit(BUCKETS - 1))
        counts = x.where(F.col("x").between(low, high)).groupBy(at.alias("at")).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).collect()  # BUCKETS rows
        for r in sorted(counts, key=lambda r: r["at"]):
            if first < skipped + r["n"]:
                low, high, inside = r["low"], r["high"], r["n"]
                break
            skipped += r["n"]
    if place == first:
        return float(low)
    after = low if first + 1 < skipped + inside else x.where(F.col("x") > low).agg(F.min("x")).first()[0]
    return float(low + (after - low) * (place - first))


def n50(df: DataFrame, length: str, by: str | None = None) -> DataFrame:
    """(by, n50): the first length, from the longest down, at which half of the total is reached.

    Lengths are counted first, so the running sum goes over distinct lengths, not contigs.
    """
    keys = [by] if by else []
    counted = df.groupBy(*keys, length).agg((F.count(F.lit(1)) * F.col(length)).alias("bp"))
    down = Window.partitionBy(*keys).orderBy(F.col(length).desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counted.withColumn("run", F.sum("bp").over(down)).withColumn("all", F.sum("bp").over(Window.partitionBy(*keys)))
    return ranked.where(F.col("run") * 2 >= F.col("all")).groupBy(*keys).agg(F.max(length).alias("n50"))


def assembly_stats(df: DataFrame, length: str, by: str) -> DataFrame:
    x = F.col(length)
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("contigs"), F.sum(x).alias("total"), F.avg(x).alias("mean"), F.min(x).alias("shortest"), F.max(x).alias("longest"))


def assembly_summary(contigs: DataFrame, depths: DataFrame | None = None, edges: DataFrame | None = None, paths: DataFrame | None = None) -> DataFrame:
    """One row: contigs (length), their total, N50, mean, longest and shortest; samples of depths (sample), edges, and paths
    (path), 0 where a table is not given."""
    x = F.col("length")
    one = contigs.agg(F.count(F.lit(1)).alias("contigs"), F.sum(x).alias("total"), F.avg(x).alias("mean"), F.max(x).alias("longest"), F.min(x).alias("shortest"))
    counts = [n50(contigs, "length"), *(df.agg(f.alias(name)) for name, df, f in (("samples", depths, F.count_distinct("sample")), ("edges", edges, F.count(F.lit(1))), ("paths", paths, F.count_distinct("path"))) if df is not None)]
    for df in counts:
        one = one.crossJoin(F.broadcast(df))  # single rows
    return one.select("*", *[F.lit(0).cast("long").alias(name) for name, df in (("samples", depths), ("edges", edges), ("paths", paths)) if df is None])


def marker_stats(markers: DataFrame, contigs: DataFrame, contig: str, gene: str) -> DataFrame:
    """One row: contigs with markers, the most markers of one, the mean over those with any."""
    per = markers.select(contig, gene).distinct().groupBy(contig).agg(F.count(F.lit(1)).alias("n"))
    return per.join(contigs, contig, "left_semi").agg(F.count(F.lit(1)).alias("with_markers"), F.max("n").alias("most"), F.avg("n").alias("mean"))


def genome_count_estimate(genes: DataFrame, copies: DataFrame, gene: str, n: str) -> DataFrame:
    """One row: the 75th percentile of copies per gene (0 if unseen), the distinct values from it up, and the largest."""
    per = genes.select(gene).distinct().join(copies.groupBy(gene).agg(F.sum(n).alias("n")), gene, "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    per = durable(per)
    over = per.withColumn("p75", F.lit(exact_quantile(per, "n", 0.75)).cast("double")).where("n >= p75")
    return over.agg(F.first("p75").alias("p75"), F.count_distinct("n").alias("candidates"), F.min("n").alias("k_min"), F.max("n").alias("k_max"))


def run_statistics(scores: DataFrame, metric: str, value: str) -> DataFrame:
    """Mean and population deviation of a metric over runs."""
    return scores.groupBy(metric).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


def best_by(df: DataFrame, keys: list[str], value: str, *ties: str) -> DataFrame:
    """The row of the largest value of each key; ties go to the least of the tie columns."""
    w = Window.partitionBy(*keys).orderBy(F.col(value).desc(), *ties)
    return df.withColumn("__rank", F.row_number().over(w)).where("__rank = 1").drop("__rank")
