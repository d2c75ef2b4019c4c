"""Writers: bins with AMBER headers, FASTA per bin, embeddings, edges, components, scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binloom.operators.stats import ranked


def write_contig2bin(bins: DataFrame, path: str, sample: str = "SAMPLEID", extra_comment: bool = False) -> None:
    """One text file: the header lines, then name and bin; sorted, so the file is the same on reruns."""
    spark = bins.sparkSession
    head = ["#CLUSTERING"] * extra_comment + ["@Version:0.9.0", f"@SampleID:{sample}", "@@SEQUENCEID\tBINID"]
    top = spark.createDataFrame([(i - len(head), line) for i, line in enumerate(head)], "ord int, value string")
    rows = bins.select(F.lit(0).alias("ord"), F.concat_ws("\t", "name", "bin").alias("value"))
    top.unionByName(rows).repartition(1).sortWithinPartitions("ord", "value").select("value").write.mode("overwrite").text(path)


def bins_with_leftovers(bins: DataFrame, contigs: DataFrame, min_bp: int) -> DataFrame:
    """(name, bin): bins of min_bp and more; contigs in no bin that are longer than min_bp become bins of their own,
    numbered after the others in name order; members of skipped bins are not among them."""
    sized = bins.join(contigs.select("name", "length"), "name")
    big = sized.groupBy("bin").agg(F.sum("length").alias("bp")).where(F.col("bp") >= min_bp).select("bin")
    kept = sized.join(big, "bin", "left_semi").select("name", F.col("bin").cast("string").alias("bin"))
    n = big.count()
    left = contigs.where(F.col("length") > min_bp).join(bins, "name", "left_anti")
    alone = ranked(left.select("name"), "name", "place").select("name", (F.col("place") + n).cast("string").alias("bin"))
    return kept.unionByName(alone)


def write_bin_fasta(bins: DataFrame, contigs: DataFrame, path: str, min_bp: int) -> None:
    """A folder per bin with its contigs as FASTA."""
    rows = bins_with_leftovers(bins, contigs, min_bp).join(contigs.select("name", "seq"), "name")
    rows.select("bin", F.concat(F.lit(">"), "name", F.lit("\n"), "seq").alias("value")).write.mode("overwrite").partitionBy("bin").text(path)


def write_features(df: DataFrame, path: str, name: str = "name", vector: str = "emb") -> None:
    df.select(F.concat_ws(" ", F.col(name), F.array_join(F.transform(vector, lambda x: x.cast("string")), " "))).write.mode("overwrite").text(path)


def write_edges(edges: DataFrame, path: str) -> None:
    edges.select("src", "dst", "weight").write.mode("overwrite").option("sep", "\t").csv(path)


def write_components(components: DataFrame, path: str, least: int = 2, containing: str = "") -> None:
    """node and component of components of `least` nodes and more; of these the nodes whose names contain a text."""
    big = components.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    named = components.where(F.contains(F.col("node").cast("string"), F.lit(containing)))
    named.join(big, "component", "left_semi").select("node", "component").write.mode("overwrite").option("sep", "\t").csv(path)


def append_scores(scores: DataFrame, path: str) -> None:
    scores.write.mode("append").parquet(path)
