"""Features of contigs: k-mer frequencies, depths, standardised columns and vectors."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from binloom import functions as G


def kmer_counts(seqs: DataFrame, key: str, seq: str, k: int = 4, canonical: bool = False, step: int = 1 << 16) -> DataFrame:
    """(key, kmer, n) of the k-mers present; a sequence of more than two steps is read in pieces."""
    part = seqs.select(key, F.explode(G.pieces(F.col(seq), k, step)).alias("__piece"))
    out = part.select(key, F.explode(G.kmers(F.col("__piece"), k)).alias("kmer"))
    if canonical:
        out = out.withColumn("kmer", G.canonical(F.col("kmer")))
    return out.groupBy(key, "kmer").agg(F.count(F.lit(1)).alias("n"))


def kmer_frequencies(seqs: DataFrame, key: str, seq: str, k: int = 4) -> DataFrame:
    """(key, kmer, freq): share of each of the 4^k k-mers less 4^-k, zeros included; sequences without any are left out."""
    letters = F.array(*[F.lit("".join(x)) for x in product("ACGT", repeat=k)])
    packed = kmer_counts(seqs, key, seq, k).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("kmer", "n"))).alias("m"), F.sum("n").alias("total"))  # 4^k entries at most
    share = lambda x: F.coalesce(F.try_element_at("m", x), F.lit(0)) / F.col("total") - F.lit(4.0**-k)
    rows = packed.select(key, F.explode(F.transform(letters, lambda x: F.struct(x.alias("kmer"), share(x).alias("freq")))).alias("row"))
    return rows.select(key, "row.kmer", "row.freq")


def normalise_rows(long: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """A share of the row's sum (plus 1e-10)."""
    return long.withColumn(out, F.col(value) / (F.sum(value).over(Window.partitionBy(key)) + 1e-10))


def zscore(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns less their mean over their population deviation, from one aggregated row."""
    stats = df.agg(*[f(c).alias(f"__{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    out = df.crossJoin(F.broadcast(stats))  # a single row
    for c in columns:
        out = out.withColumn(c, (F.col(c) - F.col(f"__m_{c}")) / F.nullif(F.col(f"__s_{c}"), F.lit(0.0)))
    return out.select(*df.columns)


def vector_stats(df: DataFrame, vector: str, by: str | None = None) -> DataFrame:
    """(by, pos, mean, std): per dimension, with the population deviation."""
    keys = [by] if by else []
    long = df.select(*keys, F.posexplode(vector).alias("pos", "x"))
    return long.groupBy(*keys, "pos").agg(F.avg(F.col("x").cast("double")).alias("mean"), F.stddev_pop(F.col("x").cast("double")).alias("std"))


def standardise_vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, vector) with every dimension standardised."""
    stats = vector_stats(df, vector).agg(F.array_sort(F.collect_list(F.struct("pos", "mean", "std"))).alias("s"))  # a row a dimension
    scaled = F.zip_with(vector, "s", lambda x, s: (x.cast("double") - s["mean"]) / F.nullif(s["std"], F.lit(0.0)))
    return df.crossJoin(F.broadcast(stats)).select(key, scaled.alias(vector))


def concat_features(a: DataFrame, b: DataFrame, key: str, left: str, right: str, out: str) -> DataFrame:
    return a.join(b, key).select(key, F.concat(left, right).alias(out))
