"""Column functions: names, k-mers, vectors and scores, all of built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def contig_name(name: Column) -> Column:
    """Trimmed, up to the first space, at most two `_` parts."""
    return F.substring_index(F.substring_index(F.trim(name), " ", 1), "_", 2)


def species_of_read(read: Column) -> Column:
    return F.substring_index(read, "_reads", 1)


def kmers(seq: Column, k: int = 4) -> Column:
    """Every window of k letters that are all upper-case A, C, G or T, in one pass: a look-ahead takes no letters."""
    return F.regexp_extract_all(seq, F.lit(f"(?=([ACGT]{{{k}}}))"), F.lit(1))


def pieces(seq: Column, k: int, step: int = 1 << 16) -> Column:
    """A sequence as one piece, or a long one as pieces that overlap by k - 1, so that each window is in just one."""
    starts = F.sequence(F.lit(0), F.length(seq) - 1, F.lit(step))
    return F.when(F.length(seq) > 2 * step, F.transform(starts, lambda i: F.substr(seq, i + 1, F.lit(step + k - 1)))).otherwise(F.array(seq))


def reverse_complement(seq: Column) -> Column:
    return F.translate(F.reverse(seq), "ACGT", "TGCA")


def canonical(kmer: Column) -> Column:
    return F.least(kmer, reverse_complement(kmer))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def medoid_normalise(a: Column) -> Column:
    """Divided by norm times sqrt 2; a row whose sum is zero counts as 1/d everywhere."""
    total = F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double"))
    filled = F.when(total == 0, F.transform(a, lambda _: F.lit(1.0) / F.size(a))).otherwise(F.transform(a, lambda x: x.cast("double")))
    # The norm is taken once a row: inside the last lambda it would be taken again for each value.
    both = F.transform(F.array(filled), lambda v: F.struct(v.alias("v"), (norm(v) * F.sqrt(F.lit(2.0))).alias("n")))[0]
    return F.transform(F.array(both), lambda b: F.transform(b["v"], lambda x: x / b["n"]))[0]


def medoid_distance(a: Column, b: Column) -> Column:
    """Half of one minus the cosine, of rows normalised by `medoid_normalise`."""
    return F.lit(0.5) - dot(a, b)


def f1(precision: Column, recall: Column) -> Column:
    return F.when(precision * recall == 0, F.lit(0.0)).otherwise(2 * precision * recall / (precision + recall))


def choose2(n: Column) -> Column:
    return n * (n - 1) / 2


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def relu(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))


def draw(*parts: Column | str | int) -> Column:
    """A number below 2^60 from the md5 of the parts as text, joined by colons: the same in every engine."""
    text = [F.lit(str(p)) if isinstance(p, int) else (F.col(p) if isinstance(p, str) else p).cast("string") for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *text).cast("binary")), 1, 15), 16, 10).cast("long")


def leaky_relu(x: Column, slope: float = 0.2) -> Column:
    return F.when(x >= 0, x).otherwise(x * slope)


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def is_hq(comp: Column, cont: Column, strict: bool = False) -> Column:
    """High quality: completeness 90 and more, contamination under 5."""
    return ((comp > 90) if strict else (comp >= 90)) & (cont < 5)


def is_mq(comp: Column, cont: Column, strict: bool = False) -> Column:
    return ((comp > 50) if strict else (comp >= 50)) & (cont < 10)
