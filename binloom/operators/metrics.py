"""Scores of bins: marker completeness and contamination, label precision and recall, recovered genomes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from binloom import functions as G
from binloom.operators.stats import best_by

#: Contigs of a bin that meet the rest of it in one task.
PAIR_BLOCK = 256


def gene_totals(markers: DataFrame, bins: DataFrame, contig: str) -> DataFrame:
    """(bin, gene, copies): markers (contig, gene, copies) summed over the contigs of each bin."""
    return bins.join(markers, contig).groupBy("bin", "gene").agg(F.sum("copies").alias("copies"))


def marker_scores(totals: DataFrame, sets: DataFrame) -> DataFrame:
    """(bin, comp, cont): means over all marker sets (set_id, gene) of the share found and of the surplus copies."""
    sized = sets.withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("set_id")))
    n = sets.agg(F.count_distinct("set_id").alias("n_sets"))
    share = totals.where("copies > 0").join(sized, "gene").groupBy("bin").agg(F.sum(1 / F.col("size")).alias("found"), F.sum((F.col("copies") - 1) / F.col("size")).alias("extra"))
    every = totals.select("bin").distinct().join(share, "bin", "left").crossJoin(F.broadcast(n))  # a single row
    return every.select("bin", (100 * F.coalesce("found", F.lit(0.0)) / F.col("n_sets")).alias("comp"), (100 * F.coalesce("extra", F.lit(0.0)) / F.col("n_sets")).alias("cont"))


def quality_counts(scores: DataFrame, hq: tuple[float, float] = (90, 5), mq: tuple[float, float] = (50, 10), strict: bool = False) -> DataFrame:
    """One row: bins, HQ and MQ counts, mean completeness and contamination of the HQ ones; `strict`: above the completeness
    that is asked for, not at it."""
    enough = lambda least: F.col("comp") > least if strict else F.col("comp") >= least
    is_hq = enough(hq[0]) & (F.col("cont") < hq[1])
    is_mq = enough(mq[0]) & (F.col("cont") < mq[1])
    return scores.agg(F.count(F.lit(1)).alias("bins"), F.count_if(is_hq).alias("hq"), F.count_if(is_mq).alias("mq"), F.avg(F.when(is_hq, F.col("comp"))).alias("hq_comp"), F.avg(F.when(is_hq, F.col("cont"))).alias("hq_cont"))


def unresolved(bins: DataFrame, markers: DataFrame, scores: DataFrame, sets: DataFrame, contig: str, hq: tuple[float, float] = (90, 5)) -> DataFrame:
    """One row: contigs outside HQ bins, those with markers, and the genomes in their pool, int(contamination / 100)."""
    good = scores.where((F.col("comp") >= hq[0]) & (F.col("cont") < hq[1])).select("bin")
    left = bins.join(good, "bin", "left_anti").select(contig).distinct()
    counts = left.join(markers.select(contig).distinct().withColumn("m", F.lit(1)), contig, "left").agg(F.count(F.lit(1)).alias("contigs"), F.count("m").alias("with_markers"))
    pool = marker_scores(gene_totals(markers, left.withColumn("bin", F.lit("pool")), contig), sets)
    genomes = pool.agg(F.coalesce(F.max(F.floor(F.col("cont") / 100)), F.lit(0)).cast("long").alias("genomes"))
    return counts.crossJoin(F.broadcast(genomes))  # a single row


def extra_metrics(scores: DataFrame) -> DataFrame:
    mean = lambda of, where: F.coalesce(F.avg(F.when(where, F.col(of))), F.lit(0.0))
    return scores.agg(F.avg("comp").alias("avg_comp"), F.avg("cont").alias("avg_cont"), mean("cont", F.col("comp") > 50).alias("cont_50"), mean("cont", F.col("comp") > 90).alias("cont_90"), mean("comp", F.col("cont") < 5).alias("comp_5"))


def confusion(assigned: DataFrame, bin_: str, genome: str, length: str) -> DataFrame:
    """(bin, genome, bp, seqs)."""
    return assigned.groupBy(F.col(bin_).alias("bin"), F.col(genome).alias("genome")).agg(F.sum(length).alias("bp"), F.count(F.lit(1)).alias("seqs"))


def bin_precision(table: DataFrame) -> DataFrame:
    """(bin, genome, precision_bp, precision_seq, tp_bp, bin_bp): against each bin's largest genome by bp."""
    w = Window.partitionBy("bin")
    t = table.withColumn("bin_bp", F.sum("bp").over(w)).withColumn("bin_seqs", F.sum("seqs").over(w))
    best = best_by(t, ["bin"], "bp", "genome")
    return best.select("bin", "genome", (F.col("bp") / F.col("bin_bp")).alias("precision_bp"), (F.col("seqs") / F.col("bin_seqs")).alias("precision_seq"), F.col("bp").alias("tp_bp"), "bin_bp", F.col("seqs").alias("tp_seqs"), "bin_seqs")


def genome_recall(table: DataFrame, gold: DataFrame, genome: str, length: str) -> DataFrame:
    """(genome, bin, recall_bp, recall_seq, ...): each genome of the gold standard against its best bin; none: 0."""
    size = gold.groupBy(F.col(genome).alias("genome")).agg(F.sum(length).alias("genome_bp"), F.count(F.lit(1)).alias("genome_seqs"))
    best = best_by(table, ["genome"], "bp", "bin")
    out = size.join(best, "genome", "left").withColumns({"bp": F.coalesce("bp", F.lit(0)), "seqs": F.coalesce("seqs", F.lit(0))})
    return out.select("genome", "bin", (F.col("bp") / F.col("genome_bp")).alias("recall_bp"), (F.col("seqs") / F.col("genome_seqs")).alias("recall_seq"), F.col("bp").alias("tp_bp"), "genome_bp", F.col("seqs").alias("tp_seqs"), "genome_seqs")


def summary(precision: DataFrame, recall: DataFrame) -> DataFrame:
    """One row: averages, standard errors, sample variances, weighted values, accuracy and F1."""
    p = precision.agg(F.avg("precision_bp").alias("precision_avg_bp"), (F.stddev_samp("precision_bp") / F.sqrt(F.count(F.lit(1)))).alias("precision_sem_bp"), F.var_samp("precision_bp").alias("precision_var_bp"), F.avg("precision_seq").alias("precision_avg_seq"), (F.sum("tp_bp") / F.sum("bin_bp")).alias("precision_weighted_bp"), F.sum("tp_bp").alias("tp_bp"), F.sum("tp_seqs").alias("tp_seqs"))
    r = recall.agg(F.avg("recall_bp").alias("recall_avg_bp"), (F.stddev_samp("recall_bp") / F.sqrt(F.count(F.lit(1)))).alias("recall_sem_bp"), F.var_samp("recall_bp").alias("recall_var_bp"), F.avg("recall_seq").alias("recall_avg_seq"), (F.sum("tp_bp") / F.sum("genome_bp")).alias("recall_weighted_bp"), F.sum("genome_bp").alias("gold_bp"), F.sum("genome_seqs").alias("gold_seqs"))
    out = p.crossJoin(F.broadcast(r))  # a single row each
    out = out.withColumn("accuracy_bp", F.col("tp_bp") / F.col("gold_bp")).withColumn("accuracy_seq", F.col("tp_seqs") / F.col("gold_seqs"))
    return out.withColumn("f1_avg_bp", G.f1(F.col("precision_avg_bp"), F.col("recall_avg_bp"))).drop("tp_bp", "tp_seqs", "gold_bp", "gold_seqs")


def recovered_grid(precision: DataFrame, recall: DataFrame, comps: list[float], conts: list[float]) -> DataFrame:
    """(min_comp, max_cont, genomes): bins whose genome is recovered over min_comp at contamination under max_cont."""
    both = precision.join(recall.select("genome", "bin", "recall_bp"), ["genome", "bin"], "left")
    cells = [(c, k) for c in comps for k in conts]
    counts = both.agg(*[F.count_if((F.col("recall_bp") > c) & (F.col("precision_bp") > 1 - k)).alias(f"n{i}") for i, (c, k) in enumerate(cells)])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("min_comp"), F.lit(k).alias("max_cont"), F.col(f"n{i}").alias("genomes")) for i, (c, k) in enumerate(cells)]))
    return counts.select(rows.alias("r")).select("r.*")


def count_prf(df: DataFrame, bin_: str, label: str) -> DataFrame:
    """One row: precision and recall by counts of the best label of each bin and the best bin of each label, and F1."""
    c = df.groupBy(F.col(bin_).alias("b"), F.col(label).alias("l")).agg(F.count(F.lit(1)).alias("n"))
    p = c.groupBy("b").agg(F.max("n").alias("m"), F.sum("n").alias("t")).agg((F.sum("m") / F.sum("t")).alias("precision"))
    r = c.groupBy("l").agg(F.max("n").alias("m"), F.sum("n").alias("t")).agg((F.sum("m") / F.sum("t")).alias("recall"))
    return p.crossJoin(F.broadcast(r)).withColumn("f1", G.f1(F.col("precision"), F.col("recall")))  # a single row each


def adjusted_rand(df: DataFrame, bin_: str, label: str) -> DataFrame:
    c = df.groupBy(F.col(bin_).alias("b"), F.col(label).alias("l")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    pairs = lambda *by: (c.groupBy(*by).agg(F.sum("n").alias("n")) if len(by) < 2 else c).agg(F.sum(G.choose2(F.col("n"))).alias("s" + "".join(by)))
    out = pairs("b", "l").crossJoin(F.broadcast(pairs("b"))).crossJoin(F.broadcast(pairs("l"))).crossJoin(F.broadcast(c.agg(F.sum("n").alias("n"))))  # single rows
    expected = F.col("sb") * F.col("sl") / G.choose2(F.col("n"))
    return out.select(((F.col("sbl") - expected) / ((F.col("sb") + F.col("sl")) / 2 - expected)).alias("ari"))


def majority_prf(df: DataFrame, bin_: str, label: str, length: str) -> DataFrame:
    """One row: macro precision, recall and F1 by bp of each bin's majority label, and bins of recall .9 and precision .95."""
    c = df.groupBy(F.col(bin_).alias("b"), F.col(label).alias("l")).agg(F.sum(length).alias("bp"))
    c = c.withColumn("bin_bp", F.sum("bp").over(Window.partitionBy("b"))).withColumn("label_bp", F.sum("bp").over(Window.partitionBy("l")))
    best = best_by(c, ["b"], "bp", "l").select((F.col("bp") / F.col("bin_bp")).alias("p"), (F.col("bp") / F.col("label_bp")).alias("r"))
    return best.agg(F.avg("p").alias("precision"), F.avg("r").alias("recall"), F.avg(G.f1(F.col("p"), F.col("r"))).alias("f1"), F.count_if((F.col("r") >= 0.9) & (F.col("p") >= 0.95)).alias("good_bins"))


def positive_pairs(bins: DataFrame, contig: str, per_bin: int | None = None, seed: int = 0) -> DataFrame:
    """(i, j), i < j, of one bin; with per_bin, that many of each by hash.

    A pair is made in the least bin that both ends are in, so none needs to be removed later; a bin's contigs are dealt to
    blocks of about PAIR_BLOCK, each of which meets the whole bin in a task of its own."""
    if per_bin is not None:
        a, b = bins.select("bin", F.col(contig).alias("i")), bins.select("bin", F.col(contig).alias("j"))
        w = Window.partitionBy("bin").orderBy(F.xxhash64("i", "j", F.lit(seed)))
        out = a.join(b, "bin").where("i < j").withColumn("k", F.row_number().over(w)).where(F.col("k") <= per_bin)
        return out.select("i", "j").distinct()
    held = bins.select(F.col(contig).alias("i"), "bin").where("i is not null and bin is not null").distinct()
    sizes = held.groupBy("bin").agg(F.ceil(F.count(F.lit(1)) / PAIR_BLOCK).cast("int").alias("blocks"))
    every = held.groupBy("i").agg(F.collect_set("bin").alias("bins"))
    rows = held.join(every, "i").join(sizes, "bin")
    a = rows.select("bin", F.pmod(F.xxhash64("i"), F.col("blocks")).cast("int").alias("block"), "i", F.col("bins").alias("x"))
    b = rows.select("bin", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("i").alias("j"), F.col("bins").alias("y"))
    least = (F.size("x") == 1) | (F.size("y") == 1) | (F.array_min(F.array_intersect("x", "y")) == F.col("bin"))
    return a.join(b, ["bin", "block"]).where(F.col("i") < F.col("j")).where(least).select("i", "j")


def bin_sizes(bins: DataFrame, lengths: DataFrame, contig: str, length: str, min_bp: int) -> DataFrame:
    return bins.join(lengths, contig).groupBy("bin").agg(F.sum(length).alias("bp"), F.count(F.lit(1)).alias("contigs")).where(F.col("bp") >= min_bp)


def bin_composition(bins: DataFrame, label: str) -> DataFrame:
    return bins.groupBy("bin", label).agg(F.count(F.lit(1)).alias("n"))


def marker_contigs(genes: DataFrame, markers: DataFrame, gene: str, contig: str) -> DataFrame:
    """(gene, contigs): the sorted contigs of each reference gene; a gene that none has keeps an empty list."""
    have = markers.groupBy(gene).agg(F.array_sort(F.collect_set(contig)).alias("contigs"))
    kind = have.schema["contigs"].dataType
    return genes.select(gene).distinct().join(have, gene, "left").select(gene, F.coalesce("contigs", F.array().cast(kind)).alias("contigs"))


def first_rows(gold: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key in file order."""
    w = Window.partitionBy(key).orderBy(order)
    return gold.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")


def assigned_share(assigned: DataFrame, gold: DataFrame, key: str, length: str) -> DataFrame:
    """One row: the share of the gold standard's base pairs and sequences that are in some bin."""
    both = gold.join(assigned.select(key).distinct().withColumn("__in", F.lit(True)), key, "left")
    share = lambda x: F.sum(F.when(F.col("__in"), x).otherwise(0)) / F.sum(x)
    return both.agg(share(F.col(length)).alias("share_bp"), share(F.lit(1)).alias("share_seq"))


def average_pr(df: DataFrame, bin_: str, label: str) -> DataFrame:
    """One row: the mean share of each bin's majority label, and the mean share of each label in its best bin."""
    c = df.groupBy(F.col(bin_).alias("b"), F.col(label).alias("l")).agg(F.count(F.lit(1)).alias("n"))
    share = lambda by, out: c.groupBy(by).agg((F.max("n") / F.sum("n")).alias("x")).agg(F.avg("x").alias(out))
    return share("b", "avg_precision").crossJoin(F.broadcast(share("l", "avg_recall")))  # a single row each


def reads_by_species(reads: DataFrame, contig: str, read: str) -> DataFrame:
    """(contig, species, reads): what is before `_reads` in a read's name is its species."""
    return reads.groupBy(contig, G.species_of_read(F.col(read)).alias("species")).agg(F.count(F.lit(1)).alias("reads"))


def marker_matrix(markers: DataFrame, contig: str, gene: str, genes: list) -> DataFrame:
    """A row for each contig and a column of counts for each of the reference genes."""
    return markers.groupBy(contig).pivot(gene, genes).agg(F.count(F.lit(1))).na.fill(0)
