"""Readers of assembly files: FASTA, GFA, depths, labels, markers, bins, embeddings. Text in, typed columns out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from binloom.functions import contig_name
from binloom.sources.arrays import read_matrix, read_pickled_vectors


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).where(F.length(F.trim("value")) > 0)


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """Lines with an increasing number in file order."""
    return _lines(spark, path).withColumn("ord", F.monotonically_increasing_id())


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(idx, name, seq, length): records split at `>` lines; idx is the place in the file, from 0."""
    raw = spark.read.option("lineSep", "\n>").text(path).withColumn("ord", F.monotonically_increasing_id())
    text = F.regexp_replace("value", r"^>", "")
    cut = F.instr(text, "\n")
    head = F.when(cut > 0, F.substr(text, F.lit(1), cut - 1)).otherwise(text)
    body = F.when(cut > 0, F.regexp_replace(F.substr(text, cut + 1), r"\s", "")).otherwise("")
    out = raw.select("ord", contig_name(head).alias("name"), body.alias("seq")).where("name <> ''")
    return _positions(out).select("idx", "name", "seq", F.length("seq").cast("long").alias("length"))


def _positions(df: DataFrame) -> DataFrame:
    """idx = 0, 1, 2 ... by ord: numbered within a partition of the file, plus the rows of the partitions before."""
    df = df.withColumn("part", F.shiftright("ord", 33))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = df.groupBy("part").agg(F.count(F.lit(1)).alias("n")).withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inside = F.row_number().over(Window.partitionBy("part").orderBy("ord")) - 1
    return df.withColumn("inside", inside).join(starts, "part").withColumn("idx", F.col("start") + F.col("inside"))


def read_gfa_segments(spark: SparkSession, path: str) -> DataFrame:
    c = F.split("value", r"\s+")
    return _numbered(spark, path).where("value rlike '^S\\\\s'").select("ord", contig_name(c[1]).alias("name"))


def read_gfa_links(spark: SparkSession, path: str) -> DataFrame:
    """(ord, src, dst, raw_src, raw_dst, weight): weight is the last `:` field of the seventh column, else 1."""
    c = F.split(F.trim("value"), r"\s+")
    weight = F.when(F.size(c) > 6, F.element_at(F.split(F.get(c, F.lit(6)), ":"), -1).try_cast("long"))
    return _numbered(spark, path).where("value rlike '^L\\\\s'").select("ord", contig_name(c[1]).alias("src"), contig_name(c[3]).alias("dst"), c[1].alias("raw_src"), c[3].alias("raw_dst"), F.coalesce(weight, F.lit(1).cast("long")).alias("weight"))


def read_gfa_paths(spark: SparkSession, path: str) -> DataFrame:
    """(path, pos, segment) of the P lines; the sign at a segment's end is dropped."""
    c = F.split("value", r"\s+")
    rows = _lines(spark, path).where("value rlike '^P\\\\s'").select(c[1].alias("path"), F.posexplode(F.split(c[2], ",")).alias("pos", "s"))
    return rows.select("path", "pos", F.expr("substr(s, 1, length(s) - 1)").alias("segment"))


def read_depths(spark: SparkSession, path: str) -> DataFrame:
    """(name, sample, depth): columns from the fourth on whose header does not contain -var."""
    header = spark.read.text(path).first()
    names = header[0].split("\t") if header else []
    keep = [i for i, n in enumerate(names) if i >= 3 and "-var" not in n]
    c = F.split(F.trim("value"), r"\s+")
    rows = _lines(spark, path).where(F.col("value") != (header[0] if header else ""))
    values = F.posexplode(F.array(*[c[i].cast("double") for i in keep])) if keep else F.posexplode(F.array().cast("array<double>"))
    return rows.select(contig_name(c[0]).alias("name"), values.alias("sample", "depth"))


def align_depths(contigs: DataFrame, depths: DataFrame, samples: int) -> DataFrame:
    """Every contig and sample; missing depths are 0, unknown contigs are left out."""
    every = contigs.select("name", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("sample"))
    return every.join(depths, ["name", "sample"], "left").select("name", "sample", F.coalesce("depth", F.lit(0.0)).alias("depth"))


def read_assembly_info(spark: SparkSession, path: str) -> DataFrame:
    c = F.split("value", "\t")
    rows = _lines(spark, path).where(~F.col("value").startswith("#")).where(c[1].try_cast("long").isNotNull())
    edges = F.transform(F.filter(F.split(F.element_at(c, -1), ","), lambda x: F.trim(x) != "*"), lambda x: F.concat(F.lit("edge_"), F.regexp_replace(F.trim(x), "-", "")))
    size = c[1].cast("long")
    return rows.select(c[0].alias("name"), size.alias("length"), ((c[3] == "Y") & (size > 100000)).alias("circular"), (c[4] == "Y").alias("repeat"), c[5].cast("int").alias("mult"), edges.alias("path"))


def read_labels(spark: SparkSession, path: str, contigs: DataFrame | None = None) -> DataFrame:
    """(name, label) of a csv (node,label) or a tsv; @ and # lines are skipped, a node's last row counts, NA if none."""
    c = F.split("value", "," if path.endswith(".csv") else "\t")
    rows = _numbered(spark, path).where("not value rlike '^[@#]'").select("ord", contig_name(c[0]).alias("name"), F.trim(c[1]).alias("label"))
    last = rows.groupBy("name").agg(F.max(F.struct("ord", "label"))["label"].alias("label"))
    if contigs is None:
        return last
    return contigs.select("name").join(last, "name", "left").select("name", F.coalesce("label", F.lit("NA")).alias("label"))


def parse_marker_map(text) -> F.Column:
    """A Python or JSON literal {orf: {gene: [hits]}} as a map."""
    return F.from_json(F.replace(text, F.lit("'"), F.lit('"')), "map<string,map<string,array<string>>>")


def read_marker_stats(spark: SparkSession, path: str) -> DataFrame:
    """(name, gene, copies): copies is the number of a contig's ORFs with the gene; a contig's last row counts."""
    c = F.split("value", "\t", 2)
    rows = _numbered(spark, path).select("ord", contig_name(c[0]).alias("name"), parse_marker_map(c[1]).alias("m"))
    last = rows.groupBy("name").agg(F.max("ord").alias("ord")).join(rows, ["name", "ord"])
    return last.select("name", F.explode("m").alias("orf", "genes")).select("name", F.explode(F.map_keys("genes")).alias("gene")).groupBy("name", "gene").agg(F.count(F.lit(1)).cast("int").alias("copies"))


def read_marker_sets(spark: SparkSession, path: str) -> DataFrame:
    """(set_id, gene) from the second line's last field, a list of sets."""
    line = _numbered(spark, path).orderBy("ord").limit(2).orderBy(F.desc("ord")).limit(1)
    sets = F.regexp_extract_all(F.element_at(F.split("value", "\t"), -1), F.lit(r"(?:set\(\[|\{)([^\]\}]*)[\]\}]"), F.lit(1))
    rows = line.select(F.posexplode(sets).alias("set_id", "s"))
    return rows.select("set_id", F.explode(F.regexp_extract_all("s", F.lit(r"['\"]([^'\"]+)['\"]"), F.lit(1))).alias("gene"))


def read_gtdb_labels(spark: SparkSession, path: str) -> DataFrame:
    c = F.split("value", "\t")
    species = F.element_at(F.split(c[1], ";"), -1)
    return _lines(spark, path).where(~c[0].isin("user_genome", "name") & ~c[1].startswith("Unclassified")).where(species != "s__").select(contig_name(c[0]).alias("name"), species.alias("label"))


def read_gtdb_markers(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(name, gene, copies = 1) of unique genes, and the reference genes (unique and missing ones of all contigs)."""
    c = F.split("value", "\t")
    rows = _lines(spark, path).where(c[1].try_cast("int").isNotNull()).select(contig_name(c[0]).alias("name"), F.split(c[5], ",").alias("have"), F.split(F.element_at(c, -1), ",").alias("miss"))
    found = rows.select("name", F.explode("have").alias("gene")).where("gene <> ''").withColumn("copies", F.lit(1))
    genes = rows.select(F.explode(F.concat("have", "miss")).alias("gene")).where("gene <> ''").distinct()
    return found, genes.select(F.lit(0).alias("set_id"), "gene")


def read_embeddings(spark: SparkSession, path: str, contigs: DataFrame | None = None, seed: int = 0) -> DataFrame:
    """(name, emb) of text rows or of a pickled dict (.pickle, .pkl); missing contigs get values in [1e-4, 1) from a hash of
    name, place and seed."""
    c = F.split(F.trim("value"), r"\s+")
    if path.endswith((".pickle", ".pkl")):
        rows = read_pickled_vectors(spark, path)
    else:
        rows = _lines(spark, path).select(c[0].alias("name"), F.transform(F.slice(c, 2, F.greatest(F.size(c) - 1, F.lit(0))), lambda x: x.cast("double")).alias("emb"))
    if contigs is None:
        return rows
    width = rows.agg(F.max(F.size("emb")).alias("w"))
    u = F.transform(F.sequence(F.lit(1), F.col("w")), lambda i: 1e-4 + (1 - 1e-4) * F.pmod(F.xxhash64(F.col("name"), i, F.lit(seed)), F.lit(1 << 30)) / float(1 << 30))
    return contigs.select("name").join(rows, "name", "left").crossJoin(F.broadcast(width)).select("name", F.coalesce("emb", u).alias("emb"))  # a single row


def read_bins(spark: SparkSession, path: str) -> DataFrame:
    """(name, bin, length): AMBER or plain files; lines from @ or # are skipped, and no other is."""
    c = F.split(F.trim("value"), r"\s+")
    return _lines(spark, path).where("not value rlike '^[@#]'").select(contig_name(c[0]).alias("name"), c[1].alias("bin"), F.get(c, F.lit(2)).try_cast("long").alias("length"))


def read_depths_npz(spark: SparkSession, path: str, contigs: DataFrame) -> DataFrame:
    """(name, sample, depth) of a matrix whose rows follow the contigs' order, read by ranges of rows."""
    long = read_matrix(spark, path).select("idx", F.posexplode("row").alias("sample", "depth"))
    return contigs.select("idx", "name").join(long, "idx").select("name", "sample", "depth")


def paths_or_fallback(paths: DataFrame, info: DataFrame) -> DataFrame:
    """(path, pos, segment) of the graph file's P lines; if it has none, of the paths in assembly_info."""
    if not paths.isEmpty():
        return paths.select("path", "pos", "segment")
    steps = info.select(F.col("name").alias("path"), F.posexplode("path").alias("pos", "segment"))
    return steps.where("segment <> '*' and segment <> ''")
