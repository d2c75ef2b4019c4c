"""Queries of the operators over the driver's generic tables, each beside its SQL.

Roles: contig = part or supplier, gene = part, bin = p_size or nation, genome = p_brand, length = price in cents, graph =
parts of one order, embedding = embeddings, sequence = documents.text with letters mapped to ACGT.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from binloom import functions as G
from binloom.operators import cluster, density_order, features, gnn, graph, medoids, metrics, models, partitions, similarity, stats, training
from binloom.operators.blocks import Blocks
from binloom.sources import sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


class Tables:
    """The driver's tables by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")


def query(sql: str | None = None):
    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def r6(*names: str) -> list[Column]:
    return [F.round(F.col(n), 6).alias(n) for n in names]


# Bins of parts: length in cents, bin = size, genome = brand.
PARTS = "p as (select p_partkey, p_size as bin, p_brand as genome, cast(round(p_retailprice*100) as bigint) as len from part)"
CONF = PARTS + ", c as (select bin, genome, sum(len)::bigint bp, count(*) seqs from p group by all)"
PREC = CONF + ", pr as (select *, bp/bin_bp precision_bp, seqs/bin_seqs precision_seq from (select *, sum(bp) over (partition by bin) bin_bp, sum(seqs) over (partition by bin) bin_seqs, row_number() over (partition by bin order by bp desc, genome) k from c) where k=1)"
REC = PREC + ", rc as (select *, bp/genome_bp recall_bp, seqs/genome_seqs recall_seq from (select *, sum(bp) over (partition by genome) genome_bp, sum(seqs) over (partition by genome) genome_seqs, row_number() over (partition by genome order by bp desc, bin) k from c) where k=1)"


def _parts(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.col("p_size").alias("bin"), F.col("p_brand").alias("genome"), F.round(F.col("p_retailprice") * 100).cast("long").alias("len"))


def _scored(t: Tables) -> tuple[DataFrame, DataFrame]:
    p = _parts(t)
    c = metrics.confusion(p, "bin", "genome", "len")
    return metrics.bin_precision(c), metrics.genome_recall(c, p, "genome", "len")


@query("with " + PREC + " select bin, genome, round(precision_bp,6) precision_bp, round(precision_seq,6) precision_seq from pr")
def amber_precision(t: Tables) -> DataFrame:
    return _scored(t)[0].select("bin", "genome", *r6("precision_bp", "precision_seq"))


@query("with " + REC + " select genome, bin, round(recall_bp,6) recall_bp, round(recall_seq,6) recall_seq from rc")
def amber_recall(t: Tables) -> DataFrame:
    return _scored(t)[1].select("genome", "bin", *r6("recall_bp", "recall_seq"))


_SUMMARY = ["precision_avg_bp", "precision_sem_bp", "precision_var_bp", "precision_avg_seq", "precision_weighted_bp", "recall_avg_bp", "recall_sem_bp", "recall_var_bp", "recall_avg_seq", "recall_weighted_bp", "accuracy_bp", "accuracy_seq", "f1_avg_bp"]


@query("with " + REC + """, a as (select avg(precision_bp) precision_avg_bp, stddev_samp(precision_bp)/sqrt(count(*)) precision_sem_bp, var_samp(precision_bp) precision_var_bp, avg(precision_seq) precision_avg_seq, sum(bp)/sum(bin_bp) precision_weighted_bp, sum(bp) tb, sum(seqs) ts from pr),
b as (select avg(recall_bp) recall_avg_bp, stddev_samp(recall_bp)/sqrt(count(*)) recall_sem_bp, var_samp(recall_bp) recall_var_bp, avg(recall_seq) recall_avg_seq, sum(bp)/sum(genome_bp) recall_weighted_bp, sum(genome_bp) gb, sum(genome_seqs) gs from rc),
s as (select *, tb/gb accuracy_bp, ts/gs accuracy_seq, 2*precision_avg_bp*recall_avg_bp/(precision_avg_bp+recall_avg_bp) f1_avg_bp from a, b)
select """ + ", ".join(f"round({c},6) {c}" for c in _SUMMARY) + " from s")  # fmt: skip
def amber_summary(t: Tables) -> DataFrame:
    return metrics.summary(*_scored(t)).select(*r6(*_SUMMARY))


@query("with " + REC + ", j as (select pr.precision_bp, rc.recall_bp from pr left join rc on pr.genome=rc.genome and pr.bin=rc.bin), g as (select * from (values (0.9),(0.5)) a(min_comp), (values (0.05),(0.1)) b(max_cont)) select min_comp::double min_comp, max_cont::double max_cont, (select count(*) from j where recall_bp > min_comp and precision_bp > 1-max_cont) genomes from g")
def recovered_grid(t: Tables) -> DataFrame:
    return metrics.recovered_grid(*_scored(t), [0.9, 0.5], [0.05, 0.1])


@query("""with c as (select c_nationkey b, c_mktsegment l, count(*) n from customer group by all), p as (select sum(m)/sum(t) x from (select max(n) m, sum(n) t from c group by b)), r as (select sum(m)/sum(t) x from (select max(n) m, sum(n) t from c group by l))
select round(p.x,6) "precision", round(r.x,6) recall, round(2*p.x*r.x/(p.x+r.x),6) f1 from p, r""")
def count_prf(t: Tables) -> DataFrame:
    return metrics.count_prf(t.customer, "c_nationkey", "c_mktsegment").select(*r6("precision", "recall", "f1"))


@query("""with c as (select c_nationkey b, c_mktsegment l, count(*)::double n from customer group by all), s as (select (select sum(n*(n-1)/2) from c) x, (select sum(n*(n-1)/2) from (select sum(n) n from c group by b)) y, (select sum(n*(n-1)/2) from (select sum(n) n from c group by l)) z, (select sum(n)*(sum(n)-1)/2 from c) w)
select round((x - y*z/w)/((y+z)/2 - y*z/w), 6) ari from s""")
def adjusted_rand(t: Tables) -> DataFrame:
    return metrics.adjusted_rand(t.customer, "c_nationkey", "c_mktsegment").select(*r6("ari"))


@query("""with x as (select c_nationkey b, c_mktsegment l, sum(round(c_acctbal)::bigint)::bigint bp from customer where round(c_acctbal) > 0 group by all), y as (select *, sum(bp) over (partition by b) bb, sum(bp) over (partition by l) lb, row_number() over (partition by b order by bp desc, l) k from x), z as (select bp/bb p, bp/lb r from y where k=1)
select round(avg(p),6) "precision", round(avg(r),6) recall, round(avg(2*p*r/(p+r)),6) f1, count(*) filter (where r>=0.9 and p>=0.95) good_bins from z""")
def majority_prf(t: Tables) -> DataFrame:
    c = t.customer.withColumn("len", F.round("c_acctbal").cast("long")).where("len > 0")
    return metrics.majority_prf(c, "c_nationkey", "c_mktsegment", "len").select(*r6("precision", "recall", "f1"), "good_bins")


# Markers: gene = brand's parts, sets = brands over types; bin = nation of the supplier, copies = line items.
MARK = """m as (select l_suppkey contig, l_partkey gene, count(*) copies from lineitem group by all), b as (select s_suppkey contig, s_nationkey bin from supplier),
t as (select bin, gene, sum(copies)::bigint copies from m join b using (contig) group by all), z as (select p_brand set_id, p_partkey gene, count(*) over (partition by p_brand) size from part),
n as (select count(distinct set_id) n from z), sc as (select q.bin, 100*coalesce(f,0)/n.n comp, 100*coalesce(e,0)/n.n cont from (select distinct bin from t) q left join (select bin, sum(1/size) f, sum((copies-1)/size) e from t join z using (gene) group by bin) g using (bin), n)"""


def _markers(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    m = t.lineitem.groupBy(F.col("l_suppkey").alias("contig"), F.col("l_partkey").alias("gene")).agg(F.count(F.lit(1)).alias("copies"))
    bins = t.supplier.select(F.col("s_suppkey").alias("contig"), F.col("s_nationkey").alias("bin"))
    return m, bins, t.part.select(F.col("p_brand").alias("set_id"), F.col("p_partkey").alias("gene"))


def _scores(t: Tables) -> DataFrame:
    m, bins, sets = _markers(t)
    return metrics.marker_scores(metrics.gene_totals(m, bins, "contig"), sets)


@query("with " + MARK + " select bin, round(comp,6) comp, round(cont,6) cont from sc")
def marker_completeness(t: Tables) -> DataFrame:
    return _scores(t).select("bin", *r6("comp", "cont"))


@query("with " + MARK + " select count(*) bins, count(*) filter (where comp>=70 and cont<60) hq, count(*) filter (where comp>=60 and cont<70) mq, round(avg(comp) filter (where comp>=70 and cont<60),6) hq_comp, round(avg(cont) filter (where comp>=70 and cont<60),6) hq_cont from sc")
def hq_bins(t: Tables) -> DataFrame:
    return metrics.quality_counts(_scores(t), (70, 60), (60, 70)).select("bins", "hq", "mq", *r6("hq_comp", "hq_cont"))


@query("with " + MARK + """, lf as (select distinct contig from b where bin not in (select bin from sc where comp>=70 and cont<60)), pool as (select gene, sum(copies) copies from m join lf using (contig) group by gene)
select (select count(*) from lf) contigs, (select count(*) from lf where contig in (select contig from m)) with_markers, (select coalesce(floor(100*sum((copies-1)/size)/any_value(n.n)/100),0)::bigint from pool join z using (gene), n) genomes""")
def unresolved_pool(t: Tables) -> DataFrame:
    m, bins, sets = _markers(t)
    return metrics.unresolved(bins, m, _scores(t), sets, "contig", (70, 60))


@query("with " + MARK + " select round(avg(comp),6) avg_comp, round(avg(cont),6) avg_cont, round(coalesce(avg(cont) filter (where comp>50),0),6) cont_50, round(coalesce(avg(cont) filter (where comp>90),0),6) cont_90, round(coalesce(avg(comp) filter (where cont<5),0),6) comp_5 from sc")
def bin_extra_metrics(t: Tables) -> DataFrame:
    return metrics.extra_metrics(_scores(t)).select(*r6("avg_comp", "avg_cont", "cont_50", "cont_90", "comp_5"))


@query("""with c as (select p_partkey, coalesce(n,0) n from part left join (select l_partkey p_partkey, count(*) n from lineitem group by 1) using (p_partkey)), q as (select quantile_cont(n,0.75) p75 from c)
select round(p75,6) p75, (select count(distinct n) from c where n>=p75) candidates, (select min(n) from c where n>=p75) k_min, (select max(n) from c) k_max from q""")
def genome_count_estimate(t: Tables) -> DataFrame:
    genes = t.part.select(F.col("p_partkey").alias("gene"))
    copies = t.lineitem.select(F.col("l_partkey").alias("gene"), F.lit(1).alias("n"))
    return stats.genome_count_estimate(genes, copies, "gene", "n").select(*r6("p75"), "candidates", "k_min", "k_max")


SUPP = "s as (select distinct l_suppkey c, l_partkey g from lineitem)"


def _supplier_parts(t: Tables) -> DataFrame:
    return t.lineitem.select(F.col("l_suppkey").alias("c"), F.col("l_partkey").alias("g"))


@query("with " + SUPP + " select distinct a.c i, b.c j from s a join s b on a.g=b.g and a.c<b.c")
def must_differ_pairs(t: Tables) -> DataFrame:
    return graph.must_differ_pairs(_supplier_parts(t), "c", "g")


# The graph of parts that share an order.
EDGE = "o as (select distinct l_orderkey k, l_partkey n from lineitem), e as (select a.n src, b.n dst, count(*) weight from o a join o b on a.k=b.k and a.n<>b.n group by all)"
NORM = EDGE + ", a as (select src, dst, weight::double w from e union all select distinct src, src, 1.0 from e), d as (select src, sum(w) d from a group by src), na as (select a.src, a.dst, a.w/sqrt(x.d*y.d) norm from a join d x on a.src=x.src join d y on a.dst=y.src)"


def _edges(t: Tables, once: bool = False, by_source: bool = False) -> DataFrame:
    return graph.shared_member_edges(t.lineitem.select(F.col("l_partkey").alias("n"), F.col("l_orderkey").alias("k")), "n", "k", once, by_source=by_source)


def _blocks(t: Tables) -> Blocks:
    """The same edges, normalised, as blocks."""
    return Blocks(graph.shared_member_edges(t.lineitem.select(F.col("l_partkey").alias("n"), F.col("l_orderkey").alias("k")), "n", "k", once=True, ordered=True))


def _marked(t: Tables, **more) -> DataFrame:
    """Each edge once with the number of suppliers that both parts have."""
    pairs, marks = t.lineitem.select(F.col("l_partkey").alias("n"), F.col("l_orderkey").alias("k")), t.lineitem.select(F.col("l_partkey").alias("n"), F.col("l_suppkey").alias("g"))
    return graph.marked_member_edges(pairs, "n", "k", marks, "n", "g", **more)


@query("with " + EDGE + " select * from e")
def order_graph_edges(t: Tables) -> DataFrame:
    return _edges(t)


@query("with " + EDGE + ", m as (select distinct l_partkey n, l_suppkey g from lineitem) select e.src, e.dst, count(*) overlap from e join m x on e.src=x.n join m y on e.dst=y.n and x.g=y.g group by all")
def same_marker_edges(t: Tables) -> DataFrame:
    return graph.mirrored(_marked(t).where("overlap > 0").select("src", "dst", "overlap"))


@query("with " + EDGE + ", m as (select distinct l_partkey n, l_suppkey g from lineitem) select src, dst, weight from e where not exists (select 1 from m x join m y using (g) where x.n=e.src and y.n=e.dst)")
def edges_cleaned(t: Tables) -> DataFrame:
    return graph.mirrored(_marked(t).where("overlap = 0").select("src", "dst", "weight"))


@query("with s as (select distinct l_partkey contig, l_orderkey segment from lineitem), l as (select o_orderkey a, o_orderkey+1 b from orders), u as (select a,b from l union select b,a from l) select src, dst, count(*) n from (select x.contig src, y.contig dst from s x join s y on x.segment=y.segment and x.contig<>y.contig union all select x.contig, y.contig from s x join u on x.segment=u.a join s y on y.segment=u.b) group by all")
def contig_segment_graph(t: Tables) -> DataFrame:
    s = t.lineitem.select(F.col("l_partkey").alias("contig"), F.col("l_orderkey").alias("segment"))
    links = t.orders.select(F.col("o_orderkey").alias("a"), (F.col("o_orderkey") + 1).alias("b"))
    return graph.contig_segment_counts(s, links)


@query("select p_partkey src, coalesce(lead(p_partkey) over w, first_value(p_partkey) over w) dst from part window w as (partition by p_brand order by p_partkey)")
def label_ring(t: Tables) -> DataFrame:
    return graph.label_ring(t.part, "p_partkey", "p_brand")


@query("with " + EDGE + ", x as (select a.p_brand p, b.p_brand q from e join part a on e.src=a.p_partkey join part b on e.dst=b.p_partkey) select count(*) labelled, count(*) filter (where p=q) same, round(count(*) filter (where p=q)/count(*),6) share from x")
def graph_homophily(t: Tables) -> DataFrame:
    return graph.homophily(_edges(t), t.part, "p_partkey", "p_brand").select("labelled", "same", *r6("share"))


@query("with " + NORM + " select src, dst, round(norm,6) norm from na")
def adjacency_norm(t: Tables) -> DataFrame:
    return graph.normalised_adjacency(_edges(t, once=True), once=True).select("src", "dst", *r6("norm"))


@query("with " + NORM + ", tp as (select max(weight) m from e) select na.src, na.dst, round(case when na.src=na.dst then 1.0 else coalesce(norm*weight/m, norm) end,6) \"value\" from na left join e on na.src=e.src and na.dst=e.dst, tp")
def adjacency_weighted(t: Tables) -> DataFrame:
    return graph.weighted_adjacency(_edges(t, once=True), once=True).select("src", "dst", *r6("value"))


@query("with " + NORM + " select na.src, round(sum(norm*p_retailprice),4) price, round(sum(norm*p_size),4) size from na join part on p_partkey=dst group by na.src")
def gcn_propagate(t: Tables) -> DataFrame:
    x = t.part.select("p_partkey", F.col("p_retailprice").alias("price"), F.col("p_size").alias("size"))
    out = graph.propagate(graph.normalised_adjacency(_edges(t, once=True), once=True, dealt=True), x, "norm", ["price", "size"], "p_partkey")
    return out.select("src", F.round("price", 4).alias("price"), F.round("size", 4).alias("size"))


@query("with " + EDGE + ", f as (select src, dst, case when weight*(a.p_size/50.0-b.p_size/25.0)>=0 then weight*(a.p_size/50.0-b.p_size/25.0) else 0.2*weight*(a.p_size/50.0-b.p_size/25.0) end x from e join part a on src=a.p_partkey join part b on dst=b.p_partkey), g as (select *, exp(x - max(x) over (partition by src)) y from f) select src, dst, round(y/sum(y) over (partition by src),6) alpha from g")
def attention_weights(t: Tables) -> DataFrame:
    s = t.part.select("p_partkey", (F.col("p_size") / 50.0).alias("l"), (-F.col("p_size") / 25.0).alias("r"))
    return graph.attention(_edges(t), s, "p_partkey", "l", "r").select("src", "dst", *r6("alpha"))


@query("with " + EDGE + " select src, dst, 1 weight from e where weight >= (select quantile_cont(weight,0.9) from e)")
def edge_binarise(t: Tables) -> DataFrame:
    return graph.binarise(_edges(t))


# Customers and suppliers linked to their nation, nodes of one name space.
STARS = "e as (select 'c'||c_custkey src, 'n'||c_nationkey dst from customer union all select 's'||s_suppkey, 'n'||s_nationkey from supplier), u as (select src, dst from e union select dst, src from e), r as (select src node, src m from u union select r.node, u.dst from r join u on r.m=u.src), c as (select node, min(m) component from r group by node)"


def _components(t: Tables) -> DataFrame:
    link = lambda df, letter, key, nation: df.select(F.concat(F.lit(letter), key).alias("src"), F.concat(F.lit("n"), nation).alias("dst"))
    return graph.components(link(t.customer, "c", "c_custkey", "c_nationkey").unionByName(link(t.supplier, "s", "s_suppkey", "s_nationkey")))


@query("with recursive " + STARS + " select node, component from c")
def connected_components(t: Tables) -> DataFrame:
    return _components(t)


DEPTH = "d as (select l_partkey name, l_returnflag||l_linestatus sample, sum(l_quantity) depth from lineitem group by all)"


def _depths(t: Tables) -> DataFrame:
    return t.lineitem.groupBy(F.col("l_partkey").alias("name"), F.concat("l_returnflag", "l_linestatus").alias("sample")).agg(F.sum("l_quantity").alias("depth"))


_SAMPLES = ["AF", "NF", "NO", "RF"]


@query("with " + DEPTH + " select name, " + ", ".join(f"coalesce(sum(depth) filter (where sample='{s}'),0) \"{s}\"" for s in _SAMPLES) + " from d group by name")
def depth_matrix(t: Tables) -> DataFrame:
    return _depths(t).groupBy("name").pivot("sample", _SAMPLES).agg(F.sum("depth")).na.fill(0.0)


@query("with " + DEPTH + " select name, sample, round(depth/(sum(depth) over (partition by name)+1e-10),6) share from d")
def depth_normalised(t: Tables) -> DataFrame:
    return features.normalise_rows(_depths(t), "name", "depth", "share").select("name", "sample", *r6("share"))


@query("with s as (select avg(p_retailprice) a, stddev_pop(p_retailprice) b, avg(p_size) c, stddev_pop(p_size) d from part) select p_partkey, round((p_retailprice-a)/b,6) p_retailprice, round((p_size-c)/d,6) p_size from part, s")
def zscore_features(t: Tables) -> DataFrame:
    z = features.zscore(t.part.select("p_partkey", "p_retailprice", F.col("p_size").cast("double").alias("p_size")), ["p_retailprice", "p_size"])
    return z.select("p_partkey", *r6("p_retailprice", "p_size"))


_LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BASES = ("ACGT" * 13)[:52]
KMER = f"s as (select doc_id, translate(text, '{_LETTERS}', '{_BASES}') q from documents), k as (select doc_id, substr(q, i, 4) kmer from s, unnest(range(1, length(q)-2)) u(i)), kc as (select doc_id, kmer, count(*) n from k where regexp_full_match(kmer, '[ACGT]{{4}}') group by all)"


def _sequences(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.translate("text", _LETTERS, _BASES).alias("seq"))


@query("with " + KMER + " select * from kc")
def kmer_counts(t: Tables) -> DataFrame:
    return features.kmer_counts(_sequences(t), "doc_id", "seq")


@query("with " + KMER + " select doc_id, least(kmer, translate(reverse(kmer),'ACGT','TGCA')) kmer, sum(n)::bigint n from kc group by all")
def kmer_canonical(t: Tables) -> DataFrame:
    return features.kmer_counts(_sequences(t), "doc_id", "seq", canonical=True)


@query("with " + KMER + ", b(x) as (values ('A'),('C'),('G'),('T')), v as (select b1.x||b2.x||b3.x||b4.x kmer from b b1, b b2, b b3, b b4), tt as (select doc_id, sum(n) total from kc group by 1) select tt.doc_id, v.kmer, round(coalesce(n,0)/total - 1/256.0, 6) freq from tt cross join v left join kc on kc.doc_id=tt.doc_id and kc.kmer=v.kmer")
def kmer_frequency(t: Tables) -> DataFrame:
    return features.kmer_frequencies(_sequences(t), "doc_id", "seq").select("doc_id", "kmer", *r6("freq"))


@query("with c as (select lang, n_chars, sum(n_chars) over (partition by lang order by n_chars desc range unbounded preceding) r, sum(n_chars) over (partition by lang) a from documents) select lang, max(n_chars) n50 from c where 2*r>=a group by lang")
def n50_by_lang(t: Tables) -> DataFrame:
    return stats.n50(t.documents, "n_chars", "lang")


@query("select lang, count(*) contigs, sum(n_chars)::bigint total, round(avg(n_chars),6) mean, min(n_chars) shortest, max(n_chars) longest from documents group by lang")
def assembly_stats(t: Tables) -> DataFrame:
    return stats.assembly_stats(t.documents, "n_chars", "lang").select("lang", "contigs", "total", *r6("mean"), "shortest", "longest")


@query("select count(*) with_markers, max(n) most, round(avg(n),6) mean from (select l_suppkey, count(distinct l_partkey) n from lineitem group by 1)")
def marker_stats(t: Tables) -> DataFrame:
    m = t.lineitem.select(F.col("l_suppkey").alias("c"), F.col("l_partkey").alias("g"))
    return stats.marker_stats(m, t.supplier.select(F.col("s_suppkey").alias("c")), "c", "g").select("with_markers", "most", *r6("mean"))


@query("with p as (select a.vec_id i, b.vec_id j, round(list_dot_product(a.embedding::double[], b.embedding::double[]),6) score from embeddings a, embeddings b) select i, j, score, rank::int \"rank\" from (select *, row_number() over (partition by i order by score desc, j) rank from p) where rank<=5")
def topk_neighbours(t: Tables) -> DataFrame:
    return cluster.top_neighbours(t.embeddings, "vec_id", "embedding", 5).select("i", "j", *r6("score"), "rank")


@query("with p as (select a.vec_id i, b.vec_id j, 0.5 - 0.5*list_cosine_similarity(a.embedding::double[], b.embedding::double[]) d from embeddings a, embeddings b where a.vec_id<b.vec_id) select i, j, round(d,6) distance from p where d <= 0.3")
def cosine_distance_pairs(t: Tables) -> DataFrame:
    return cluster.pair_distances(t.embeddings, "vec_id", "embedding", 0.3).select("i", "j", *r6("distance"))


@query("with p as (select (a.label=b.label) same, list_cosine_similarity(a.embedding::double[], b.embedding::double[]) c from embeddings a, embeddings b where a.vec_id<b.vec_id) select same, count(*) pairs, round(avg(c),6) mean from p group by same")
def label_similarity(t: Tables) -> DataFrame:
    return cluster.label_cosines(t.embeddings, "vec_id", "embedding", "label").select("same", "pairs", *r6("mean"))


@query("with " + EDGE + " select least(weight,150) weight, count(*) n from e where src<dst and weight>=1 group by 1")
def edge_similarity_hist(t: Tables) -> DataFrame:
    e = _edges(t, once=True).where("weight >= 1")
    return e.groupBy(F.least(F.col("weight"), F.lit(150)).alias("weight")).agg(F.count(F.lit(1)).alias("n"))


@query("select label, (i-1)::int pos, round(avg(embedding[i]::double),6) mean from embeddings, unnest(range(1,65)) u(i) group by all")
def centroids(t: Tables) -> DataFrame:
    return cluster.centroids(t.embeddings, "label", "embedding").select("label", "pos", *r6("mean"))


@query("with c as (select label bin, i pos, avg(embedding[i]::double) m from embeddings, unnest(range(1,65)) u(i) group by all), d as (select vec_id, bin, sum((embedding[pos]::double-m)*(embedding[pos]::double-m)) d from embeddings, c group by all) select vec_id, bin, round(d,6) distance2 from (select *, row_number() over (partition by vec_id order by d, bin) k from d) where k=1")
def nearest_centroid(t: Tables) -> DataFrame:
    return cluster.nearest_centroid(t.embeddings, "vec_id", "embedding", "label").select("vec_id", "bin", *r6("distance2"))


@query("select page_id, split_part(split_part(trim(url),' ',1),'_',1) || case when contains(split_part(trim(url),' ',1),'_') then '_'||split_part(split_part(trim(url),' ',1),'_',2) else '' end name from pages")
def name_normalise(t: Tables) -> DataFrame:
    return t.pages.select("page_id", G.contig_name(F.col("url")).alias("name"))


_BRANDS = [f"Brand#{i}{j}" for i in range(1, 6) for j in range(1, 6)]


@query("select s_nationkey, " + ", ".join(f"count(*) filter (where p_brand='{b}') b{b[-2:]}" for b in _BRANDS) + " from lineitem join supplier on l_suppkey=s_suppkey join part on l_partkey=p_partkey group by 1")
def marker_pivot(t: Tables) -> DataFrame:
    j = t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    return metrics.marker_matrix(j, "s_nationkey", "p_brand", _BRANDS).toDF("s_nationkey", *[f"b{b[-2:]}" for b in _BRANDS])


@query("with " + PARTS + " select bin, sum(len)::bigint bp, count(*) contigs from p group by bin having sum(len) >= 2000000")
def bin_sizes(t: Tables) -> DataFrame:
    p = _parts(t)
    return metrics.bin_sizes(p.select("p_partkey", "bin"), p.select("p_partkey", "len"), "p_partkey", "len", 2_000_000)


# Bins of size and brand, but for parts of over 40, which are in none.
_LEFT = PARTS + ", c as (select p_partkey::varchar \"name\", len, bin, genome from p), b as (select \"name\", len, genome||'/'||bin bin from c where bin <= 40), k as (select bin from b group by bin having sum(len) >= 91000)"


@query("with " + _LEFT + " select \"name\", bin from b where bin in (select bin from k) union all select \"name\", (row_number() over (order by \"name\") + (select count(*) from k) - 1)::varchar from c where bin > 40 and len > 91000")
def leftover_bins(t: Tables) -> DataFrame:
    p = _parts(t).select(F.col("p_partkey").cast("string").alias("name"), F.col("len").alias("length"), "bin", "genome")
    return sinks.bins_with_leftovers(p.where("bin <= 40").select("name", F.concat_ws("/", "genome", "bin").alias("bin")), p, 91_000)


@query("with " + SUPP + ", q as (select s.c, s_nationkey bin from (select distinct c from s) s join supplier on s.c=s_suppkey) select distinct a.c i, b.c j from q a join q b on a.bin=b.bin and a.c<b.c")
def positive_pairs(t: Tables) -> DataFrame:
    bins = _supplier_parts(t).select("c").distinct().join(t.supplier, F.col("c") == F.col("s_suppkey")).select("c", F.col("s_nationkey").alias("bin"))
    return metrics.positive_pairs(bins, "c")


RUNS = "r as (select user_id%5 run, event_type metric, avg(\"value\") v from events group by all)"


def _runs(t: Tables) -> DataFrame:
    return t.events.groupBy((F.col("user_id") % 5).alias("run"), F.col("event_type").alias("metric")).agg(F.avg("value").alias("v"))


@query("with " + RUNS + " select metric, round(avg(v),6) mean, round(stddev_pop(v),6) std from r group by metric")
def run_statistics(t: Tables) -> DataFrame:
    return stats.run_statistics(_runs(t), "metric", "v").select("metric", *r6("mean", "std"))


@query("with " + RUNS + " select metric, run, round(v,6) v from (select *, row_number() over (partition by metric order by v desc, run) k from r) where k=1")
def best_epoch(t: Tables) -> DataFrame:
    return stats.best_by(_runs(t), ["metric"], "v", "run").select("metric", "run", *r6("v"))


@query("select event_type, key, count(*) n, sum(json_extract(props, '$.'||key)::bigint)::bigint total from (select event_type, props, unnest(json_keys(props)) key from events) group by all")
def json_markers(t: Tables) -> DataFrame:
    m = t.events.select("event_type", F.explode(F.from_json("props", "map<string,bigint>")).alias("key", "v"))
    return m.groupBy("event_type", "key").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"))


def _draw_sql(*parts: str) -> str:
    """functions.draw in SQL."""
    return "('0x'||substr(md5(" + "||':'||".join(parts) + "),1,15))::bigint"


NEG = EDGE + f", h as (select p_partkey dst, {_draw_sql('p_partkey', '7')}%1024 slot from part), ra as (select dst, row_number() over (order by slot, dst)-1 rank from h), dr as materialized (select src, {_draw_sql('src', 'dst', '1', '7')}%n rank from e, (select count(*) n from h)), neg as (select dr.src, ra.dst, 1 k from dr join ra using (rank))"


@query("with " + NEG + " select * from neg")
def negative_sample(t: Tables) -> DataFrame:
    return graph.negative_edges(_edges(t), t.part, "p_partkey", 1, 7)


def _sample_sql(edges: str, n: int, seed: int) -> str:
    return f"(select src, dst, weight from (select *, row_number() over (partition by src order by -ln(({_draw_sql('src', 'dst', str(seed))}%1073741824+0.5)/1073741824)/weight, dst) k from {edges}) where k<={n})"


@query("with " + EDGE + " select * from " + _sample_sql("e", 5, 7))
def neighbour_sample(t: Tables) -> DataFrame:
    return graph.sample_neighbours(_edges(t), 5, 7)


@query("with " + EDGE + f", s0 as (select p_partkey n from part where p_brand='Brand#13'), l0 as {_sample_sql('(select * from e where src in (select n from s0))', 10, 7)}, s1 as (select n from s0 union select dst from l0), l1 as {_sample_sql('(select * from e where src in (select n from s1))', 25, 8)} select 0 level, * from l0 union all select 1, * from l1")
def neighbour_levels(t: Tables) -> DataFrame:
    """Two layers of sampled edges for the parts of a brand: ten neighbours each, then 25 of each node so far."""
    seeds = t.part.where("p_brand = 'Brand#13'").select("p_partkey")
    return graph.sample_levels(_edges(t), seeds, "p_partkey", [10, 25], 7)


@query()
def kmeans_bins(t: Tables) -> DataFrame:
    return cluster.kmeans(t.embeddings, "vec_id", "embedding", 10)


@query()
def gmm_bins(t: Tables) -> DataFrame:
    return cluster.gaussian_mixture(t.embeddings, "vec_id", "embedding", 4, iterations=5)


@query()
def medoid_bins(t: Tables) -> DataFrame:
    return cluster.medoid_bins(t.embeddings, "vec_id", "embedding")


@query("""with recursive near as (select a.vec_id i, b.vec_id j from embeddings a, embeddings b where a.vec_id=b.vec_id or 0.5-0.5*list_cosine_similarity(a.embedding::double[], b.embedding::double[]) <= 0.25),
n as (select i, count(*) c from near group by i), links as (select near.i, near.j from near join n x on near.i=x.i join n y on near.j=y.i where x.c>=4 and y.c>=4),
r as (select i, j from links union select r.i, links.j from r join links on r.j=links.i), k as (select i, min(j) bin from r group by i),
e as (select near.i, min(k.bin) bin from near join k on near.j=k.i group by near.i) select n.i vec_id, c neighbours, c>=4 core, coalesce(k.bin, e.bin, -1) bin from n left join k using (i) left join e using (i)""")
def dbscan_core(t: Tables) -> DataFrame:
    return cluster.dbscan(t.embeddings, "vec_id", "embedding", 0.25, 4)


# Vectors of parts: size, price and a constant.
VEC = "v as (select p_partkey n, [p_size::double, p_retailprice/50, 10.0] v from part)"


def _vectors(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_partkey").alias("n"), F.array(F.col("p_size").cast("double"), F.col("p_retailprice") / 50, F.lit(10.0)).alias("v"))


SIM = EDGE + ", " + VEC + ", m as (select distinct l_partkey n, l_suppkey g from lineitem), sh as (select distinct e.src, e.dst from e join m x on e.src=x.n join m y on e.dst=y.n and x.g=y.g), si as (select e.src, e.dst, least(e.weight,2) weight, list_cosine_similarity(a.v,b.v) c, sh.src is not null shares from e join v a on e.src=a.n join v b on e.dst=b.n left join sh on sh.src=e.src and sh.dst=e.dst where e.src<e.dst and e.weight>0)"


def _similarity(t: Tables) -> DataFrame:
    cosine = lambda a, b: F.when(a("v").isNotNull() & b("v").isNotNull(), F.coalesce(G.cosine(a("v"), b("v")), F.lit(0.0)))
    return graph.edge_similarity(_marked(t, nodes=_vectors(t), between={"cosine": cosine}).where("cosine is not null"), 0, 2)


@query("with " + SIM + " select src, dst, weight, round(c,6) cosine, shares from si")
def edge_similarity(t: Tables) -> DataFrame:
    return _similarity(t).select("src", "dst", "weight", *r6("cosine"), "shares")


@query("with " + EDGE + " select src, dst, weight from e where weight >= (select avg(weight) from e)")
def edges_over_mean(t: Tables) -> DataFrame:
    return graph.edges_over(_edges(t), -1)


@query("with " + EDGE + ", g as (select p_partkey n from part where p_size<=10) select src, dst, weight from e where src not in (select n from g) and dst not in (select n from g)")
def nodes_removed(t: Tables) -> DataFrame:
    return graph.without_nodes(_edges(t), t.part.where("p_size <= 10"), "p_partkey")


@query("with " + EDGE + " select p_partkey, p_brand from part where p_partkey in (select src from e) and p_partkey in (select l_partkey from lineitem)")
def linked_and_marked(t: Tables) -> DataFrame:
    marks = t.lineitem.select(F.col("l_partkey").alias("p_partkey"))
    return graph.linked_and_marked(t.part, _edges(t), marks, "p_partkey").select("p_partkey", "p_brand")


@query("with " + EDGE + ", w as (select p_partkey src, p_partkey+1 dst, 1::bigint weight from part where p_size=1) select * from w union all select * from e where src not in (select src from w)")
def edges_replaced(t: Tables) -> DataFrame:
    new = t.part.where("p_size = 1").select(F.col("p_partkey").alias("src"), (F.col("p_partkey") + 1).alias("dst"), F.lit(1).cast("long").alias("weight"))
    return graph.replace_edges(_edges(t), new)


@query("with l as (select l_partkey::varchar src, l_suppkey::varchar dst from lineitem), k as (select p_partkey::varchar n from part where p_size>=5) select distinct least(src,dst) src, greatest(src,dst) dst from l where src in (select n from k) and dst in (select n from k) union all select 'root', n from k")
def rooted_graph(t: Tables) -> DataFrame:
    links = t.lineitem.select(F.col("l_partkey").cast("string").alias("src"), F.col("l_suppkey").cast("string").alias("dst"))
    return graph.undirected_edges(links, t.part.select(F.col("p_partkey").cast("string").alias("name"), F.col("p_size").alias("length")), 5, "root")


@query("with " + EDGE + ", u as (select src, dst from e where src<dst), n as (select count(*) n from (select src from u union select dst from u)) select n nodes, (select count(*) from u) edges, round(2.0*(select count(*) from u)/(n*(n-1)),6) density from n")
def graph_density(t: Tables) -> DataFrame:
    return graph.density(_edges(t)).select("nodes", "edges", *r6("density"))


@query("with recursive " + STARS + " select component, count(*) nodes, count(distinct c_mktsegment) labels from c left join customer on node='c'||c_custkey group by 1")
def component_labels(t: Tables) -> DataFrame:
    labels = t.customer.select(F.concat(F.lit("c"), "c_custkey").alias("name"), "c_mktsegment")
    return graph.component_labels(_components(t), labels, "name", "c_mktsegment")


@query("with " + NORM + ", s as (select na.src, sum(norm*p_retailprice) price, sum(norm*p_size) size from na join part on p_partkey=dst group by na.src) select p_partkey, p_retailprice price, p_size size, round(coalesce(s.price,0),4) near_price, round(coalesce(s.size,0),4) near_size from part left join s on src=p_partkey")
def sage_propagate(t: Tables) -> DataFrame:
    x = t.part.select("p_partkey", F.col("p_retailprice").alias("price"), F.col("p_size").alias("size"))
    out = models.sage(graph.normalised_adjacency(_edges(t, once=True), once=True, dealt=True), x, "norm", ["price", "size"], "p_partkey")
    return out.select("p_partkey", "price", "size", *[F.round(c, 4).alias(c) for c in ("near_price", "near_size")])


@query("with " + NORM + ", x as (select p_partkey n, 1/(1+exp(-(p_size/25.0-1))) s from part), u as (select na.src, sum(norm*pow(s,1.0))+1e-6 a, sum(norm*pow(1-s,0.5))+1e-6 b, sum(norm*pow(s,2.0))+1e-6 c, sum(norm*pow(1-s,0.0))+1e-6 d from na join x on n=dst group by na.src), w as (select src, pow(a,1.0)*0.7+pow(b,2.0)*-0.2 up, pow(c,0.5)*0.4+pow(d,1.0)*0.3 below from u) select src, round(up*below/(below*below+1e-3),6) \"value\" from w")
def learned_fraction(t: Tables) -> DataFrame:
    x = t.part.select("p_partkey", (F.col("p_size") / 25.0 - 1).alias("x"))
    unit = ((1.0, 0.5, 2.0, -1.0), (1.0, 2.0, 0.5, 1.0), (0.7, -0.2, 0.4, 0.3))
    out = models.learned_fractions(_blocks(t), x, "norm", ["x"], "p_partkey", [unit])
    return out.select("src", F.round(F.col("out")[0][0], 6).alias("value"))


@query("with " + NEG + ", " + VEC + ", c as (select y, list_cosine_similarity(a.v,b.v) c from (select src, dst, 1.0 y from e union all select src, dst, 0.0 from neg) p join v a on src=a.n join v b on dst=b.n) select round(avg(c) filter (where y=1),6) pos, round(avg(c) filter (where y=0),6) neg, round(avg(ln(1+exp(c))-y*c),6) loss from c")
def edge_loss(t: Tables) -> DataFrame:
    """The loss with a negative for each edge, its end drawn evenly over all parts."""
    e = _edges(t)
    return models.edge_loss(e, graph.negative_edges(e, t.part, "p_partkey", 1, 7).select("src", "dst"), _vectors(t), "n", "v").select(*r6("pos", "neg", "loss"))


@query("with " + EDGE + ", " + VEC + ", c as (select list_cosine_similarity(a.v,b.v) c from e join v a on src=a.n join v b on dst=b.n where src<dst) select count(*) pairs, round((sum(ln(1+exp(c)))+ln(1+exp(1.0))-1)/(count(*)+1),6) loss from c")
def marker_loss(t: Tables) -> DataFrame:
    return models.marker_loss(_edges(t).where("src < dst"), _vectors(t), "n", "v").select("pairs", *r6("loss"))


@query("""with d as (select (p_size/50.0)::double q, (p_partkey%10/10.0)::double h, ln(p_retailprice/1000)::double lv from part),
l as (select -(q*ln(0.4+0.2*h+1e-9)+(1-q)*ln(0.6-0.2*h+1e-9)) a, (pow(q-h,2)+pow(h-q*q,2))/2 k, -0.5*(1+least(greatest(lv,-2),2)-h*h-exp(least(greatest(lv,-2),2))) z from d),
s as (select avg(a)*0.85 abundance, avg(k)*0.15 kmer, avg(z)/200 kld from l) select round(abundance,6) abundance, round(kmer,6) kmer, round(kld,6) kld, round(abundance+kmer+kld,6) loss from s""")
def autoencoder_loss(t: Tables) -> DataFrame:
    d = t.part.select((F.col("p_size") / 50.0).alias("q"), (F.col("p_partkey") % 10 / 10.0).alias("h"), F.ln(F.col("p_retailprice") / 1000).alias("lv"))
    q, h = F.col("q"), F.col("h")
    rows = d.select(F.array(q, 1 - q, q, h).alias("x"), F.array(0.4 + 0.2 * h, 0.6 - 0.2 * h, h, q * q).alias("x_hat"), F.array(h).alias("mu"), F.array("lv").alias("logvar"))
    return models.autoencoder_loss(rows, "x", "x_hat", "mu", "logvar", 2).select(*r6("abundance", "kmer", "kld", "loss"))


@query("with c as (select label bin, i pos, avg(embedding[i]::double) m from embeddings, unnest(range(1,65)) u(i) group by all), d as (select vec_id, bin, sum((embedding[pos]::double-m)*(embedding[pos]::double-m)) d from embeddings, c group by all) select count(*) points, round(avg(d),6) loss from (select vec_id, min(d) d from d group by 1)")
def centroid_loss(t: Tables) -> DataFrame:
    return models.centroid_loss(t.embeddings, "vec_id", "embedding", "label", t.embeddings).select("points", *r6("loss"))


@query()
def principal_components(t: Tables) -> DataFrame:
    return models.principal_components(t.embeddings, "vec_id", "embedding").select("vec_id", F.transform("projected", lambda x: F.round(x, 6)).alias("projected"))


@query()
def label_classifier(t: Tables) -> DataFrame:
    return models.label_classifier(t.embeddings, t.embeddings, "vec_id", "embedding", "label")


@query()
def bisecting_bins(t: Tables) -> DataFrame:
    return cluster.bisecting_kmeans(t.embeddings, "vec_id", "embedding", 8)


# A gold standard with genomes that no bin holds: brand 13's parts are left unassigned.
UNREC = PARTS.replace(" from part)", " from part), g as (select genome, sum(len)::bigint genome_bp, count(*) genome_seqs from p group by genome)") + ", c as (select bin, genome, sum(len)::bigint bp, count(*) seqs from p where genome <> 'Brand#13' group by all)"


@query("with " + UNREC + " select genome, bin, round(coalesce(bp,0)/genome_bp,6) recall_bp, round(coalesce(seqs,0)/genome_seqs,6) recall_seq from g left join (select *, row_number() over (partition by genome order by bp desc, bin) k from c) using (genome) where coalesce(k,1)=1")
def amber_unrecovered(t: Tables) -> DataFrame:
    p = _parts(t)
    c = metrics.confusion(p.where("genome <> 'Brand#13'"), "bin", "genome", "len")
    return metrics.genome_recall(c, p, "genome", "len").select("genome", "bin", *r6("recall_bp", "recall_seq"))


@query("with " + PARTS + " select round((sum(len) filter (where genome<>'Brand#13'))/sum(len),6) share_bp, round((count(*) filter (where genome<>'Brand#13'))/count(*),6) share_seq from p")
def assigned_share(t: Tables) -> DataFrame:
    p = _parts(t)
    return metrics.assigned_share(p.where("genome <> 'Brand#13'"), p, "p_partkey", "len").select(*r6("share_bp", "share_seq"))


@query("with c as (select c_nationkey b, c_mktsegment l, count(*) n from customer group by all) select round(a.x,6) avg_precision, round(b.x,6) avg_recall from (select avg(m/t) x from (select max(n) m, sum(n) t from c group by b)) a, (select avg(m/t) x from (select max(n) m, sum(n) t from c group by l)) b")
def average_pr(t: Tables) -> DataFrame:
    return metrics.average_pr(t.customer, "c_nationkey", "c_mktsegment").select(*r6("avg_precision", "avg_recall"))


@query("select c_nationkey bin, c_mktsegment, count(*) n from customer group by all")
def bin_composition(t: Tables) -> DataFrame:
    return metrics.bin_composition(t.customer.withColumnRenamed("c_nationkey", "bin"), "c_mktsegment")


@query("select p_partkey, coalesce(string_agg(distinct l_suppkey::varchar, ',' order by l_suppkey::varchar), '') contigs from part left join lineitem on l_partkey=p_partkey group by 1")
def marker_contigs(t: Tables) -> DataFrame:
    m = t.lineitem.select(F.col("l_partkey").alias("p_partkey"), F.col("l_suppkey").cast("string").alias("c"))
    return metrics.marker_contigs(t.part, m, "p_partkey", "c").select("p_partkey", F.array_join("contigs", ",").alias("contigs"))


@query("select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by event_id) k from events) where k=1")
def gold_first_rows(t: Tables) -> DataFrame:
    return metrics.first_rows(t.events, "user_id", "event_id").select("user_id", "event_id", "event_type")


@query("select lang, source species, count(*) reads from documents group by all")
def reads_by_species(t: Tables) -> DataFrame:
    return metrics.reads_by_species(t.documents.select("lang", F.concat("source", F.lit("_reads/"), "doc_id").alias("read")), "lang", "read")


@query("select p_partkey src, p_partkey dst, 1 weight from part")
def self_loops(t: Tables) -> DataFrame:
    return graph.self_loops(t.part, "p_partkey")


@query("with " + EDGE + ", i as (select p_partkey, 2*p_partkey+1 idx from part where p_size<>7) select a.idx src, b.idx dst, weight from e join i a on e.src=a.p_partkey join i b on e.dst=b.p_partkey")
def edges_reindexed(t: Tables) -> DataFrame:
    return graph.reindexed(_edges(t), t.part.where("p_size <> 7").select(F.col("p_partkey").alias("name"), (2 * F.col("p_partkey") + 1).alias("idx")))


_GAT = "f{k} as (select src, dst, case when weight*({l}-{r})>=0 then weight*({l}-{r}) else 0.2*weight*({l}-{r}) end x from e join part a on src=a.p_partkey join part b on dst=b.p_partkey), g{k} as (select *, exp(x - max(x) over (partition by src)) y from f{k}), h{k} as (select src, round(sum(y*p_size)/sum(y),6) v from g{k} join part on dst=p_partkey group by src)"
_HEADS = [("a.p_size/50.0", "b.p_size/25.0"), ("a.p_retailprice/1000", "b.p_size/40.0")]


@query("with " + EDGE + ", " + ", ".join(_GAT.format(k=k, l=left, r=right) for k, (left, right) in enumerate(_HEADS)) + " select src, h0.v head_0, h1.v head_1 from h0 join h1 using (src)")
def attention_layer(t: Tables) -> DataFrame:
    n = t.part.select("p_partkey", (F.col("p_size") / 50.0).alias("l0"), (-F.col("p_size") / 25.0).alias("r0"), (F.col("p_retailprice") / 1000).alias("l1"), (-F.col("p_size") / 40.0).alias("r1"), F.col("p_size").cast("double").alias("x"))
    out = graph.attention_layer(_edges(t), n, "p_partkey", [("l0", "r0", "x"), ("l1", "r1", "x")])
    return out.select("src", *[F.round(F.col("out")[k], 6).alias(f"head_{k}") for k in (0, 1)])


@query("with s as (select i, avg(embedding[i]::double) m, stddev_pop(embedding[i]::double) d from embeddings, unnest(range(1,65)) u(i) group by i) select vec_id, (i-1)::int pos, round((embedding[i]::double-m)/d,6) x from embeddings, s")
def standardised_embeddings(t: Tables) -> DataFrame:
    z = features.standardise_vectors(t.embeddings, "vec_id", "embedding")
    return z.select("vec_id", F.posexplode("embedding").alias("pos", "x")).select("vec_id", "pos", *r6("x"))


@query("with f as (select vec_id, list_concat(embedding::double[], [p_size::double, p_retailprice]) v from embeddings join part on p_partkey=vec_id) select vec_id, (i-1)::int pos, round(v[i],6) x from f, unnest(range(1,67)) u(i)")
def concatenated_features(t: Tables) -> DataFrame:
    a = t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("a"))
    b = t.part.select(F.col("p_partkey").alias("vec_id"), F.array(F.col("p_size").cast("double"), "p_retailprice").alias("b"))
    return features.concat_features(a, b, "vec_id", "a", "b", "v").select("vec_id", F.posexplode("v").alias("pos", "x")).select("vec_id", "pos", *r6("x"))


@query("with " + EDGE + f", h as (select dst, floor(pow(count(*)::double,0.75)*1000000)::bigint w, {_draw_sql('dst', '7')}%1024 slot from e group by dst), st as (select dst, (sum(w) over (order by slot, dst))::bigint til, w from h), pt as (select src, {_draw_sql('src', 'dst', '1', '7')}%(select sum(w)::bigint from h) point from e) select pt.src, st.dst, 1 k from pt join st on point>=til-w and point<til")
def weighted_negatives(t: Tables) -> DataFrame:
    """Ends drawn by in-degree to the power of 3/4."""
    return graph.weighted_negatives(_edges(t, once=True), 1, 7, once=True)


@query()
def vae_embeddings(t: Tables) -> DataFrame:
    """Latent means after two epochs on all embeddings; the fit is beyond SQL."""
    shape = training.Shape(0, 64, hidden=64, latent=16)
    state, _ = training.train(t.embeddings, "vec_id", "embedding", shape, epochs=2)
    out = training.encode(t.embeddings, "vec_id", "embedding", state, shape)
    return out.select("vec_id", F.transform("emb", lambda x: F.round(x, 6)).alias("emb"))


# Layers with weights over the graph of parts: two features, two values out; the dense step after the layer passes them on.
_LAYER = {
    "0.w": [[0.5, -0.3], [0.8, 0.4]], "0.v": [[-0.2, 0.6], [0.3, 0.1]], "0.l": [[0.7], [-0.4]], "0.r": [[0.3], [0.9]], "0.b": [0.1, -0.2], "0.d": [0.05, 0.15],
    "0.c": [0.0, 0.0], "0.scale": [1.2, 0.9], "0.shift": [0.1, 0.2], "0.~mean": [0.0, 0.0], "0.~var": [1.0, 1.0], "out.w": [[1.0, 0.0], [0.0, 1.0]], "out.b": [0.0, 0.0],
}
_X = ", x as (select p_partkey n, p_retailprice/1000 x0, p_size/50.0 x1 from part)"
_H = ", y as (select n, 0.5*x0+0.8*x1 y0, 0.4*x1-0.3*x0 y1, 0.3*x1-0.2*x0 v0, 0.6*x0+0.1*x1 v1 from x)"
_OUT = ", u as (select n, (z0-avg(z0) over ())/sqrt(var_pop(z0) over ()+1e-5) u0, (z1-avg(z1) over ())/sqrt(var_pop(z1) over ()+1e-5) u1 from z) select n p_partkey, round(greatest(1.2*u0+0.1,0),5) out_0, round(greatest(0.9*u1+0.2,0),5) out_1 from u"
_NEAR = ", s as (select src, sum(norm*(y0+0.1)) s0, sum(norm*(y1-0.2)) s1 from na join y on n=dst group by src)"
_SOFT = ", f{k} as (select src, b.y{k} h, case when norm*({l}*a.y{k}+{r}*b.y{k})>=0 then 1 else 0.2 end*norm*({l}*a.y{k}+{r}*b.y{k}) e from na join y a on src=a.n join y b on dst=b.n), t{k} as (select src, sum(w*h)/sum(w) s{k} from (select *, exp(e-max(e) over (partition by src)) w from f{k}) group by src)"


def _layer(t: Tables, kind: str) -> DataFrame:
    net = gnn.Net(kind, 2, 1 if kind == "gat" else 2, 2, layers=1, heads=2)
    nodes = t.part.select(F.col("p_partkey").alias("node"), F.array(F.col("p_retailprice") / 1000, F.col("p_size") / 50.0).alias("x"))
    edges = _blocks(t)
    out = gnn.embed(net, {k: np.array(v) for k, v in _LAYER.items()}, nodes, edges, concat=False, own_statistics=True)
    edges.clear()
    return out.select(F.col("node").alias("p_partkey"), *[F.round(F.col("emb")[k], 5).alias(f"out_{k}") for k in (0, 1)])


@query("with " + NORM + _X + _H + _NEAR + ", z as (select n, coalesce(s0,0) z0, coalesce(s1,0) z1 from y left join s on src=n)" + _OUT)
def gcn_layer(t: Tables) -> DataFrame:
    """A convolution with weights, bias, normalisation over all nodes, and relu."""
    return _layer(t, "gcn")


@query("with " + NORM + _X + _H + _NEAR + ", z as (select n, v0+0.05+coalesce(s0,0) z0, v1+0.15+coalesce(s1,0) z1 from y left join s on src=n)" + _OUT)
def sage_layer(t: Tables) -> DataFrame:
    return _layer(t, "sage")


@query("with " + NORM + _X + _H + _SOFT.format(k=0, l=0.7, r=0.3) + _SOFT.format(k=1, l=-0.4, r=0.9) + ", z as (select n, coalesce(s0,0) z0, coalesce(s1,0) z1 from y left join t0 on t0.src=n left join t1 on t1.src=n)" + _OUT)
def gat_layer(t: Tables) -> DataFrame:
    """Two heads of attention, each with its own weights."""
    return _layer(t, "gat")


@query()
def gnn_embeddings(t: Tables) -> DataFrame:
    """Two epochs of the adding layer on all embeddings, linked to the next one of their label; the fit is beyond SQL."""
    nodes = t.embeddings.select(F.col("vec_id").alias("node"), F.col("embedding").cast("array<double>").alias("x"))
    links = graph.label_ring(t.embeddings, "vec_id", "label").where("src <> dst")
    edges = graph.with_loops(graph.normalised_adjacency(graph.both_directions(links).withColumn("weight", F.lit(1.0))), nodes, "node", "norm").withColumnRenamed("norm", "value")
    net = gnn.Net("sage", 64, 16, 8, 1)
    state, _ = gnn.train(net, nodes, edges, links, epochs=2)
    return gnn.embed(net, state, nodes, edges, concat=False).select(F.col("node").alias("vec_id"), F.transform("emb", lambda x: F.round(x, 4)).alias("emb"))


@query("select a.vec_id src, b.vec_id dst, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]),6) weight from embeddings a, embeddings b where a.vec_id=b.vec_id or list_cosine_similarity(a.embedding::double[], b.embedding::double[])>=0.4")
def similar_edges(t: Tables) -> DataFrame:
    """Edges for graph augmentation: all pairs of a cosine of 0.4 and more."""
    return similarity.similar_edges(t.embeddings, "vec_id", "embedding", 0.4).select("src", "dst", *r6("weight"))


RING = "r as (select vec_id src, coalesce(lead(vec_id) over w, first(vec_id) over w) dst from embeddings window w as (partition by label order by vec_id rows between unbounded preceding and unbounded following))"


@query("with " + RING + ", p as (select a.vec_id i, b.vec_id j, a.label x, b.label y, list_cosine_similarity(a.embedding::double[], b.embedding::double[]) c from embeddings a, embeddings b), l as (select x, avg(c) m from p where x=y group by x having count(*)>1), e as (select sum(c) s, count(*) m from r join p on src=i and dst=j) select round((select avg(m) from l),6) label_mean, round(any_value(e.s/e.m),6) edge_mean, round((sum(c)-any_value(e.s))/(count(*)-any_value(e.m)),6) global_mean from p, e")
def similarity_means(t: Tables) -> DataFrame:
    ring = graph.label_ring(t.embeddings, "vec_id", "label")
    return cluster.similarity_means(t.embeddings, "vec_id", "embedding", "label", ring).select(*r6("label_mean", "edge_mean", "global_mean"))


@query("with " + NORM + ", x as (select p_partkey n, 1/(1+exp(-(p_size/25.0-1))) s, 1/(1+exp(-(p_retailprice/1000-1))) z from part), u as (select na.src, sum(norm*pow(s,1.0))+1e-6 a, sum(norm*pow(1-s,0.5))+1e-6 b, sum(norm*pow(s,2.0))+1e-6 c, sum(norm)+1e-6 d, sum(norm*pow(z,0.3))+1e-6 a2, sum(norm*pow(1-z,1.5))+1e-6 b2, sum(norm*z)+1e-6 c2, sum(norm*pow(1-z,2.0))+1e-6 d2 from na join x on n=dst group by na.src), w as (select src, pow(a,1.0)*0.7+pow(b,2.0)*-0.2 up, pow(c,0.5)*0.4+pow(d,1.0)*0.3 below, pow(a2,2.0)*0.1+pow(b2,0.5)*0.9 up2, pow(c2,1.0)*0.5+pow(d2,1.0)*-0.6 below2 from u) select src, round(up*below/(below*below+1e-3),6) size_0, round(up2*below2/(below2*below2+1e-3),6) price_1 from w")
def learned_fractions(t: Tables) -> DataFrame:
    """Two units over two features; of the size the first unit's value, of the price the second one's."""
    x = t.part.select("p_partkey", (F.col("p_size") / 25.0 - 1).alias("x"), (F.col("p_retailprice") / 1000 - 1).alias("y"))
    units = [((1.0, 0.5, 2.0, -1.0), (1.0, 2.0, 0.5, 1.0), (0.7, -0.2, 0.4, 0.3)), ((0.3, 1.5, 1.0, 2.0), (2.0, 0.5, 1.0, 1.0), (0.1, 0.9, 0.5, -0.6))]
    out = models.learned_fractions(_blocks(t), x, "norm", ["x", "y"], "p_partkey", units, wanted=[(0, 0), (1, 1)])
    return out.select("src", F.round(F.col("out")[0][0], 6).alias("size_0"), F.round(F.col("out")[1][1], 6).alias("price_1"))


@query()
def spectral_bins(t: Tables) -> DataFrame:
    return partitions.spectral(t.embeddings, "vec_id", "embedding", 8)


@query()
def birch_bins(t: Tables) -> DataFrame:
    return partitions.birch(t.embeddings, "vec_id", "embedding", 10, 0.5)


@query()
def mini_batch_bins(t: Tables) -> DataFrame:
    return partitions.mini_batch_kmeans(t.embeddings, "vec_id", "embedding", 10)


@query()
def bounded_bins(t: Tables) -> DataFrame:
    """Ten clusters of a twentieth to an eighth of the rows each."""
    n = t.embeddings.count()
    return partitions.constrained_kmeans(t.embeddings, "vec_id", "embedding", 10, n // 20, -(-n // 8), iterations=3)


@query()
def density_valleys(t: Tables) -> DataFrame:
    """The density order of all embeddings with the valleys in it."""
    order = density_order.density_order(t.embeddings, "vec_id", "embedding", 5, 0.3)
    found = density_order.valleys(order, "vec_id", 5, 0.05)
    return order.join(found, "vec_id").select("vec_id", "place", *r6("reachability", "core"), "size", "bin")


@query("with " + EDGE + f", st as (select src, dst, greatest(floor(1000000/weight)::bigint,1) w, (sum(greatest(floor(1000000/weight)::bigint,1)) over (partition by src order by dst))::bigint til from e), pt as (select src, {_draw_sql('src', 'dst', '1', '7')}%(sum(greatest(floor(1000000/weight)::bigint,1)) over (partition by src))::bigint point from e) select pt.src, st.dst, 1 k from pt join st on pt.src=st.src and point>=til-w and point<til")
def inverse_weight_negatives(t: Tables) -> DataFrame:
    """Ends drawn among a part's neighbours by one over the weight."""
    return graph.inverse_weight_negatives(_edges(t, by_source=True), 1, 7, by_source=True)


@query("with " + MARK + ", k as (select max(comp) c from sc) select count(*) bins, count(*) filter (where comp>c and cont<1000) hq, count(*) filter (where comp>60 and cont<70) mq, round(avg(comp) filter (where comp>c and cont<1000),6) hq_comp, round(avg(cont) filter (where comp>c and cont<1000),6) hq_cont from sc, k")
def strict_bins(t: Tables) -> DataFrame:
    """Counts above the bounds: no bin is above the largest completeness of all."""
    scores = _scores(t)
    return metrics.quality_counts(scores, (scores.agg(F.max("comp")).first()[0], 1000), (60, 70), strict=True).select("bins", "hq", "mq", *r6("hq_comp", "hq_cont"))


@query("with " + SIM + ", n as (select round(c,6) c from si where not shares), l as (select min(c) a, max(c) b from n), h as (select case when b>a then least(floor((c-a)/(b-a)*50),49) else 0 end::int bin, a, b from n, l) select bin, round(a+(b-a)*bin/50,6) low, count(*) n from h group by bin, a, b")
def similarity_histogram(t: Tables) -> DataFrame:
    similar = _similarity(t).withColumn("cosine", F.round("cosine", 6))
    return graph.similarity_histogram(similar).select("bin", *r6("low"), "n")


@query("with d as (select n_chars len, sum(n_chars) over (order by n_chars desc, doc_id) run, sum(n_chars) over () al from documents), " + EDGE + " select count(*) contigs, sum(len)::bigint total, round(avg(len),6) mean, max(len) longest, min(len) shortest, max(len) filter (where run*2>=al) n50, (select count(distinct l_returnflag) from lineitem) samples, (select count(*) from e) edges, (select count(distinct l_orderkey) from lineitem) paths from d")
def assembly_summary(t: Tables) -> DataFrame:
    depths, paths = t.lineitem.select(F.col("l_returnflag").alias("sample")), t.lineitem.select(F.col("l_orderkey").alias("path"))
    out = stats.assembly_summary(t.documents.select(F.col("n_chars").alias("length")), depths, _edges(t), paths)
    return out.withColumn("mean", F.round("mean", 6))


@query("select round(quantile_cont(l_extendedprice,0.9),6) p90, round(quantile_cont(l_extendedprice,0.123),6) p12 from lineitem")
def price_quantiles(t: Tables) -> DataFrame:
    """Exact quantiles by counted buckets, refined."""
    p90, p12 = (stats.exact_quantile(t.lineitem, "l_extendedprice", share) for share in (0.9, 0.123))
    return t.spark.range(1).select(F.round(F.lit(p90), 6).alias("p90"), F.round(F.lit(p12), 6).alias("p12"))


@query()
def medoid_round_bins(t: Tables) -> DataFrame:
    """Medoid clustering in rounds of joins, of any number of rows."""
    return medoids.medoid_rounds(t.embeddings, "vec_id", "embedding")
