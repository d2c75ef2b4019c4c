"""Assembly graphs as edge tables (src, dst, weight): building, cleaning, normalising, propagating, components."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from binloom import functions as G
from binloom.operators.stats import exact_quantile


#: Rows of a table that a task takes where a join multiplies them.
TASK_ROWS = 250_000
#: Markers of a node that go about in one list.
LIST_MARKERS = 1024


def tasks_for(df: DataFrame) -> int:
    """Tasks for a table's rows, so that a task's share does not grow with the table."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // TASK_ROWS))


def mirrored(half: DataFrame) -> DataFrame:
    """Edges that are there once, and their reverses, from one pass; no self loops."""
    ends = F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))).alias("__e")
    return half.select(ends, *[c for c in half.columns if c not in ("src", "dst")]).select("__e.*", *[c for c in half.columns if c not in ("src", "dst")])


def both_directions(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Edges and their reverses; a self loop stays single."""
    back = edges.where(F.col(src) != F.col(dst)).withColumnsRenamed({src: "__s", dst: src}).withColumnRenamed("__s", dst)
    return edges.unionByName(back)


def link_edges(links: DataFrame, contigs: DataFrame, min_length: int) -> DataFrame:
    """Directed edges between contigs of min_length and more; links with another end are dropped."""
    ok = contigs.where(F.col("length") >= min_length).select("name", "idx")
    a, b = ok.withColumnsRenamed({"name": "src", "idx": "si"}), ok.withColumnsRenamed({"name": "dst", "idx": "di"})
    return both_directions(links.join(a, "src").join(b, "dst").select(F.col("si").alias("src"), F.col("di").alias("dst"), "weight"))


def shared_member_edges(pairs: DataFrame, node: str, group: str, once: bool = False, nodes: DataFrame | None = None, between: dict[str, Callable[[Callable, Callable], Column]] | None = None, by_source: bool = False, ordered: bool = False) -> DataFrame:
    """(src, dst, weight): nodes in the same group, weight the number of groups; both directions, or `once`, src < dst.

    With `by_source` there are both directions, and all edges of a source are in one task, so that it needs no other shuffle.
    `ordered` has those of `once` in order of src and dst, tasks being ranges of them, as Blocks want them.

    With nodes (node, ...) each end brings its columns along to where the pair is made, and `between` names further columns of
    an edge as made of both: f(a, b), a("x") being x of src. A pair's own value must be the same in every group."""
    between, n = between or {}, tasks_for(pairs)
    p = pairs.select(F.col(node).alias("src"), F.col(group).alias("__g"))
    held = []
    if nodes is not None:
        held = [c for c in nodes.columns if c != node]
        p = p.repartition(n, "src").distinct().join(nodes.withColumnRenamed(node, "src"), "src", "left").repartition(n, "__g")
    else:
        p = p.repartition(n, "__g").distinct()
    x, y = p.select("__g", "src", *[F.col(c).alias(f"__a_{c}") for c in held]), p.select("__g", F.col("src").alias("dst"), *[F.col(c).alias(f"__b_{c}") for c in held])
    made = [f(lambda c: F.col(f"__a_{c}"), lambda c: F.col(f"__b_{c}")).alias(name) for name, f in between.items()]
    met = x.join(y, "__g").where("src < dst").select("src", "dst", *made)
    if by_source:
        return mirrored(met).repartition(2 * n, "src").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight"), *[F.max(name).alias(name) for name in between])
    met = met.repartitionByRange(n, "src", "dst") if ordered else met.repartition(n, "src", "dst")
    half = met.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight"), *[F.max(name).alias(name) for name in between])
    if ordered:
        half = half.sortWithinPartitions("src", "dst")
    return half if once else mirrored(half)


def marker_lists(markers: DataFrame, contig: str, gene: str) -> DataFrame | None:
    """(contig, markers): each node's different markers as one list; None where one has too many for that."""
    known = markers.select(F.col(contig).alias("__c"), F.col(gene).alias("__g")).where("__c is not null and __g is not null")
    whole = isinstance(markers.schema[gene].dataType, LongType)
    ends = [F.min("low"), F.max("high")] if whole else [F.lit(None), F.lit(None)]
    most, low, high = known.groupBy("__c").agg(F.count(F.lit(1)).alias("n"), F.min("__g").alias("low"), F.max("__g").alias("high")).agg(F.max("n"), *ends).first()
    if (most or 0) > LIST_MARKERS:
        return None
    small = whole and low is not None and -(1 << 31) <= low and high < 1 << 31
    return known.groupBy(F.col("__c").alias(contig)).agg(F.collect_set(F.col("__g").cast("int") if small else F.col("__g")).alias("markers"))


def shared_markers(a: Callable, b: Callable) -> Column:
    """How many markers both ends' lists have."""
    return F.coalesce(F.when(a("markers").isNotNull() & b("markers").isNotNull(), F.size(F.array_intersect(a("markers"), b("markers")))), F.lit(0)).cast("long")


def marked_member_edges(pairs: DataFrame, node: str, group: str, markers: DataFrame, contig: str, gene: str, nodes: DataFrame | None = None, between: dict | None = None) -> DataFrame:
    """(src, dst, weight, overlap, ...): the edges of shared_member_edges, once, and how many markers their ends share.

    The lists of markers meet where the pair is made, so they travel once a member and not once an edge and marker."""
    lists = marker_lists(markers, contig, gene)
    if lists is None:
        edges = shared_member_edges(pairs, node, group, True, nodes, between)
        shared = same_marker_edges(edges, markers, contig, gene)
        return edges.join(shared, ["src", "dst"], "left").withColumn("overlap", F.coalesce("overlap", F.lit(0).cast("long")))
    lists = lists.withColumnRenamed(contig, node)
    both = lists if nodes is None else nodes.join(lists, node, "full")
    return shared_member_edges(pairs, node, group, True, both, {"overlap": shared_markers, **(between or {})})


def contig_segment_edges(members: DataFrame, links: DataFrame) -> DataFrame:
    """Contig edges from segments: shared segments (other contigs only), and linked segments (self loops too).

    members (contig, segment), links (a, b); both de-duplicated, the resulting edges are not.
    """
    m = members.distinct()
    x, y = m.select(F.col("contig").alias("src"), "segment"), m.select(F.col("contig").alias("dst"), "segment")
    shared = x.join(y, "segment").where("src <> dst").select("src", "dst")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    linked = x.withColumnRenamed("segment", "a").join(both, "a").join(y.withColumnRenamed("segment", "b"), "b").select("src", "dst")
    return shared.unionByName(linked)


def contig_segment_counts(members: DataFrame, links: DataFrame) -> DataFrame:
    """(src, dst, n): how often each edge is among contig_segment_edges.

    Segments and links are met once, each pair of contigs as src <= dst, in tasks by the rows, and mirrored last. A contig on
    both sides of a link of two segments has its loop from either side. A null contig counts as the least."""
    n = tasks_for(members)
    m = members.select("contig", "segment").repartition(n, "segment").distinct()
    x, y = m.select(F.col("contig").alias("src"), "segment"), m.select(F.col("contig").alias("dst"), "segment")
    shared = x.join(y, "segment").where("src < dst").select("src", "dst", F.lit(1).alias("w"))
    once = links.where("a is not null and b is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    ahead = x.withColumnRenamed("segment", "a").join(once.repartition(n, "a"), "a").repartition(n, "b")
    met = ahead.join(y.withColumnRenamed("segment", "b"), "b").where("a <> b or src is null or src <= dst")
    loop, there, back = F.col("src").eqNullSafe(F.col("dst")), F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))
    linked = met.select(F.when(F.col("dst").isNull() | (F.col("src") > F.col("dst")), back).otherwise(there).alias("e"), F.when(loop & (F.col("a") != F.col("b")), 2).otherwise(1).alias("w")).select("e.*", "w")
    half = shared.unionByName(linked).repartition(3 * n, "src", "dst").groupBy("src", "dst").agg(F.sum("w").alias("n"))
    return half.select(F.explode(F.when(loop, F.array(there)).otherwise(F.array(there, back))).alias("e"), "n").select("e.*", "n")


def narrow(df: DataFrame, column: str) -> Column:
    """The column as an int where all its longs are such, else as it is."""
    if isinstance(df.schema[column].dataType, LongType):
        low, high = df.agg(F.min(column), F.max(column)).first()
        if low is not None and -(1 << 31) <= low and high < 1 << 31:
            return F.col(column).cast("int")
    return F.col(column)


def must_differ_pairs(markers: DataFrame, contig: str, gene: str) -> DataFrame:
    """(i, j), i < j: contigs that share a marker.

    A gene's contigs are lists of LIST_MARKERS or so; each of its contigs takes them to where all its lists meet, and only
    there they become pairs, so that what travels is a list a member and not a row a pair and gene."""
    kind, n = markers.schema[contig].dataType.simpleString(), tasks_for(markers)
    known = markers.select(narrow(markers, contig).alias("i"), F.col(gene).alias("g"))
    m = known.where("i is not null and g is not null").repartition(n, "g").distinct()
    sizes = m.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / LIST_MARKERS).cast("int").alias("blocks"))
    lists = m.join(sizes, "g").groupBy("g", F.pmod(F.xxhash64("i"), F.col("blocks")).alias("block")).agg(F.collect_list("i").alias("js"))
    met = m.join(lists, "g").select("i", F.filter("js", lambda j: j > F.col("i")).alias("js")).where(F.size("js") > 0)
    pairs = met.repartition(n, "i").select("i", F.explode("js").alias("j")).distinct()
    return pairs.select(F.col("i").cast(kind).alias("i"), F.col("j").cast(kind).alias("j"))


def same_marker_edges(edges: DataFrame, markers: DataFrame, contig: str, gene: str) -> DataFrame:
    """(src, dst, overlap): edges, self loops excluded, whose ends share markers.

    A node's markers go about as one list; where a node has more than LIST_MARKERS, a row a marker."""
    plain, lists = edges.where("src <> dst").select("src", "dst"), marker_lists(markers, contig, gene)
    if lists is not None:
        a, b = lists.toDF("src", "__a_markers"), lists.toDF("dst", "__b_markers")
        n = shared_markers(lambda c: F.col(f"__a_{c}"), lambda c: F.col(f"__b_{c}"))
        met = plain.join(a, "src").join(b, "dst").select("src", "dst", n.alias("n")).where("n > 0")
        return met.groupBy("src", "dst").agg(F.sum("n").alias("overlap"))
    m = markers.select(contig, gene).distinct()
    a, b = m.withColumnsRenamed({contig: "src", gene: "g"}), m.withColumnsRenamed({contig: "dst", gene: "g"})
    return plain.join(a, "src").join(b, ["dst", "g"]).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("overlap"))


def remove_edges(edges: DataFrame, gone: DataFrame) -> DataFrame:
    return edges.join(gone, ["src", "dst"], "left_anti")


def self_loops(nodes: DataFrame, node: str) -> DataFrame:
    """A loop of weight 1 at each node, for runs without links."""
    return nodes.select(F.col(node).alias("src"), F.col(node).alias("dst"), F.lit(1).alias("weight"))


def reindexed(edges: DataFrame, positions: DataFrame) -> DataFrame:
    """Edges by name as edges by position, (name, idx); an edge with an unknown end is dropped."""
    a, b = positions.select(F.col("name").alias("src"), F.col("idx").alias("si")), positions.select(F.col("name").alias("dst"), F.col("idx").alias("di"))
    return edges.join(a, "src").join(b, "dst").select(F.col("si").alias("src"), F.col("di").alias("dst"), "weight")


def attention_layer(edges: DataFrame, nodes: DataFrame, node: str, heads: list[tuple[str, str, str]], average: bool = False) -> DataFrame:
    """(src, out): attention-weighted sums of the neighbours, a value for each head (left score, right score, value) or,
    averaged, one of all."""
    out = None
    for k, (left, right, value) in enumerate(heads):
        x = nodes.select(F.col(node).alias("dst"), F.col(value).alias("__x"))
        one = attention(edges, nodes, node, left, right).join(x, "dst").groupBy("src").agg(F.sum(F.col("alpha") * F.col("__x")).alias(f"__{k}"))
        out = one if out is None else out.join(one, "src")
    every = [F.col(f"__{k}") for k in range(len(heads))]
    return out.select("src", (sum(every[1:], every[0]) / len(heads) if average else F.array(*every)).alias("out"))


def connected_only(nodes: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    return nodes.join(edges.select(F.col("src").alias(key)), key, "left_semi")


def binarise(edges: DataFrame, share: float = 0.9) -> DataFrame:
    """Edges at or over a percentile (linear) of the weights, with weight 1."""
    edges = _cut(edges)
    return edges.where(F.col("weight") >= F.lit(exact_quantile(edges, "weight", share)).cast("double")).select("src", "dst", F.lit(1).alias("weight"))


def homophily(edges: DataFrame, labels: DataFrame, node: str, label: str) -> DataFrame:
    """One row: labelled edges, those with equal labels, their share."""
    a, b = labels.select(F.col(node).alias("src"), F.col(label).alias("x")), labels.select(F.col(node).alias("dst"), F.col(label).alias("y"))
    both = edges.join(a, "src").join(b, "dst").where("x is not null and y is not null")
    out = both.agg(F.count(F.lit(1)).alias("labelled"), F.count_if(F.col("x") == F.col("y")).alias("same"))
    return out.withColumn("share", F.col("same") / F.nullif(F.col("labelled"), F.lit(0)))


def label_ring(nodes: DataFrame, node: str, label: str) -> DataFrame:
    """Each label's nodes linked to the next, the last to the first."""
    w = Window.partitionBy(label).orderBy(node)
    return nodes.select(F.col(node).alias("src"), F.coalesce(F.lead(node).over(w), F.first(node).over(w)).alias("dst"))


def _normalised(edges: DataFrame) -> DataFrame:
    """(src, dst, weight, norm): equal edges added up, a loop of weight 1 at each node in place of its own ones."""
    plain = edges.where("src <> dst").groupBy("src", "dst").agg(F.sum("weight").cast("double").alias("weight"))
    loops = edges.select(F.explode(F.array("src", "dst")).alias("src")).distinct().select("src", F.col("src").alias("dst"), F.lit(1.0).alias("weight"))
    a = plain.unionByName(loops)
    d = a.groupBy("src").agg(F.sum("weight").alias("d"))
    return a.join(d, "src").join(d.select(F.col("src").alias("dst"), F.col("d").alias("d2")), "dst").select("src", "dst", "weight", (F.col("weight") / F.sqrt(F.col("d") * F.col("d2"))).alias("norm"))


def _normalised_once(half: DataFrame) -> DataFrame:
    """The same of edges that are there once, src < dst, and mean both directions: degrees meet an edge once, in tasks by
    the rows. half is read several times."""
    n = tasks_for(half)
    half = half.select("src", "dst", F.col("weight").cast("double").alias("weight"))
    d = half.select(F.explode(F.array("src", "dst")).alias("src"), "weight").groupBy("src").agg((F.sum("weight") + 1.0).alias("d"))
    met = half.repartition(n, "src").join(d, "src").repartition(n, "dst").join(d.select(F.col("src").alias("dst"), F.col("d").alias("d2")), "dst")
    met = met.select("src", "dst", "weight", (F.col("weight") / F.sqrt(F.col("d") * F.col("d2"))).alias("norm"))
    loops = d.select("src", F.col("src").alias("dst"), F.lit(1.0).alias("weight"), (1.0 / F.sqrt(F.col("d") * F.col("d"))).alias("norm"))
    return mirrored(met).unionByName(loops)


def _kept(edges: DataFrame) -> DataFrame:
    from binloom.sources.store import Scratch

    return Scratch(edges.sparkSession).keep(edges, last=True)


def normalised_adjacency(edges: DataFrame, once: bool = False, dealt: bool = False) -> DataFrame:
    """D^-1/2 A D^-1/2 with the diagonal set to 1; equal edges are added up first. With `once` each edge is there once,
    src < dst, and means both directions; `dealt` has the rows by dst in tasks by their number, for a join on dst."""
    if not once:
        return _normalised(edges).select("src", "dst", "norm")
    half = _kept(edges)
    out = _normalised_once(half).select("src", "dst", "norm")
    return out.repartition(2 * tasks_for(half), "dst") if dealt else out


def weighted_adjacency(edges: DataFrame, once: bool = False) -> DataFrame:
    """The normalised adjacency times weight over largest weight; 1 on the diagonal. `once` as above."""
    edges = _kept(edges) if once else edges
    summed = edges if once else edges.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    top = summed.agg(F.max(F.col("weight").cast("double")).alias("top"))
    value = F.when(F.col("src") == F.col("dst"), 1.0).otherwise(F.col("norm") * F.col("weight") / F.col("top"))
    rows = _normalised_once(edges) if once else _normalised(edges)
    return rows.crossJoin(F.broadcast(top)).select("src", "dst", value.alias("value"))  # a single row


def with_loops(adjacency: DataFrame, nodes: DataFrame, node: str, value: str) -> DataFrame:
    """The adjacency and a loop of value 1 at each node that has no edge in it."""
    alone = nodes.select(F.col(node).alias("src")).join(adjacency.select("src"), "src", "left_anti")
    return adjacency.select("src", "dst", value).unionByName(alone.select("src", F.col("src").alias("dst"), F.lit(1.0).alias(value)))


def propagate(adjacency: DataFrame, features: DataFrame, value: str, columns: list[str], node: str) -> DataFrame:
    """(src, columns): sums of the neighbours' features by the adjacency's values, one graph convolution without weights."""
    x = features.select(F.col(node).alias("dst"), *[F.col(c).alias(f"__{c}") for c in columns])
    return adjacency.join(x, "dst").groupBy("src").agg(*[F.sum(F.col(value) * F.col(f"__{c}")).alias(c) for c in columns])


def attention(edges: DataFrame, scores: DataFrame, node: str, left: str, right: str) -> DataFrame:
    """(src, dst, alpha): softmax over each src's edges of leaky_relu(w (left(src) + right(dst))), slope 0.2."""
    a, b = scores.select(F.col(node).alias("src"), F.col(left).alias("l")), scores.select(F.col(node).alias("dst"), F.col(right).alias("r"))
    e = edges.join(a, "src").join(b, "dst").withColumn("e", G.leaky_relu(F.col("weight") * (F.col("l") + F.col("r"))))
    w = Window.partitionBy("src")
    e = e.withColumn("x", F.exp(F.col("e") - F.max("e").over(w)))
    return e.select("src", "dst", (F.col("x") / F.sum("x").over(w)).alias("alpha"))


def components(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """(node, component): the least node reachable. Nodes are of any type that orders. With `rounds` it raises where more are needed.

    By star rounds: in the first half of a round every node passes its larger neighbours to the least one, in the second it
    passes itself and its smaller ones there, until all of a component point to its least node. A node's minimum is
    aggregated in each task first, and both sides of its join are written, so Spark splits a hub's rows among tasks.
    """
    from binloom.sources.store import Scratch

    scratch = Scratch(edges.sparkSession)
    nodes = scratch.keep(edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct())
    pairs = scratch.keep(edges.where("src <> dst").select(F.greatest("src", "dst").alias("high"), F.least("src", "dst").alias("low")).distinct())
    for done in itertools.count(1):
        near = pairs.select(F.col("high").alias("a"), F.col("low").alias("b")).unionByName(pairs.select(F.col("low").alias("a"), F.col("high").alias("b")))
        least = scratch.keep(near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = scratch.keep(near.where("b > a").join(least, "a").select(F.col("b").alias("high"), F.col("m").alias("low")).distinct())
        root = scratch.keep(large.groupBy("high").agg(F.min("low").alias("m")))
        small = large.join(root, "high").where("low <> m").select(F.col("low").alias("high"), F.col("m").alias("low")).unionByName(root.select("high", F.col("m").alias("low")))
        small = scratch.keep(small.distinct())
        if small.count() == pairs.count() and small.join(pairs, ["high", "low"], "left_anti").isEmpty():
            break
        if done == rounds:
            scratch.clear()
            raise RuntimeError(f"components still change after {rounds} rounds")
        pairs = small
    out = scratch.keep(nodes.join(small, nodes["node"] == small["high"], "left").select("node", F.coalesce("low", "node").alias("component")), last=True)
    scratch.clear()
    return out


def _cut(df: DataFrame) -> DataFrame:
    from binloom.sources.store import durable

    return durable(df)


def _in_slots(rows: DataFrame, node: str, size: Column, seed: int, groups: int) -> DataFrame:
    """rows with `to`, the running sum of `size` in the order of (slot, node), and `all`, the sum of every row.

    A slot is drawn from the node; sums run inside a slot and start where the slots before it end, so that only the slots'
    sums are sorted in one task."""
    hashed = rows.withColumn("__size", size).withColumn("__slot", G.draw(node, seed) % groups)
    sums = hashed.groupBy("__slot").agg(F.sum("__size").alias("__n"))
    before = Window.orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)  # a row a slot
    whole = Window.partitionBy()
    starts = sums.select("__slot", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"), F.sum("__n").over(whole).alias("all"))
    inside = Window.partitionBy("__slot").orderBy(node).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = hashed.withColumn("__inside", F.sum("__size").over(inside)).join(F.broadcast(starts), "__slot")  # a row a slot
    return out.withColumn("to", F.col("__start") + F.col("__inside")).drop("__slot", "__start", "__inside", "__size")


def _drawn(edges: DataFrame, per_edge: int) -> DataFrame:
    return edges.select("src", F.col("dst").alias("old"), F.explode(F.sequence(F.lit(1), F.lit(per_edge))).alias("k"))


def met_stretches(points: DataFrame, stretches: DataFrame, keys: list[str], share: int = 16) -> DataFrame:
    """points (keys, point, ...) joined with the stretch (keys, from, to, ...) of their keys they fall in, from <= point < to.

    Both meet by bucket: as many a key as it has stretches over `share`; a stretch is in each bucket it reaches into, so a
    bucket has few, however many a key has, and a long one is in many."""
    sizes = stretches.groupBy(*keys).agg(F.max("to").alias("__all"), F.ceil(F.count(F.lit(1)) / share).alias("__buckets"))
    sizes = sizes.select(*keys, F.ceil(F.col("__all") / F.col("__buckets")).cast("long").alias("__width"))
    if keys:
        points, stretches = points.join(sizes, keys), stretches.join(sizes, keys)
    else:
        points, stretches = (df.crossJoin(F.broadcast(sizes)) for df in (points, stretches))  # a single row
    bucket = lambda at: F.floor(at / F.col("__width")).cast("long")
    spread = stretches.withColumn("__bucket", F.explode(F.sequence(bucket(F.col("from")), bucket(F.col("to") - 1)))).drop("__width")
    met = points.withColumn("__bucket", bucket(F.col("point"))).drop("__width").join(spread, [*keys, "__bucket"])
    return met.where((F.col("from") <= F.col("point")) & (F.col("point") < F.col("to"))).drop("__bucket", "from", "to", "point")


def negative_edges(edges: DataFrame, nodes: DataFrame, node: str, per_edge: int, seed: int, groups: int = 1024) -> DataFrame:
    """(src, dst, k): for each edge, `per_edge` ends drawn evenly among the nodes, by md5, so that reruns agree."""
    ranked = _in_slots(nodes.select(F.col(node).alias("dst")), "dst", F.lit(1).cast("long"), seed, groups)
    width = nodes.agg(F.count(F.lit(1)).alias("width"))
    drawn = _drawn(edges, per_edge).crossJoin(F.broadcast(width))  # a single row
    drawn = drawn.withColumn("rank", G.draw("src", "old", "k", seed) % F.col("width"))
    return drawn.join(ranked.select("dst", (F.col("to") - 1).alias("rank")), "rank").select("src", "dst", "k")


def weighted_negatives(edges: DataFrame, per_edge: int, seed: int, power: float = 0.75, groups: int = 1024, once: bool = False) -> DataFrame:
    """(src, dst, k): for each edge, `per_edge` ends drawn with the probability of in-degree ** power (to a millionth), by md5.

    Each node has a stretch as long as its weight, in the order of slots and names; a drawn point meets the one it is in.
    With `once` each edge is there once, src < dst, and means both directions."""
    edges = _kept(edges.select("src", "dst"))  # else they are made for each of the steps below
    ends = F.explode(F.array("src", "dst")).alias("dst") if once else F.col("dst")
    size = F.floor(F.pow(F.col("n").cast("double"), F.lit(power)) * 1_000_000).cast("long")
    placed = _kept(_in_slots(edges.select(ends).groupBy("dst").agg(F.count(F.lit(1)).alias("n")), "dst", size, seed, groups))
    total = placed.agg(F.max("all").alias("all"))
    drawn = _drawn(mirrored(edges) if once else edges, per_edge).crossJoin(F.broadcast(total))  # a single row
    points = drawn.select("src", "k", (G.draw("src", "old", "k", seed) % F.col("all")).alias("point"))
    return met_stretches(points, placed.select("dst", (F.col("to") - size).alias("from"), "to"), []).select("src", "dst", "k")


def inverse_weight_negatives(edges: DataFrame, per_edge: int, seed: int, by_source: bool = False) -> DataFrame:
    """(src, dst, k): for each edge, `per_edge` ends drawn among the neighbours of its source, with the probability of one
    over the weight (to a millionth): the ends that are linked least.

    A source's edges stand in one task in the order of dst, as they already do with `by_source` (but for the order); points
    are looked up in the running sums of whole runs of sources. Memory of a task is that of a batch or of a source's edges."""
    size = F.greatest(F.floor(1_000_000 / F.col("weight")).cast("long"), F.lit(1).cast("long"))
    kept = edges.where("src <> dst").select("src", "dst", size.alias("size"), *[G.draw("src", "dst", F.lit(k), seed).alias(f"draw_{k}") for k in range(1, per_edge + 1)])
    kept = (kept if by_source else kept.repartition(2 * tasks_for(edges), "src")).sortWithinPartitions("src", "dst")

    def drawn(runs: pa.Table) -> Iterator[pa.RecordBatch]:
        src, dst = (runs.column(c).combine_chunks() for c in (0, 1))
        starts = np.concatenate([[0], np.flatnonzero(pc.not_equal(src[1:], src[:-1]).to_numpy(zero_copy_only=False)) + 1])
        to = np.cumsum(runs.column(2).to_numpy())
        before = np.concatenate([[0], to])[starts]
        each = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(to))))
        all_ = np.append(before[1:], to[-1]) - before
        for k in range(1, per_edge + 1):
            point = before[each] + runs.column(2 + k).to_numpy() % all_[each]
            met = pa.Table.from_arrays([src, dst.take(pa.array(np.searchsorted(to, point, side="right"))), pa.array(np.full(len(to), k, np.int32))], ["src", "dst", "k"])
            yield from met.to_batches(max_chunksize=1 << 16)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # of the sources before the last one all edges are there
        for one in batches:
            if not one.num_rows:
                continue
            last = int(pc.index(one.column(0), one.column(0)[-1]).as_py())
            if last or (held and held[-1].column(0)[-1] != one.column(0)[0]):
                yield from drawn(pa.Table.from_batches([*held, one.slice(0, last)]))
                held = []
            held.append(one.slice(last))
        if held:
            yield from drawn(pa.Table.from_batches(held))

    return kept.mapInArrow(kernel, f"src {edges.schema['src'].dataType.simpleString()}, dst {edges.schema['dst'].dataType.simpleString()}, k int")


def sample_neighbours(edges: DataFrame, fan_out: int, seed: int) -> DataFrame:
    """At most fan_out edges of each src, drawn by weight (exponential keys from md5)."""
    u = (G.draw("src", "dst", seed) % (1 << 30) + 0.5) / float(1 << 30)
    w = Window.partitionBy("src").orderBy(-F.ln(u) / F.col("weight"), "dst")
    return edges.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= fan_out).drop("__k")


def sample_levels(edges: DataFrame, seeds: DataFrame, node: str, fan_outs: list[int], seed: int) -> DataFrame:
    """(level, src, dst, weight): layers of sampled edges. Level 0 draws fan_outs[0] neighbours of each seed; each next one
    draws for all nodes so far, the seeds and what was drawn for them, anew."""
    frontier, out = seeds.select(F.col(node).alias("src")).distinct(), None
    for level, fan_out in enumerate(fan_outs):
        drawn = sample_neighbours(edges.join(frontier, "src", "left_semi").select("src", "dst", "weight"), fan_out, seed + level)
        drawn = _cut(drawn.select(F.lit(level).alias("level"), "src", "dst", "weight"))
        frontier = frontier.unionByName(drawn.select(F.col("dst").alias("src"))).distinct()
        out = drawn if out is None else out.unionByName(drawn)
    return out


def undirected_edges(links: DataFrame, contigs: DataFrame, min_length: int = 1000, root: str | None = None) -> DataFrame:
    """(src, dst) by name, each pair once, the lower name first; with a root, also (root, name) of every contig kept."""
    ok = contigs.where(F.col("length") >= min_length).select("name")
    kept = links.join(ok.withColumnRenamed("name", "src"), "src", "left_semi").join(ok.withColumnRenamed("name", "dst"), "dst", "left_semi")
    out = kept.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    return out if root is None else out.unionByName(ok.distinct().select(F.lit(root).alias("src"), F.col("name").alias("dst")))


def edges_over(edges: DataFrame, least: float) -> DataFrame:
    """Edges of weight `least` and more; a negative bound stands for the mean weight."""
    if least >= 0:
        return edges.where(F.col("weight") >= least)
    return edges.crossJoin(F.broadcast(edges.agg(F.avg("weight").alias("__mean")))).where("weight >= __mean").drop("__mean")  # a single row


def without_nodes(edges: DataFrame, gone: DataFrame, node: str) -> DataFrame:
    """Edges with neither end among the nodes that go."""
    ends = gone.select(F.col(node).alias("src")).distinct()
    return edges.join(ends, "src", "left_anti").join(ends.withColumnRenamed("src", "dst"), "dst", "left_anti").select(*edges.columns)


def linked_and_marked(nodes: DataFrame, edges: DataFrame, markers: DataFrame, key: str) -> DataFrame:
    """Nodes that have another node as neighbour and at least one marker."""
    return connected_only(nodes, edges.where("src <> dst"), key).join(markers.select(key), key, "left_semi")


def replace_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    """The new edges, and those old ones whose source has none among the new."""
    return edges.join(new.select("src"), "src", "left_anti").select(*edges.columns).unionByName(new.select(*edges.columns))


def edge_similarity(edges: DataFrame, over: float = 2, cap: int = 150) -> DataFrame:
    """(src, dst, weight, cosine, shares): a row for each undirected edge of weight above `over`, weights up to the cap.

    edges holds (src, dst, weight, cosine, overlap), overlap the number of markers that both ends have.
    """
    e = edges.where((F.col("src") < F.col("dst")) & (F.col("weight") > over))
    return e.select("src", "dst", F.least(F.col("weight"), F.lit(cap)).alias("weight"), "cosine", (F.col("overlap") > 0).alias("shares"))


def similarity_histogram(similar: DataFrame, bins: int = 50) -> DataFrame:
    """(bin, low, n) of the cosines of edges whose ends share no marker: `bins` equal parts from the least to the largest,
    the last one closed; empty parts are left out."""
    c = similar.where(~F.col("shares")).select("cosine")
    ends = c.agg(F.min("cosine").alias("least"), F.max("cosine").alias("most"))
    at = F.when(F.col("most") > F.col("least"), F.least(F.floor((F.col("cosine") - F.col("least")) / (F.col("most") - F.col("least")) * bins), F.lit(bins - 1))).otherwise(0).cast("int")
    counted = c.crossJoin(F.broadcast(ends)).groupBy(at.alias("bin"), "least", "most").agg(F.count(F.lit(1)).alias("n"))  # a single row
    return counted.select("bin", (F.col("least") + (F.col("most") - F.col("least")) * F.col("bin") / bins).alias("low"), "n")


def density(edges: DataFrame) -> DataFrame:
    """One row (nodes, edges, density) of the undirected graph without self loops; nodes are the ends of edges."""
    pairs = edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    n = pairs.select(F.explode(F.array("a", "b")).alias("node")).agg(F.countDistinct("node").alias("nodes"))
    out = n.crossJoin(F.broadcast(pairs.agg(F.count(F.lit(1)).alias("edges"))))  # single rows
    return out.withColumn("density", 2 * F.col("edges") / F.nullif(F.col("nodes") * (F.col("nodes") - 1), F.lit(0)))


def component_labels(members: DataFrame, labels: DataFrame, node: str, label: str) -> DataFrame:
    """(component, nodes, labels): sizes of components and the number of different labels in each; more than 1 is mixed."""
    known = members.join(labels.select(F.col(node).alias("node"), label), "node", "left")
    return known.groupBy("component").agg(F.count(F.lit(1)).alias("nodes"), F.countDistinct(label).alias("labels"))
