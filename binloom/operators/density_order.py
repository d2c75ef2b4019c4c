"""The density order of rows (a reachability plot) and its valleys, from a minimum spanning tree, in rounds of joins.

Two rows are as far apart as the largest of their distance and their core distances (to the `least`-th row near, itself
included). Edges count in the order of (weight, lower key, higher key), so the tree is one and the same however ties fall.
The order visits, from the lowest key, the cheapest edge out of what is visited: each row's reachability is that edge.

In the tree rooted at the start, let w(v) be the edge above v. When it is taken, all other open edges are dearer, so the
rows below v that cheaper edges lead to come right after v, as a block. Blocks nest: the one around v's is that of the
nearest ancestor with a dearer edge, and blocks in the same one come by rising w. So the order is the preorder of that
nesting, and no queue is needed: the tree is rooted by ranking its Euler tour, nearest dearer ancestors are found by
doubling steps, and the preorder is the ranking of another tour, each in about log2(rows) joins.

Rows that no edge reaches start anew, in the order of keys, with an infinite reachability. Keys are longs; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from binloom.operators.similarity import near_pairs
from binloom.sources.store import Scratch


def mutual_reachability(df: DataFrame, key: str, vector: str, least: int, radius: float, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """((node, core), (i, j, w)): core distances, null without `least` rows in the radius, and the pairs of rows with one."""
    near = scratch.keep(near_pairs(df, key, vector, radius))
    ends = near.unionByName(near.select(F.col("j").alias("i"), F.col("i").alias("j"), "distance")).select(F.col("i").alias("node"), "distance")
    ends = ends.unionByName(df.select(F.col(key).cast("long").alias("node"), F.lit(0.0).alias("distance")))
    rank = F.row_number().over(Window.partitionBy("node").orderBy("distance"))
    core = ends.withColumn("place", rank).where(F.col("place") <= least).groupBy("node").agg(F.max(F.when(F.col("place") == least, F.col("distance"))).alias("core"))
    known = core.where("core is not null")
    a, b = known.toDF("i", "ci"), known.toDF("j", "cj")
    return core, near.join(a, "i").join(b, "j").select("i", "j", F.greatest("distance", "ci", "cj").alias("w"))


def spanning_forest(edges: DataFrame, nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """(i, j, w) of the minimum spanning forest of edges i < j, by rounds in which each part takes its cheapest edge out."""
    parts = scratch.keep(nodes.select("node", F.col("node").alias("part")))
    edges, taken = scratch.keep(edges), []
    while True:
        both = edges.join(parts.toDF("i", "pi"), "i").join(parts.toDF("j", "pj"), "j").where("pi <> pj")
        edges = scratch.keep(both.select("i", "j", "w"))
        out = both.select(F.explode(F.array(F.struct(F.col("pi").alias("part"), F.col("pj").alias("to")), F.struct(F.col("pj").alias("part"), F.col("pi").alias("to")))).alias("e"), F.struct("w", "i", "j").alias("edge"))
        best = scratch.keep(out.groupBy("e.part").agg(F.min(F.struct("edge", "e.to")).alias("b")).select("part", "b.edge", "b.to"))
        if best.isEmpty():
            break
        taken.append(scratch.keep(best.select("edge.*").distinct()))
        # Each part points to the other end's part; of two that took the same edge the lower is the root.
        back = best.select(F.col("part").alias("to"), F.col("to").alias("back"))
        point = scratch.keep(best.join(back, "to", "left").select("part", F.when((F.col("back") == F.col("part")) & (F.col("part") < F.col("to")), F.col("part")).otherwise(F.col("to")).alias("root")))
        while True:
            up = point.select(F.col("part").alias("root"), F.col("root").alias("next"))
            step = scratch.keep(point.join(up, "root", "left").select("part", F.coalesce("next", "root").alias("root"), (F.coalesce("next", "root") != F.col("root")).alias("moved")))
            point = step.select("part", "root")
            if step.where("moved").isEmpty():
                break
        parts = scratch.keep(parts.join(point, "part", "left").select("node", F.coalesce("root", "part").alias("part")))
    tree = nodes.select(F.col("node").alias("i"), F.col("node").alias("j"), F.lit(0.0).alias("w")).limit(0)
    for some in taken:
        tree = tree.unionByName(some.select("i", "j", "w"))
    return scratch.keep(tree)


def suffix_sums(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, total): of lists (id, next, n), next null at an end, the sum of n from each element to the end, by doubling."""
    at = scratch.keep(links.select("id", "next", F.col("n").cast("long").alias("total")))
    while not at.where("next is not null").isEmpty():
        ahead = at.select(F.col("id").alias("next"), F.col("next").alias("after"), F.col("total").alias("more"))
        at = scratch.keep(at.join(ahead, "next", "left").select("id", F.col("after").alias("next"), (F.col("total") + F.coalesce("more", F.lit(0))).alias("total")))
    return at.select("id", "total")


def rooted(tree: DataFrame, root: int, scratch: Scratch) -> DataFrame:
    """(node, parent, edge) of every node but the root of a tree (i, j, w); edge is (w, i, j)."""
    edge = F.struct("w", "i", "j").alias("edge")
    arcs = tree.select(F.col("i").alias("u"), F.col("j").alias("v"), edge).unionByName(tree.select(F.col("j").alias("u"), F.col("i").alias("v"), edge))
    around = Window.partitionBy("u").orderBy("v")
    every = Window.partitionBy("u").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # After coming from u to v the tour goes on to v's next neighbour after u; at the root it ends behind the last one.
    following = arcs.select(F.col("u").alias("at"), F.col("v").alias("from"), F.coalesce(F.lead("v").over(around), F.when(F.col("u") != root, F.first("v").over(every))).alias("to"))
    tour = arcs.join(following, (F.col("v") == F.col("at")) & (F.col("u") == F.col("from")))
    links = tour.select(F.struct("u", "v").alias("id"), F.when(F.col("to").isNotNull(), F.struct(F.col("v").alias("u"), F.col("to").alias("v"))).alias("next"), F.lit(1).alias("n"))
    place = suffix_sums(links, scratch)
    down = arcs.join(place.select(F.col("id.u").alias("u"), F.col("id.v").alias("v"), F.col("total").alias("go")), ["u", "v"])
    down = down.join(place.select(F.col("id.v").alias("u"), F.col("id.u").alias("v"), F.col("total").alias("back")), ["u", "v"])
    return scratch.keep(down.where("go > back").select(F.col("v").alias("node"), F.col("u").alias("parent"), "edge"))


def nearest_dearer(down: DataFrame, root: int, scratch: Scratch) -> DataFrame:
    """(node, block): the nearest ancestor whose edge is dearer than the node's own; the root's is dearer than all."""
    level = scratch.keep(down.select("node", F.col("parent").alias("up"), "edge").join(down.select(F.col("node").alias("up"), F.col("edge").alias("most")), "up", "left").select("node", "up", F.when(F.col("up") != root, F.col("most")).alias("most")))
    levels = [level]  # up: the ancestor 2^k steps above; most: the dearest edge above those 2^k, null once the root is among them
    while not level.where("most is not null").isEmpty():
        ahead = level.toDF("up", "up2", "most2")
        level = scratch.keep(level.join(ahead, "up", "left").select("node", F.coalesce("up2", "up").alias("up"), F.when(F.col("most").isNotNull() & F.col("most2").isNotNull(), F.greatest("most", "most2")).alias("most")))
        levels.append(level)
    at = scratch.keep(down.select("node", F.col("node").alias("at"), "edge"))
    for level in reversed(levels):
        met = at.join(level.toDF("at", "up", "most"), "at", "left")
        at = scratch.keep(met.select("node", F.when(F.col("most") < F.col("edge"), F.col("up")).otherwise(F.col("at")).alias("at"), "edge"))
    return scratch.keep(at.join(down.select(F.col("node").alias("at"), "parent"), "at").select("node", F.col("parent").alias("block")))


def preorder(nested: DataFrame, root: int, scratch: Scratch) -> DataFrame:
    """(node, place, size): the visiting order of (node, block, edge), blocks in one by rising edge; the root is place 0."""
    children = Window.partitionBy("block").orderBy("edge")
    first = nested.groupBy("block").agg(F.min(F.struct("edge", "node")).alias("f")).select(F.col("block").alias("node"), F.col("f.node").alias("child"))
    every = nested.select("node", "block", F.lead("node").over(children).alias("sibling"))
    every = every.unionByName(nested.sparkSession.createDataFrame([(root, None, None)], "node long, block long, sibling long")).join(first, "node", "left")
    token = lambda node, leave: F.struct(node.alias("node"), F.lit(leave).alias("leave"))
    enter = every.select(token(F.col("node"), False).alias("id"), F.when(F.col("child").isNotNull(), token(F.col("child"), False)).otherwise(token(F.col("node"), True)).alias("next"), F.lit(1).alias("n"))
    leave = every.select(token(F.col("node"), True).alias("id"), F.when(F.col("sibling").isNotNull(), token(F.col("sibling"), False)).when(F.col("block").isNotNull(), token(F.col("block"), True)).alias("next"), F.lit(0).alias("n"))
    sums = suffix_sums(enter.unionByName(leave), scratch)
    both = sums.groupBy("id.node").agg(F.max(F.when(~F.col("id.leave"), F.col("total"))).alias("go"), F.max(F.when(F.col("id.leave"), F.col("total"))).alias("back"))
    total = nested.count() + 1
    return both.select("node", (F.lit(total) - F.col("go")).alias("place"), (F.col("go") - F.col("back")).alias("size"))


def density_order(df: DataFrame, key: str, vector: str, least: int = 5, radius: float = 0.5) -> DataFrame:
    """(key, place, reachability, core, size, block): the order from 0; reachability is infinite where a part begins, core
    null without `least` rows in the radius; size rows from place on form the row's block, inside the block of `block`."""
    spark, scratch = df.sparkSession, Scratch(df.sparkSession)
    core, edges = mutual_reachability(df, key, vector, least, radius, scratch)
    core = scratch.keep(core)
    nodes = core.select("node")
    lowest = nodes.agg(F.min("node")).first()[0]
    if lowest is None:
        return spark.createDataFrame([], f"`{key}` long, place long, reachability double, core double, size long, block long")
    root = lowest - 1
    tree = spanning_forest(edges, nodes, scratch)
    # A root of its own reaches the lowest key of each part, at an infinite price.
    parts = _parts(tree, nodes, scratch)
    starts = parts.groupBy("part").agg(F.min("node").alias("j")).select(F.lit(root).cast("long").alias("i"), "j", F.lit(float("inf")).alias("w"))
    down = rooted(scratch.keep(tree.unionByName(starts)), root, scratch)
    nested = scratch.keep(nearest_dearer(down, root, scratch).join(down.select("node", "edge"), "node"))
    placed = preorder(nested, root, scratch).join(nested, "node").join(core, "node")
    out = placed.select(F.col("node").alias(key), (F.col("place") - 1).alias("place"), F.col("edge.w").alias("reachability"), "core", "size", F.when(F.col("block") != root, F.col("block")).alias("block"))
    out = scratch.keep(out, last=True)
    scratch.clear()
    return out


def _parts(tree: DataFrame, nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, part) of a forest."""
    from binloom.operators.graph import components

    linked = scratch.keep(components(tree.select(F.col("i").alias("src"), F.col("j").alias("dst"))))
    return nodes.join(linked, "node", "left").select("node", F.coalesce("component", "node").alias("part"))


def _inside(order: DataFrame, key: str, chosen: Column, scratch: Scratch) -> DataFrame:
    """(node, bin): the innermost chosen block around each row, -1 without one, by doubling steps along the nesting."""
    at = scratch.keep(order.select(F.col(key).alias("node"), F.when(chosen, F.col(key)).alias("bin"), F.when(~chosen, F.col("block")).alias("up")))
    while not at.where("up is not null").isEmpty():
        ahead = at.toDF("up", "bin2", "up2")
        at = scratch.keep(at.join(ahead, "up", "left").select("node", F.coalesce("bin", "bin2").alias("bin"), F.col("up2").alias("up")))
    return at.select("node", F.coalesce("bin", F.lit(-1)).alias("bin"))


def valleys(order: DataFrame, key: str, least: int = 5, xi: float = 0.05) -> DataFrame:
    """(key, bin) from a density order: the innermost blocks of `least` rows and more whose every reachability inside is at
    most 1 - xi of the one that leads in; a bin is named by its block's first row, -1 is in none."""
    scratch = Scratch(order.sparkSession)
    inside = order.where("block is not null").groupBy(F.col("block").alias(key)).agg(F.max("reachability").alias("deepest"))
    marked = order.join(inside, key, "left").withColumn("valley", (F.col("size") >= least) & (F.coalesce("deepest", F.lit(0.0)) <= F.lit(1.0 - xi) * F.col("reachability")))
    marked = scratch.keep(marked)
    # A valley around another one gives way to it: mark all that have one further in, by the blocks around each valley.
    around = scratch.keep(_inside(marked.withColumn("valley", F.coalesce("valley", F.lit(False))), key, F.col("valley"), scratch))
    outer = marked.where("valley and block is not null").select(F.col("block").alias("node")).join(around, "node").where("bin <> -1").select("bin").distinct()
    kept = marked.join(outer.select(F.col("bin").alias(key), F.lit(True).alias("outer")), key, "left").withColumn("innermost", F.col("valley") & F.col("outer").isNull())
    # Rows of an outer valley outside the inner ones are in none.
    found = _inside(kept, key, F.col("valley"), scratch).join(kept.where("innermost").select(F.col(key).alias("bin"), F.lit(True).alias("ok")), "bin", "left")
    out = scratch.keep(found.select(F.col("node").alias(key), F.when(F.col("ok"), F.col("bin")).otherwise(F.lit(-1)).alias("bin")), last=True)
    scratch.clear()
    return out
