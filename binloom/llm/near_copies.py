"""Near copies for the pipeline: SimHash of 5-word shingles, found by trie self-joins, linked at a Jaccard similarity >= 0.8.

The SimHash operator as a filter of documents. At 0.8 two 64-bit fingerprints differ in ten bits, too many to prune by, so
a fingerprint has several words and is read in `views`, each of its own few bits: two sets of similarity s differ
in a bit with probability p = arccos(2s / (1 + s)) / pi, and the views are as many as make it likely (RECALL) that a pair of
exactly 0.8 is within the budget of 2 bits in one of them. A view has as many bits as leave a document few unlike ones
within that budget, so bits and views follow from the number of documents (`plan_views`).

1. Documents of equal shingle sets are merged, by a 128-bit digest of the set.
2. In each view the sets are range-sorted by key and fingerprint. Neighbours of one key are candidates; the first of a
   key in a task stands for it. So a key that a third of all sets share is one sorted run over many tasks.
3. Those that stand for a key meet in the trie self-join of simhash.py. Of the pairs within the budget, those whose first
   two words are too far apart for the similarity go, and the nearest that connect the others stay (FORESTS disjoint
   spanning forests in the order of distance): candidates grow with the documents, never with their pairs.
4. Candidates are checked exactly on their two texts, each set's nearest one first; one inside a component found so
   is spared. Links of similarity >= 0.8 make the components.
5. What views, judged words and forests leave out is found exactly: two sets of the similarity share a shingle among the
   first of each in any one order of shingles (n - ceil(0.8 n) + 1 of n). Sets of unlike components that share one are
   candidates, unless their sizes, the places of the shingle, or the parities of their shingles in PARITY classes prove
   them less similar; then parities in more classes than they have shingles judge, and the rest is checked on the texts. So
   the views only spare work, and no link between components is left out.

Texts stay where they are but for those of candidates, and rows but for those of components of several: which these may
be is told to the tasks by a bounded filter, and an exact join decides.

The order has shingles that are frequent in a sample last, which makes few meet; any order gives the same result. A shingle
of many sets is dealt to blocks of sets that meet two by two, so no task has all of it.

Defined results: words are as in simhash.py; a text of fewer words than a shingle is one shingle; null, empty and
white-space texts have the empty set and are copies of each other; of a component stays the row of the smallest id (null
last, then by the text's digest; of rows of equal id and text, one); an empty table gives an empty result; columns keep
their names, whatever these are.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binloom.llm.common import asked, durable, durable_table, pick, remove, row_identity, spread, utf8, written
from binloom.llm.simhash import BITS, CROWD, TASK_ROWS, components, majority, pairs_of, shingle_hashes, subtrees

SHINGLE, SIMILARITY, BUDGET, RECALL = 5, 0.8, 2, 0.98
#: Disjoint forests of candidates that a subtree gives, so that a pair is not lost to one third text.
FORESTS = 3
#: Words whose distance a candidate is judged by, and by how many standard deviations it may be over the mean at SIMILARITY.
JUDGED, SLACK = 2, 3.5
#: Texts whose shingles are counted for the order of shingles, in how many of them one is frequent, and how many such are kept.
SAMPLE, FREQUENT, LISTED = 10_000, 3, 100_000
#: Classes of shingles whose parities bound a difference of sets; sets of a shingle that meet in one block.
PARITY, MEET = 512, 1024


def bit_rate(similarity: float) -> float:
    """How often two sets of a Jaccard similarity differ in a bit of their fingerprints."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def plan_views(n: int, similarity: float = SIMILARITY, budget: int = BUDGET, recall: float = RECALL) -> tuple[int, int]:
    """(bits, views): bits such that n sets give a set about one unlike one in the budget; views for the recall."""
    bits = min(BITS, max(16, math.ceil(math.log2(max(2, n))) + 8))
    p = bit_rate(similarity)
    seen = sum(math.comb(bits, k) * p**k * (1 - p) ** (bits - k) for k in range(budget + 1))
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - seen)))


def farthest(similarity: float) -> int:
    """Differing bits of the judged words beyond which a pair is taken to be less similar."""
    p, n = bit_rate(similarity), BITS * JUDGED
    return math.floor(n * p + SLACK * math.sqrt(n * p * (1 - p)))


def frequent_shingles(docs: DataFrame, n: int) -> np.ndarray:
    """The shingles that are frequent in a sample of n documents, the rarest first; they order shingles, nothing else."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(shingle_hashes(text.as_py(), SHINGLE)).view(np.int64))], ["h"])

    some = docs.select(utf8("text").alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(max(1, n // SAMPLE))) == 0).distinct()
    counted = some.mapInArrow(kernel, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= FREQUENT)
    most = counted.orderBy(F.desc("n"), "h").limit(LISTED).collect()  # LISTED rows at most
    return np.array([r["h"] for r in reversed(most)], np.int64).view(np.uint64)


def prefix_length(size: int, similarity: float) -> int:
    """Shingles of a set, the first in the order, of which any unlike set of the similarity has one in its own; 0 without such."""
    return size - math.ceil(similarity * size - 1e-9) + 1 if size + 1e-9 >= similarity * (size + 1) else 0


_PARITIES = [f"parity_{k}" for k in range(PARITY // 64)]


def shingle_sets(docs: DataFrame, words: int, similarity: float = SIMILARITY, frequent: np.ndarray | None = None) -> DataFrame:
    """(doc_id, row, set_1, set_2, size, print, prefix, parities): of each row its identity, and its set's digest, size,
    fingerprint, first shingles in the order (frequent ones last) and parities."""
    known = np.zeros(0, np.uint64) if frequent is None else frequent
    place = np.argsort(known)
    known = known[place]

    def first(some: np.ndarray) -> np.ndarray:
        length = prefix_length(len(some), similarity)
        if length and len(known):
            at = np.minimum(np.searchsorted(known, some), len(known) - 1)
            some = some[np.argsort(np.where(known[at] == some, place[at], -1), kind="stable")]
        return some[:length].view(np.int64)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, sizes, prints = np.zeros((batch.num_rows, 2), np.uint64), np.zeros(batch.num_rows, np.int32), []
            parities, prefixes = np.zeros((batch.num_rows, PARITY // 8), np.uint8), []
            for k in range(batch.num_rows):
                some = np.unique(shingle_hashes(batch.column(2)[k].as_py(), SHINGLE))
                x = xxhash.xxh3_128_intdigest(some.tobytes())
                digests[k], sizes[k] = (x >> 64, x & (1 << 64) - 1), len(some)
                prints.append(majority(some, words).tobytes())
                prefixes.append(first(some))
                parities[k] = np.packbits(np.bincount((some & np.uint64(PARITY - 1)).astype(np.int64), minlength=PARITY) & 1)
            columns = [*batch.columns[:2], *(pa.array(digests[:, k].copy().view(np.int64)) for k in (0, 1)), pa.array(sizes), pa.array(prints, pa.binary())]
            columns += [pa.array(prefixes, pa.list_(pa.int64())), *(pa.array(c.copy()) for c in parities.view(np.int64).T)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row", "set_1", "set_2", "size", "print", "prefix", *_PARITIES])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_identity("doc_id", "text").alias("row"), utf8("text").alias("text"))
    return rows.mapInArrow(kernel, "doc_id long, row binary, set_1 long, set_2 long, size int, print binary, prefix array<long>, " + ", ".join(f"{c} long" for c in _PARITIES))


_VIEW = ["view", "key", "w1", "w2", "size", "node"]


def viewed(sets: DataFrame, bits: int, views: int) -> DataFrame:
    """(view, key, w1, w2, size, node) of (node, size, print): the fingerprint, a row for each view of it."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            full = np.flatnonzero(batch.column(1).to_numpy() > 0)  # the empty set is like no other
            if not len(full):
                continue
            nodes, sizes = (batch.column(k).to_numpy()[full] for k in (0, 1))
            prints = np.stack([np.frombuffer(batch.column(2)[k].as_py(), np.uint64) for k in full.tolist()])
            loose = np.unpackbits(prints.astype(">u8").view(np.uint8), axis=1)
            for v in range(views):
                key = np.zeros((len(full), BITS), np.uint8)
                key[:, BITS - bits :] = loose[:, v * bits : (v + 1) * bits]
                key = np.packbits(key, axis=1).view(">i8").ravel().astype(np.int64)
                columns = [np.full(len(full), v, np.int32), key, prints[:, 0].view(np.int64), prints[:, 1].view(np.int64), sizes, nodes]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns)], _VIEW)

    return sets.select("node", "size", "print").mapInArrow(kernel, "view int, key long, w1 long, w2 long, size int, node long")


class Judge:
    """What a task has of sets, and which pairs of them may be similar enough."""

    def __init__(self, w1: np.ndarray, w2: np.ndarray, size: np.ndarray, similarity: float):
        self.w1, self.w2, self.size, self.similarity, self.most = w1, w2, size, similarity, farthest(similarity)

    def distance(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Differing bits of the judged words; 255 for pairs that are no candidates."""
        d = np.bitwise_count(self.w1[i] ^ self.w1[j]).astype(np.int64) + np.bitwise_count(self.w2[i] ^ self.w2[j])
        low, high = np.minimum(self.size[i], self.size[j]), np.maximum(self.size[i], self.size[j])
        return np.where((d <= self.most) & (low >= self.similarity * high), d, 255)


def nearest_forests(pairs: Iterator[tuple[np.ndarray, np.ndarray]], judge: Judge, forests: int = FORESTS) -> np.ndarray:
    """(distance, i, j) of the candidates among the pairs that are in one of `forests` disjoint spanning forests, each
    built in the order of distance; blocks of pairs are merged in one by one, so memory stays with the nodes."""
    kept = np.zeros((0, 3), np.int64)
    for i, j in pairs:
        d = judge.distance(i, j)
        ok = d < 255
        if not ok.any():
            continue
        both = np.concatenate([kept, np.stack([d[ok], i[ok], j[ok]], axis=1)])
        both = both[np.lexsort((both[:, 2], both[:, 1], both[:, 0]))]
        nodes, flat = np.unique(both[:, 1:], return_inverse=True)
        parents, take = [list(range(len(nodes))) for _ in range(forests)], []
        for k, ends in enumerate(flat.reshape(-1, 2).tolist()):
            for parent in parents:
                x, y = ends
                while parent[x] != x:
                    parent[x] = x = parent[parent[x]]
                while parent[y] != y:
                    parent[y] = y = parent[parent[y]]
                if x != y:
                    parent[x] = y
                    take.append(k)
                    break
        kept = both[take]
    return kept


def candidates(sets: DataFrame, bits: int, similarity: float = SIMILARITY, crowd: int = CROWD) -> DataFrame:
    """(a, b, distance): pairs of nodes of (view, key, w1, w2, size, node) that may be similar enough, forests of each subtree."""
    spark, n = sets.sparkSession, sets.count()
    tasks = max(spread(spark), n // TASK_ROWS + 1)

    def line(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Neighbours in the sorted run that may be similar, as (node, other); and, other null, the first of each key."""
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            own = [batch.column(k).to_numpy() for k in range(6)]
            view, key, w1, w2, size, node = own if last is None else [np.concatenate([[x], y]) for x, y in zip(last, own)]
            same = (view[1:] == view[:-1]) & (key[1:] == key[:-1])
            judge = Judge(w1.view(np.uint64), w2.view(np.uint64), size, similarity)
            at = np.flatnonzero(same)
            gap = judge.distance(at, at + 1)
            at, gap = at[gap < 255], gap[gap < 255]
            head = np.flatnonzero(~same) + 1 if last is not None else np.concatenate([[0], np.flatnonzero(~same) + 1])
            columns_ = [np.concatenate([x[at], x[head]]) for x in (view, key, w1, w2, size, node)]
            none = np.arange(len(at) + len(head)) >= len(at)
            other, gap = (pa.array(np.concatenate([x, np.zeros(len(head), np.int64)]), mask=none) for x in (node[at + 1], gap))
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns_), other, gap], [*_VIEW, "other", "distance"])
            last = [x[-1] for x in own]

    order = ["view", "key", "w1", "w2", "node"]
    lined = durable_table(sets.repartitionByRange(tasks, *order).sortWithinPartitions(*order).mapInArrow(line, "view int, key long, w1 long, w2 long, size int, node long, other long, distance long"))
    neighbours = lined.where("other is not null").select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b"), "distance")
    dealt, masks = subtrees(lined.where("other is null").drop("other", "distance"), bits, BUDGET, 1, crowd, ("view",))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        choice, view, key, w1, w2, size, node = (np.concatenate([b.column(k).to_numpy() for b in got]) for k in range(7))
        for c, v in sorted(set(zip(choice.tolist(), view.tolist()))):
            at = np.flatnonzero((choice == c) & (view == v))
            judge = Judge(w1[at].view(np.uint64), w2[at].view(np.uint64), size[at], similarity)
            got = nearest_forests(pairs_of(key[at].view(np.uint64), masks[c], bits, BUDGET), judge)
            ends = node[at][got[:, 1:]]
            yield pa.RecordBatch.from_arrays([pa.array(ends.min(axis=1)), pa.array(ends.max(axis=1)), pa.array(got[:, 0].copy())], ["a", "b", "distance"])

    met = dealt.repartition(max(tasks, 3 * n // TASK_ROWS + 1), "choice", "view", "shared").select("choice", *_VIEW).mapInArrow(walk, "a long, b long, distance long")
    return neighbours.unionByName(met).where("a <> b").distinct()


def both_ends(edges: DataFrame, of: DataFrame, read: Callable, holds: Callable) -> DataFrame:
    """The edges (a, b) for which holds(x, y), of what `read` makes of the bytes that `of` (node, data) has of either end."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok, last, one = np.zeros(batch.num_rows, bool), None, None
            for k in range(batch.num_rows):
                node = batch.column(1)[k].as_py()
                if node != last:  # the edges of one node mostly follow each other
                    last, one = node, read(batch.column(3)[k].as_py())
                ok[k] = holds(one, read(batch.column(2)[k].as_py()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(ok))

    left, right = (of.toDF(node, data) for node, data in (("a", "x"), ("b", "y")))
    return edges.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(kernel, "a long, b long")


def verified(edges: DataFrame, texts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The edges (a, b) whose texts' sets of shingles have at least the similarity."""

    def holds(one: np.ndarray, two: np.ndarray) -> bool:
        both = len(np.intersect1d(one, two, assume_unique=True))
        return both >= similarity * (len(one) + len(two) - both) - 1e-9

    return both_ends(edges, texts, lambda text: np.unique(shingle_hashes(text, SHINGLE)), holds)


def sketch(text: bytes) -> bytes:
    """The size of a text's set of shingles and its parities, in two to four times as many classes as it has shingles."""
    some = np.unique(shingle_hashes(text, SHINGLE))
    classes = 1 << max(4, (2 * len(some)).bit_length())
    odd = np.bincount((some & np.uint64(classes - 1)).astype(np.int64), minlength=classes) & 1
    return len(some).to_bytes(8, "little") + np.packbits(odd).tobytes()


def sketches(texts: DataFrame) -> DataFrame:
    """(row, sketch) of texts (row, text)."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([sketch(x.as_py()) for x in batch.column(1)], pa.binary())], ["row", "sketch"])

    return texts.mapInArrow(kernel, "row binary, sketch binary")


def may_hold(one: bytes, two: bytes, similarity: float = SIMILARITY) -> bool:
    """Whether two sketches leave the similarity possible: sets differ in a shingle at least for each class that is unlike."""
    (m, x), (n, y) = ((int.from_bytes(s[:8], "little"), np.frombuffer(s, np.uint8, offset=8)) for s in (one, two))
    while len(x) != len(y):  # half as many classes: those that become one are added
        if len(x) > len(y):
            x = x[: len(x) // 2] ^ x[len(x) // 2 :]
        else:
            y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum()) <= (m + n) * (1 - similarity) / (1 + similarity) + 1e-6


def similar_components(edges: DataFrame, texts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(node, component) from the candidates (a, b, distance): first each node's nearest one is checked, then those
    that are left between components; one inside a component has nothing to add."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), "distance", F.col("b").alias("other")), F.struct(F.col("b").alias("node"), "distance", F.col("a").alias("other")))).alias("e")).select("e.*")
    nearest = ends.groupBy("node").agg(F.min(F.struct("distance", "other")).alias("m")).select(F.least("node", "m.other").alias("a"), F.greatest("node", "m.other").alias("b")).distinct()
    first = durable_table(verified(nearest, texts, similarity))
    label = components(first)
    at = lambda c: label.select(F.col("node").alias(c), F.col("component").alias(f"{c}_in"))
    left = edges.select("a", "b").join(nearest, ["a", "b"], "left_anti").join(at("a"), "a", "left").join(at("b"), "b", "left")
    left = left.where(F.coalesce("a_in", "a") != F.coalesce("b_in", "b")).select("a", "b")
    return components(first.unionByName(verified(left, texts, similarity)))


def left_between(sets: DataFrame, linked: DataFrame, similarity: float = SIMILARITY, meet: int = MEET) -> DataFrame:
    """(a, b): all pairs of sets (node, size, prefix, parities) of unlike components (node, component) that may have the
    similarity, none that has it left out."""
    tasks = max(spread(sets.sparkSession), sets.count() * 16 // TASK_ROWS + 1)
    component = F.coalesce("component", "node")
    told = asked(sets.select("node", "prefix"), "node", linked)
    alone = told.where(~F.col("asked")).select("node", "prefix", F.lit(None).cast("long").alias("component"))
    marks = alone.unionByName(told.where("asked").drop("asked").join(linked, "node", "left")).select(F.posexplode("prefix").alias("at", "mark"), "node", "component")
    marks = marks.select("mark", "node", "at", "component").repartition(tasks, "mark")  # sizes follow where marks are shared
    # The maximum that is not used has both sides read the same columns, so that they are shuffled once.
    unlike = marks.groupBy("mark").agg(F.count(F.lit(1)).alias("n"), F.min(component).alias("low"), F.max(component).alias("high"), F.max("at").alias("__at"))
    unlike = unlike.where("low <> high and __at is not null").select("mark", F.ceil(F.col("n") / meet).cast("int").alias("blocks"))
    live = durable_table(marks.join(unlike, "mark").withColumn("component", component))
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = live.join(sets.select("node", "size", *_PARITIES), "node").withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("mark", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "node", "size", "component", "at", *_PARITIES)
    x, y = (dealt.select("mark", "low", "high", *[F.col(c).alias(f"{side}_{c}") for c in ("block", "node", "size", "component", "at", *_PARITIES)]) for side in "xy")
    c = F.col
    both = c("x_size") + c("y_size")
    need = both * (similarity / (1 + similarity)) - 1e-6  # shingles that a pair of the similarity shares, at least
    apart = sum((F.bit_count(c(f"x_{p}").bitwiseXOR(c(f"y_{p}"))) for p in _PARITIES), F.lit(0))
    may = (c("x_component") < c("y_component")) & ((c("low") == c("high")) | (c("x_block") != c("y_block")))
    may &= (F.least("x_size", "y_size") + 1e-6 >= similarity * F.greatest("x_size", "y_size")) & (F.least(c("x_size") - c("x_at"), c("y_size") - c("y_at")) >= need) & (apart <= both - 2 * need)
    return x.join(y, ["mark", "low", "high"]).where(may).select(F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b")).distinct()


def near_copies(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, crowd: int = CROWD) -> DataFrame:
    """(doc_id, row, component) of every row: components of sets of shingles that are linked by the similarity."""
    n = docs.count()
    bits, views = plan_views(n, similarity, BUDGET, recall)
    full, all_rows = written(shingle_sets(docs, max(JUDGED, -(-bits * views // BITS)), similarity, frequent_shingles(docs, n)))
    rows = durable_table(full.select("doc_id", "row", "set_1", "set_2"))
    # A set of one row is a set already; others are merged. Numbers are fixed by writing them: a set has one from here on.
    of_set = ["size", "print", "prefix", *_PARITIES]
    told = asked(full.drop("doc_id"), "set_1", rows.groupBy("set_1").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    merged = told.where("asked").groupBy("set_1", "set_2").agg(F.min("row").alias("row"), *[F.first(c).alias(c) for c in of_set])
    sets = told.where(~F.col("asked")).drop("asked").unionByName(merged)
    sets = durable_table(sets.withColumn("node", F.monotonically_increasing_id()))
    remove(docs.sparkSession, all_rows)

    def ends(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The nodes of pairs with their rows (node, row), and the (row, text) that may be theirs."""
        known = durable_table(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(sets.select("node", "row"), "node"))
        some = docs.select(row_identity("doc_id", "text").alias("row"), utf8("text").alias("text"))
        return known, asked(some, "row", known).where("asked").drop("asked")

    def texts(pairs: DataFrame) -> tuple[DataFrame, str]:
        known, some = ends(pairs)
        return written(some.join(known, "row").dropDuplicates(["row"]).select("node", "text"))

    edges = durable_table(candidates(viewed(sets, bits, views), bits, similarity, crowd))
    some, path = texts(edges)
    linked = similar_components(edges, some, similarity)
    remove(docs.sparkSession, path)
    rest = durable_table(left_between(sets, linked, similarity))
    known, some = ends(rest)
    drawn = durable_table(sketches(some).join(known, "row").dropDuplicates(["row"]).select("node", "sketch"))
    rest = durable_table(both_ends(rest, drawn, bytes, lambda x, y: may_hold(x, y, similarity)))
    some, path = texts(rest)
    linked = components(linked.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(verified(rest, some, similarity)))
    remove(docs.sparkSession, path)
    label = sets.select("set_1", "set_2", "node").join(linked, "node", "left").select("set_1", "set_2", F.coalesce("component", "node").alias("component"))
    return rows.join(label, ["set_1", "set_2"]).select("doc_id", "row", "component")


def distinct_documents(docs: DataFrame, **options) -> DataFrame:
    """One row of each component of near copies, with the columns of docs."""
    found = durable_table(near_copies(docs, **options))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first")
    groups = durable_table(found.groupBy("component").agg(first, F.count(F.lit(1)).alias("n")).select("component", F.col("first.row").alias("kept"), "n"))
    grouped = found.join(groups.where("n > 1"), "component", "left_semi").select(F.col("row").alias("kept"))
    packed = docs.select(row_identity("doc_id", "text").alias("kept"), F.struct(*pick(docs.columns)).alias("whole"))
    told = asked(packed, "kept", durable_table(grouped))  # a row that no other is like stays without being moved
    chosen = told.where("asked").drop("asked").join(groups.select("kept"), "kept", "left_semi").dropDuplicates(["kept"])
    return told.where(~F.col("asked")).drop("asked").unionByName(chosen).select("whole.*")
