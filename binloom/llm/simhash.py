"""SimHash fingerprints and near-duplicate components by a self-join of the binary trie of fingerprints.

Equal fingerprints are merged before anything else, so copies by the thousand are one trie leaf. The bits are cut into
budget + 2 parts: two fingerprints that differ in no more bits than the budget agree in some two parts. For each choice
of two parts the bits are taken in the order those two, then the rest, so that the fingerprints that agree there are one
subtree of that order's trie; subtrees are dealt out by hash, six copies of a fingerprint for a budget of 2 at any size
of the table. Inside a subtree, pairs of nodes are walked down together, level by level, as ranges of the sorted
fingerprints: the differing bits add up and a pair over the budget is dropped with all below it. A subtree of more than
CROWD fingerprints is cut again, exactly, by the same rule for its remaining bits. A task emits a spanning forest of its
links, not the links; components come from alternating large-star and small-star rounds on those edges.

Defined results: null or white-space text has fingerprint zero, which links like any other; a text of fewer words than a
shingle is one shingle; repeated rows and ties share fingerprint and component; component_id is the smallest doc_id
reachable (null ids link like others and are a component's id only if it has no other); an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binloom.llm.common import buffers, durable, durable_table, mix64, spread, table, utf8

SHINGLE, BUDGET, BITS = 3, 2, 64
#: Fingerprints that a subtree may have before it is cut again, and copies of fingerprints that a task gets in the mean.
CROWD, TASK_ROWS = 1 << 18, 1 << 19


def shingle_hashes(data: bytes, shingle: int) -> np.ndarray:
    """The XXH64 (seed 42) of each shingle of whole UTF-8 text, repeats included; fewer words than a shingle are one."""
    words = data.lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    joined, ends = b" ".join(words), np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    stops = ends[min(shingle, len(words)) - 1 :]
    starts = np.concatenate([[0], ends[: len(stops) - 1] + 1])
    del words
    digest, step = xxhash.xxh64_intdigest, 1 << 15
    parts = [np.array([digest(joined[a:b], 42) for a, b in zip(starts[k : k + step].tolist(), stops[k : k + step].tolist())], np.uint64) for k in range(0, len(stops), step)]
    return np.concatenate(parts)


def majority(hashes: np.ndarray, words: int = 1) -> np.ndarray:
    """The bits that are set in over half of the hashes, as 64-bit words; the further words are of hashes mixed anew."""
    counts, step = np.zeros(BITS * words, np.int64), 1 << 15
    for at in range(0, len(hashes), step):
        part = hashes[at : at + step]
        wide = np.stack([part, *(mix64(part + np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) for k in range(1, words))], axis=1)
        counts += np.unpackbits(wide.astype(">u8").view(np.uint8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(counts * 2 > len(hashes)).view(">u8").astype(np.uint64)


def simhash(data: bytes, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of whole UTF-8 text: a bit is set if it is in over half of the shingles' hashes."""
    hashes = shingle_hashes(data, shingle)
    return int(majority(hashes)[0]) if len(hashes) else 0


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long): the bits of the unsigned fingerprint as a signed long."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = buffers(batch.column(1))
            view = memoryview(data)
            fps = np.array([simhash(bytes(view[a:b]), shingle) for a, b in zip(off[:-1].tolist(), off[1:].tolist())], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("text")).mapInArrow(kernel, "doc_id long, fp long")


def trie_pairs(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, bits: int, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j), i < j, with at most `budget` differing bits, from walking the trie of each range with itself.

    values are sorted; those of a range lo to hi are equal but for the last `bits` bits.
    """
    lo1, hi1, lo2, hi2, err = lo, hi, lo, hi, np.zeros(len(lo), np.int64)
    for bit in range(bits - 1, -1, -1):
        leaf = (hi1 - lo1) * (hi2 - lo2) <= 4  # so few that comparing them costs less than walking on
        if leaf.any():
            yield from _compare(values, lo1[leaf], hi1[leaf], lo2[leaf], hi2[leaf], budget)
            keep = ~leaf
            lo1, hi1, lo2, hi2, err = (x[keep] for x in (lo1, hi1, lo2, hi2, err))
        if not len(lo1):
            return
        mid1, mid2 = _middle(values, lo1, hi1, bit), _middle(values, lo2, hi2, bit)
        kids = []
        for x0, x1, y0, y1, cost in ((lo1, mid1, lo2, mid2, 0), (mid1, hi1, mid2, hi2, 0), (lo1, mid1, mid2, hi2, 1), (mid1, hi1, lo2, mid2, 1)):
            ok = (x1 > x0) & (y1 > y0) & (err + cost <= budget)
            if cost and x0 is mid1:  # a node with itself: its halves meet once
                ok &= ~((lo1 == lo2) & (hi1 == hi2))
            kids.append((x0[ok], x1[ok], y0[ok], y1[ok], err[ok] + cost))
        lo1, hi1, lo2, hi2, err = (np.concatenate(x) for x in zip(*kids))
    yield from _compare(values, lo1, hi1, lo2, hi2, budget)


def _middle(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: int) -> np.ndarray:
    """Where the bit turns from 0 to 1 in each sorted range whose higher bits are equal."""
    prefix = (values[lo] >> np.uint64(bit + 1)) << np.uint64(bit + 1) if bit < BITS - 1 else np.zeros(len(lo), np.uint64)
    return np.clip(np.searchsorted(values, prefix | np.uint64(1 << bit)), lo, hi)


def _compare(a: np.ndarray, lo1: np.ndarray, hi1: np.ndarray, lo2: np.ndarray, hi2: np.ndarray, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    n1, n2 = hi1 - lo1, hi2 - lo2
    todo = n1 * n2
    at, step = 0, 1 << 20
    ends = np.cumsum(todo)
    while at < len(todo):  # blocks of pairs, so that memory stays bounded
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + step, "right")))
        k = todo[at:stop]
        which = np.repeat(np.arange(at, stop), k)
        inner = np.arange(len(which)) - np.repeat(np.cumsum(k) - k, k)
        i, j = lo1[which] + inner // n2[which], lo2[which] + inner % n2[which]
        ok = (np.bitwise_count(a[i] ^ a[j]) <= budget) & (i < j)
        yield i[ok], j[ok]
        at = stop


def forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int]]:
    """Edges that connect what the pairs connect, n - 1 at most."""
    parent, label, out = list(range(n)), np.arange(n), []

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for i, j in pairs:
        cross = label[i] != label[j]  # what an earlier block has joined needs no look at each pair
        joined = False
        for x, y in zip(i[cross].tolist(), j[cross].tolist()):
            x, y = find(x), find(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
                out.append((x, y))
                joined = True
        if joined:
            label = np.array([find(x) for x in range(n)])
    return out


def agreements(bits: int, budget: int, equal: int = 2, within: int = 0) -> list[int]:
    """Masks of the bits outside `within`: some mask's bits are equal in any two keys that differ in `budget` bits at most."""
    free = [b for b in range(bits - 1, -1, -1) if not within >> b & 1]
    parts = budget + equal
    cuts = [k * len(free) // parts for k in range(parts + 1)]
    masks = [sum(1 << b for b in free[x:y]) for x, y in zip(cuts, cuts[1:])]
    return [within | sum(chosen) for chosen in combinations(masks, equal)]


def arranged(keys: np.ndarray, mask: int, bits: int) -> np.ndarray:
    """The keys with the mask's bits moved to the front, the others after them, in order."""
    out, place = np.zeros(len(keys), np.uint64), bits
    order = [b for b in range(bits - 1, -1, -1) if mask >> b & 1] + [b for b in range(bits - 1, -1, -1) if not mask >> b & 1]
    at = 0
    while at < len(order):  # runs of neighbouring bits move at once
        end = at
        while end + 1 < len(order) and order[end + 1] == order[end] - 1:
            end += 1
        size = end - at + 1
        place -= size
        out |= (keys >> np.uint64(order[end]) & np.uint64((1 << size) - 1)) << np.uint64(place)
        at = end + 1
    return out


def subtrees(keys: DataFrame, bits: int, budget: int, equal: int, crowd: int, by: tuple[str, ...] = ()) -> tuple[DataFrame, list[int]]:
    """The rows of keys (key, columns `by` and others), once for each choice of parts that may agree, as `choice` (the
    number of a mask in the list) and `shared` (the bits that agree): rows that share both, and `by`, are a subtree."""
    first = agreements(bits, budget, equal)
    second = [agreements(bits, budget, equal, m) for m in first]
    masks = [*first, *(m for some in second for m in some)]
    signed = lambda m: F.lit(m - (1 << 64) if m >> 63 else m).cast("long")
    choice = lambda k: F.struct(F.lit(k).alias("choice"), F.col("key").bitwiseAND(signed(masks[k])).alias("shared"))
    dealt = keys.select("*", F.explode(F.array(*map(choice, range(len(first))))).alias("c")).select(*keys.columns, "c.*")
    where = [*by, "choice", "shared"]
    if keys.count() > crowd:
        crowded = durable(dealt.groupBy(*where).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > crowd).select(*where))
        if not crowded.isEmpty():
            per = len(second[0])
            again = F.array(*[F.array(*[choice(len(first) + k * per + j) for j in range(per)]) for k in range(len(first))])
            busy = dealt.join(crowded, where, "left_semi").withColumn("c", F.explode(F.element_at(again, F.col("choice") + 1))).select(*keys.columns, "c.*")
            dealt = dealt.join(crowded, where, "left_anti").select(*busy.columns).unionByName(busy)
    return dealt, masks


def pairs_of(keys: np.ndarray, mask: int, bits: int, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places, within the budget, of keys that agree in the mask's bits."""
    moved, rest = arranged(keys, mask, bits), bits - mask.bit_count()
    order = np.argsort(moved, kind="stable")
    moved = moved[order]
    starts = np.flatnonzero(np.concatenate([[True], np.diff(moved >> np.uint64(rest)) > 0]))
    ends = np.append(starts[1:], len(moved))
    big = ends - starts > 1
    for i, j in trie_pairs(moved, starts[big], ends[big], rest, budget):
        yield order[i], order[j]


def trie_links(prints: DataFrame, budget: int = BUDGET, crowd: int = CROWD) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (fp) that connect all of them within the budget."""
    dealt, masks = subtrees(prints.select(F.col("fp").alias("key")), BITS, budget, 2, crowd)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        choice = np.concatenate([b.column(0).to_numpy() for b in got]) if got else np.zeros(0, np.int32)
        keys = np.concatenate([b.column(1).to_numpy() for b in got]).view(np.uint64) if got else np.zeros(0, np.uint64)
        for c in np.unique(choice).tolist():
            own = keys[choice == c]
            edges = np.array(forest(len(own), pairs_of(own, masks[c], BITS, budget)), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(own[edges[:, k]].view(np.int64)) for k in (0, 1)], ["a", "b"])

    tasks = max(spread(prints.sparkSession), 6 * prints.count() // TASK_ROWS + 1)
    return dealt.repartition(tasks, "choice", "shared").select("choice", "key").mapInArrow(kernel, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node that each node of the edges (a, b) reaches, by large-star and small-star rounds."""
    pairs = durable(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        pairs = durable(small)
        state = tuple(pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = state


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, budget: int = BUDGET, crowd: int = CROWD) -> DataFrame:
    """(doc_id, fp, component_id) of every document."""
    fps = durable_table(fingerprints(docs, shingle))
    known = durable(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    comps = components(trie_links(known.select("fp"), budget, crowd))
    joined = known.join(comps, known.fp == comps.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    label = joined.join(joined.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("fp", "component_id")
    return fps.join(label, "fp")


def op9_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document: 3-word shingles, links at 2 or fewer differing bits."""
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
