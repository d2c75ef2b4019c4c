"""Benchmark decontamination with suffix arrays of the training text.

Words are found and hashed on the UTF-8 bytes of whole batches of documents. A batch, or a piece of a long document that
overlaps the next one by a window less a word, is a shard. Its suffix array, to the depth of a window, comes from prefix
doubling: the ranks of all suffixes by their first 1, 2, 4 ... words, and by a window's words from two such ranks. Every
benchmark suffix (window) is looked up by binary search, doubling likewise, first its words among the shard's, then pairs
of ranks; the range it ends in are all its places. Neighbouring places on one diagonal of an item are one verbatim match,
the longest there. A document is affected if any window occurs in it.

The benchmark is the stated query set: it is read in blocks of bounded size, and all documents are searched for every
block. One block is sent to the tasks and nothing is written or shuffled. Of several, one at a time is sent; what it
finds is written, its broadcast goes, and the findings (of affected documents only) are merged.

Defined results: null, empty and wordless texts have no words and are clean; an item without words has no window; an item
of fewer words than a window is one window; items with null ids take part in hits but not in the list of ids; repeated
items share their places; repeated documents are searched each for itself; without benchmark rows every document is clean.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binloom.llm.common import buffers, durable_table, groups_of, hashes_of, numbered, pick, row_identity, table, utf8

WINDOW = 10
#: UTF-8 bytes of benchmark text that one block holds, and bytes of documents that a shard holds.
BLOCK_BYTES, SHARD_BYTES = 8 << 20, 1 << 21

_IS_WORD = np.zeros(256, bool)
_IS_WORD[0x30:0x3A] = _IS_WORD[0x41:0x5B] = _IS_WORD[0x61:0x7B] = True
_IS_WORD[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def words_of(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of each word in the bytes; no word spans an edge (the offset where a text begins)."""
    inside = _IS_WORD[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[edges] = True
    before = np.concatenate([[False], inside[:-1]]) if len(data) else inside
    start = np.flatnonzero(inside & (~before | cut[:-1]))
    after = np.concatenate([inside[1:], [False]]) if len(data) else inside
    end = np.flatnonzero(inside & (~after | cut[1:])) + 1
    return hashes_of(_LOWER[data], start, end), start


class Items:
    """A block of benchmark items as one run of words, and where its windows begin, by their length in words."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int):
        self.names = [name for name, _ in items]
        runs = [words_of(np.frombuffer(text, np.uint8), np.zeros(0, np.int64))[0] for _, text in items]
        sizes = np.array([len(r) for r in runs], np.int64)
        words = np.concatenate([np.zeros(0, np.uint64), *runs])
        self.vocabulary, self.word = np.unique(words, return_inverse=True)
        self.owner = np.repeat(np.arange(len(runs)), sizes)
        self.place = np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.room = sizes[self.owner] - self.place
        size = np.minimum(sizes, window)[self.owner]
        begins = self.room >= size
        self.begins = {int(n): np.flatnonzero(begins & (size == n)) for n in np.unique(size)}


class SuffixArray:
    """The suffixes of a shard's words, sorted by their first words; a text's end sorts before every word."""

    def __init__(self, hashes: np.ndarray, room: np.ndarray):
        """room: words from each word to its text's end."""
        self.room = room
        self.vocabulary, rank = np.unique(hashes, return_inverse=True)
        self.ranks, self.keys = {1: rank.astype(np.uint64) + np.uint64(1)}, {}

    def _after(self, length: int, steps: int) -> np.ndarray:
        """The rank by `length` words of the suffix `steps` words on; 0 beyond the text."""
        out = np.zeros(len(self.room), np.uint64)
        rank = self.rank(length)
        out[: len(out) - steps] = rank[steps:]
        out[self.room <= steps] = 0
        return out

    def rank(self, length: int) -> np.ndarray:
        """The rank of every suffix by its first `length` words (or as many as there are)."""
        if length not in self.ranks:
            first = 1 << (length - 1).bit_length() - 1
            pairs = self.rank(first) << np.uint64(32) | self._after(length - first, first)
            self.keys[length], rank = np.unique(pairs, return_inverse=True)
            self.ranks[length] = rank.astype(np.uint64) + np.uint64(1)
        return self.ranks[length]

    def match(self, items: Items, length: int, known: dict[int, np.ndarray]) -> np.ndarray:
        """For every benchmark suffix the rank of its first `length` words among the shard's suffixes; 0 if none has them."""
        if length in known:
            return known[length]
        out = np.zeros(len(items.word), np.uint64)
        if length == 1:
            at = np.minimum(np.searchsorted(self.vocabulary, items.vocabulary), len(self.vocabulary) - 1)
            out = np.where(self.vocabulary[at] == items.vocabulary, at + 1, 0).astype(np.uint64)[items.word]
        else:
            first = 1 << (length - 1).bit_length() - 1
            head, tail = self.match(items, first, known), self.match(items, length - first, known)
            live = np.flatnonzero((head > 0) & (items.room >= length))
            live = live[tail[live + first] > 0]
            if len(live):
                self.rank(length)
                pairs, keys = head[live] << np.uint64(32) | tail[live + first], self.keys[length]
                at = np.minimum(np.searchsorted(keys, pairs), len(keys) - 1)
                out[live] = np.where(keys[at] == pairs, at + 1, 0)
        known[length] = out
        return out


class Findings:
    """What the documents of a shard have of the items: hit words, items, and verbatim matches if wanted."""

    def __init__(self, array: SuffixArray | None, items: Items | None, doc: np.ndarray, wanted: bool):
        change = np.zeros(len(doc) + 1, np.int64)
        self.items, self.matches = np.zeros((0, 2), np.int64), np.zeros((0, 5), np.int64)
        known: dict[int, np.ndarray] = {}
        for size, begins in items.begins.items() if array is not None and items is not None else ():
            rank = array.match(items, size, known)[begins]
            begins, rank = begins[rank > 0], rank[rank > 0].astype(np.int64)
            if not len(begins):
                continue
            own = array.rank(size).astype(np.int64)
            hit = np.zeros(int(own.max()) + 1, bool)
            hit[rank] = True
            place = np.flatnonzero(hit[own])
            np.add.at(change, place, 1)
            np.add.at(change, place + size, -1)
            order = np.argsort(rank, kind="stable")
            begins, rank = begins[order], rank[order]
            both = np.unique(np.stack([doc[place], own[place]], axis=1), axis=0)  # a window counts once a document
            d, at = _each(both[:, 0], both[:, 1], rank)
            self.items = np.unique(np.concatenate([self.items, np.stack([d, items.owner[begins[at]]], axis=1)]), axis=0)
            if wanted:
                where, at = _each(place, own[place], rank)
                who, diagonal = items.owner[begins[at]], where - items.place[begins[at]]
                order = np.lexsort((where, diagonal, who))
                where, who, diagonal = where[order], who[order], diagonal[order]
                new = np.ones(len(who), bool)
                new[1:] = (who[1:] != who[:-1]) | (diagonal[1:] != diagonal[:-1]) | (where[1:] != where[:-1] + 1) | (doc[where[1:]] != doc[where[:-1]])
                first = np.flatnonzero(new)
                last = where[np.append(first[1:], len(who)) - 1]
                found = np.stack([doc[where[first]], who[first], diagonal[first], where[first], last + size], axis=1)
                self.matches = np.concatenate([self.matches, found])
        self.hit = np.cumsum(change[:-1]) > 0


def _each(value: np.ndarray, key: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each value with the places of its key in the sorted ranks."""
    low, high = np.searchsorted(ranks, key, "left"), np.searchsorted(ranks, key, "right")
    n = high - low
    return np.repeat(value, n), np.repeat(low, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)


def _blocks(benchmark: DataFrame, block_bytes: int) -> tuple[int, DataFrame]:
    """How many blocks the benchmark has, of about block_bytes of text each at most (or one item), and (block, item_id, text)."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), utf8("text").alias("text"))
    n = (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes + 1
    return n, items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)))


_LOADED: dict[str, Items] = {}


def _load(name: str, sent: Broadcast) -> Items:
    if name not in _LOADED:
        _LOADED.clear()  # one block in memory at a time
        _LOADED[name] = pickle.loads(sent.value)
    return _LOADED[name]


def _send(block: int, items: DataFrame, window: int) -> tuple[str, Broadcast]:
    rows = items.where(F.col("block") == block).collect()  # bounded by block_bytes
    return uuid.uuid4().hex, items.sparkSession.sparkContext.broadcast(pickle.dumps(Items([(r["item_id"], bytes(r["text"])) for r in rows], window)))


def _shards(data: np.ndarray, off: np.ndarray, window: int, shard_bytes: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, int, bool]]:
    """(first row, last row, word hashes, word starts, edges, words before, whether the rows end here).

    A row of more than two shards comes in pieces that overlap by a window less a word, so that each window is whole in one.
    """
    for a, b in groups_of(off, shard_bytes):
        part, edges = data[off[a] : off[b]], off[a : b + 1] - off[a]
        if b > a + 1 or len(part) <= 2 * shard_bytes:
            yield a, b, *words_of(part, edges[:-1]), edges, 0, True
            continue
        at, before, size = 0, 0, shard_bytes
        while True:
            stop = min(len(part), at + size)
            while stop < len(part) and _IS_WORD[part[stop]]:
                ahead = ~_IS_WORD[part[stop : stop + 4096]]
                stop += int(ahead.argmax()) if ahead.any() else len(ahead)
            hashes, start = words_of(part[at:stop], np.zeros(1, np.int64))
            if stop < len(part) and len(start) < 2 * window:
                size *= 2  # words so long that a piece would hold no window
                continue
            yield a, b, hashes, start, np.array([0, stop - at]), before, stop == len(part)
            if stop == len(part):
                break
            step = len(start) - window + 1
            at, before, size = at + int(start[step]), before + step, shard_bytes


def _merged(spans: list[tuple]) -> list[tuple]:
    """(..., from, to) rows with what overlaps or touches in rows of equal beginnings made one."""
    out: list[tuple] = []
    for s in sorted(spans):
        if out and out[-1][:-2] == s[:-2] and s[-2] <= out[-1][-1]:
            out[-1] = (*out[-1][:-1], max(out[-1][-1], s[-1]))
        else:
            out.append(s)
    return out


def _search(texts: pa.Array, items: Items | None, window: int, shard_bytes: int, wanted: bool = True) -> Iterator[tuple[int, int, list, list, list, list]]:
    """Of rows a to b at a time, for each: words, spans of hit words, numbers of items, matches (item, diagonal, from, to)."""
    data, off = buffers(texts)
    spans, names, matches = [], [], []
    for a, b, hashes, start, edges, before, done in _shards(data, off, window, shard_bytes):
        ends = np.searchsorted(start, edges[1:])
        begins = np.concatenate([[0], ends[:-1]])
        doc = np.repeat(np.arange(b - a), ends - begins)
        array = SuffixArray(hashes, ends[doc] - np.arange(len(doc))) if len(doc) and items is not None and len(items.word) else None
        found = Findings(array, items, doc, wanted)
        if not before:
            spans, names, matches = ([[] for _ in range(b - a)] for _ in range(3))
        low = np.flatnonzero(found.hit & np.concatenate([[True], ~found.hit[:-1] | (doc[1:] != doc[:-1])])[: len(doc)])
        high = np.flatnonzero(found.hit & np.concatenate([~found.hit[1:] | (doc[1:] != doc[:-1]), [True]])[: len(doc)]) + 1
        shift = before - begins
        for d, x, y in zip(doc[low].tolist(), low.tolist(), high.tolist()):
            spans[d].append((x + int(shift[d]), y + int(shift[d])))
        for d, k in found.items.tolist():
            names[d].append(k)
        for d, k, diagonal, x, y in found.matches.tolist():
            move = int(shift[d])
            matches[d].append((k, diagonal + move, x + move, y + move))
        if done:
            words = ends - begins
            yield a, b, (words + before).tolist(), spans if not before else [_merged(x) for x in spans], [sorted(set(x)) for x in names], [_merged(x) for x in matches]


_SPANS = "array<struct<from_word: long, to_word: long>>"
_MATCHES = "array<struct<item_id: string, from_word: long, to_word: long>>"
_PAIR = pa.struct([("from_word", pa.int64()), ("to_word", pa.int64())])
_MATCH = pa.struct([("item_id", pa.string()), ("from_word", pa.int64()), ("to_word", pa.int64())])


def _findings(docs: DataFrame, block: tuple | None, window: int, shard_bytes: int) -> DataFrame:
    """(row, doc_id, n_words, spans, item_ids, matches) of every row of docs, of one block."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = _load(*block) if block else None
        for batch in batches:
            for a, b, words, spans, names, matches in _search(batch.column(2), items, window, shard_bytes):
                name = items.names if items else []
                ids = [sorted({name[k] for k in some if name[k] is not None}) for some in names]
                columns = [
                    batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(words, pa.int64()),
                    pa.array([[{"from_word": x, "to_word": y} for x, y in some] for some in spans], pa.list_(_PAIR)), pa.array(ids, pa.list_(pa.string())),
                    pa.array([[{"item_id": name[k], "from_word": x, "to_word": y} for k, _, x, y in some] for some in matches], pa.list_(_MATCH)),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "n_words", "spans", "item_ids", "matches"])

    schema = f"row binary, doc_id long, n_words long, spans {_SPANS}, item_ids array<string>, matches {_MATCHES}"
    return docs.select(row_identity("doc_id", "text").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), utf8("text").alias("text")).mapInArrow(kernel, schema)


def _by_block(docs: DataFrame, n: int, items: DataFrame, window: int, shard_bytes: int) -> DataFrame:
    """(row, spans, item_ids, matches) of the affected rows, of all blocks: one block is sent at a time."""
    parts = []
    for k in range(n):
        block = _send(k, items, window)
        parts.append(durable_table(_findings(docs, block, window, shard_bytes).where(F.size("spans") > 0).drop("doc_id", "n_words").dropDuplicates(["row"])))
        block[1].destroy()
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    lists = [F.flatten(F.collect_list(c)).alias(c) for c in ("spans", "item_ids", "matches")]
    return every.groupBy("row").agg(*lists).withColumn("item_ids", F.array_sort(F.array_distinct("item_ids")))


def find_windows(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, item_ids (sorted), and matches: the longest verbatim runs (item, word from, to)."""
    n, items = _blocks(benchmark, block_bytes)
    if n == 1:
        found = _findings(docs, _send(0, items, window), window, shard_bytes)
    else:
        have = _by_block(docs, n, items, window, shard_bytes)
        found = _findings(docs, None, window, shard_bytes).select("row", "doc_id", "n_words").join(have, "row", "left")
        found = found.select("doc_id", "n_words", *[F.coalesce(c, F.array().cast(t)).alias(c) for c, t in (("spans", _SPANS), ("item_ids", "array<string>"), ("matches", _MATCHES))])
    # Spans of several blocks may overlap: each counts from where those before it end.
    step = lambda s, x: F.struct((s["n"] + F.greatest(x["to_word"] - F.greatest(x["from_word"], s["reach"]), F.lit(0).cast("long"))).alias("n"), F.greatest(s["reach"], x["to_word"]).alias("reach"))
    hit = F.aggregate(F.array_sort("spans"), F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("reach")), step)["n"]
    return found.select("doc_id", "n_words", hit.alias("n_hit"), "item_ids", "matches")


def clean_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The documents, with all their columns, in which no window of the benchmark occurs; each row is judged by itself."""
    n, items = _blocks(benchmark, block_bytes)
    if n > 1:
        packed = docs.select(row_identity("doc_id", "text").alias("row"), F.struct(*pick(docs.columns)).alias("whole"))
        return packed.join(_by_block(docs, n, items, window, shard_bytes).select("row"), "row", "left_anti").select("whole.*")
    block, columns, width = _send(0, items, window), docs.columns, len(docs.columns)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _load(*block)
        for batch in batches:
            rows = pa.RecordBatch.from_arrays(batch.columns[:width], columns)
            for a, b, _, spans, _, _ in _search(batch.column(width), held, window, shard_bytes, False):
                yield rows.slice(a, b - a).filter(pa.array([not x for x in spans], pa.bool_()))

    return numbered(docs, columns, utf8("text")).mapInArrow(kernel, docs.schema)


def op5_suffix_array_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its words, hit words and benchmark items, windows of ten words, and its longest verbatim match."""
    out = find_windows(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.concat_ws(",", "item_ids"), 256)
    longest = F.coalesce(F.array_max(F.transform("matches", lambda m: m["to_word"] - m["from_word"])), F.lit(0).cast("long"))
    return out.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), longest.alias("longest_match"))


_WORDS = "regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
#: DuckDB: windows of documents and items meet by their lists of words; a longest match is a run on a diagonal.
OP5_SQL = f"""with d as (select doc_id, {_WORDS.format("coalesce(text, '')")} w from documents),
i as (select item_id, {_WORDS.format("coalesce(text, '')")} w from benchmark),
iw as (select item_id, x, least(len(w), 10) size, list_slice(w, x, x + least(len(w), 10) - 1) k from i, unnest(range(1, greatest(len(w) - 9, least(len(w), 1)) + 1)) u(x)),
dw as (select doc_id, p, size, list_slice(w, p, p + size - 1) k from d, (select distinct size from iw) s, unnest(range(1, greatest(len(w) - size + 1, 0) + 1)) u(p)),
m as (select doc_id, p, dw.size, item_id, x from dw join iw on dw.size = iw.size and dw.k = iw.k),
h as (select doc_id, count(distinct p + j) n_hit from (select distinct doc_id, p, size from m), unnest(range(0, size)) u(j) group by doc_id),
t as (select doc_id, count(*) n_items, string_agg(item_id::varchar, ',' order by item_id::varchar) ids from (select distinct doc_id, item_id from m where item_id is not null) group by doc_id),
r as (select doc_id, size, p, p - row_number() over (partition by doc_id, item_id, size, p - x order by p) g, item_id, p - x diagonal from (select distinct doc_id, size, p, x, item_id from m)),
l as (select doc_id, max(n) longest from (select doc_id, count(*) + size - 1 n from r group by doc_id, item_id, size, diagonal, g) group by doc_id)
select doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items, sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated, coalesce(longest, 0)::bigint longest_match
from d left join h using (doc_id) left join t using (doc_id) left join l using (doc_id)"""
