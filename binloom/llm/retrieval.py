"""Ranked lexical search: the best k documents of each item, by impact-ordered, score-at-a-time retrieval.

The items are the stated query set, read in blocks of bounded size; all documents are searched for every block. Once a
block, documents become counts of the block's terms (a row a document: its terms in all, its block terms and how often),
which are written; the corpus counts (documents, terms, documents of each term) are sums over all of them. A shard is as
many of those rows as have `shard_postings` postings. There each posting's exact impact, its share of a score, is known,
and a term's postings are grouped by impact, highest first. For an item, the groups of all its terms are added to the
documents' sums in descending order of impact. What a document can still get is at most the sum of the next impacts of the
item's terms; once the k-th best sum is above every other sum with that bound added, the k are proven, the rest is left
unread, and their scores are completed from their own rows. Ties are never proven that way, so all of them are read.
A shard gives k documents an item at most, and the best of those, limited in each task before the shuffle, are the result.

Words are found on UTF-8 bytes and looked up exactly; a text longer than `chunk` bytes is read in pieces cut between words.

Defined results: null, empty and wordless texts are no documents of the corpus and have no rank; items without terms, or
whose terms no document has (or only ones of weight 0), have no row; a term counts once an item; equal scores go by
ascending id, null ids last; rows that repeat an id are documents of their own; items that repeat id and text are one,
items that repeat an id with another text are ranked each for itself; an empty table gives an empty result; further
columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from binloom.llm.common import buffers, durable, groups_of, remove, table, utf8, written

#: UTF-8 bytes of item text in a block, bytes of documents read at once, and postings of a shard.
BLOCK_BYTES, CHUNK_BYTES, SHARD_POSTINGS = 8 << 20, 4 << 20, 1 << 21
#: Postings added between two looks at the bound, at first; doubled each time.
FIRST_STEP = 1024

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_IN_TERM = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])
_LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)


@dataclass(frozen=True)
class Scoring:
    """A term in df of N documents weighs floor(scale ln((2N + 2) / (2df + 1))); tf of them in a document of n terms count
    (10^9 tf) div (1000 tf + saturation m), m = 100 - length + (length n N) div L, L being the terms of all documents."""

    scale: int = 1000
    saturation: int = 8
    length: int = 90

    def weight(self, documents: int, df: int) -> int:
        return math.floor(self.scale * math.log((2 * documents + 2) / (2 * df + 1)))

    def impacts(self, weight: np.ndarray, tf: np.ndarray, n: np.ndarray, documents: int, terms: int) -> np.ndarray:
        m = 100 - self.length + self.length * n * documents // max(terms, 1)
        return weight * (1_000_000_000 * tf // (1000 * tf + self.saturation * m))


def terms_in(data: np.ndarray, edges: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """(terms in lower case, where they start) of the bytes; no term spans an edge, the offset where a text begins."""
    inside = _IN_TERM[data]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    at = edges[edges < len(data)]
    start[at] = inside[at]
    start = np.flatnonzero(start)
    place = np.cumsum(inside)[start] - 1 if len(start) else start
    letters = _LOWER[data[inside]]
    offsets = np.append(place, len(letters)).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(letters)]), start


def _pieces(data: np.ndarray, limit: int) -> Iterator[np.ndarray]:
    """The bytes of a text in pieces of about limit bytes, cut where no term goes on."""
    a = 0
    while a < len(data):
        b = min(a + limit, len(data))
        while b < len(data) and _IN_TERM[data[b - 1]] and _IN_TERM[data[b]]:
            ahead = _IN_TERM[data[b : b + limit]]
            b += int(ahead.argmin()) if not ahead.all() else len(ahead)
        yield data[a:b]
        a = b


def count_terms(texts: pa.Array, vocabulary: pa.Array, limit: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of rows a to b at a time: terms in all of each row, then (row, term of the vocabulary, times) sorted by row and term."""
    data, off = buffers(texts)
    width = max(len(vocabulary), 1)
    for a, b in groups_of(off, limit):
        rows, total, keys, times = b - a, np.zeros(b - a, np.int64), [], []
        whole = data[off[a] : off[b]]
        for piece, edges in [(whole, off[a:b] - off[a])] if len(whole) <= limit else ((p, np.zeros(1, np.int64)) for p in _pieces(whole, limit)):
            found, start = terms_in(piece, edges)
            row = np.searchsorted(edges, start, "right") - 1
            total += np.bincount(row, minlength=rows)
            number = pc.index_in(found, value_set=vocabulary)
            known = number.is_valid().to_numpy(zero_copy_only=False)
            key, n = np.unique(row[known] * width + number.drop_null().to_numpy().astype(np.int64), return_counts=True)
            keys.append(key)
            times.append(n)
        key, back = np.unique(np.concatenate([np.zeros(0, np.int64), *keys]), return_inverse=True)
        n = np.zeros(len(key), np.int64)
        np.add.at(n, back, np.concatenate([np.zeros(0, np.int64), *times]))
        yield a, b, total, key // width, key % width, n


_COUNTS = "doc_id long, n long, terms array<int>, times array<long>"


def _counted(docs: DataFrame, vocabulary, id_col: str, text_col: str, chunk: int) -> DataFrame:
    """(doc_id, n, terms, times) of every row with a term; vocabulary is a broadcast list of terms as bytes."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(vocabulary.value, pa.large_binary())
        for batch in batches:
            for a, b, total, row, term, times in count_terms(batch.column(1), known, chunk):
                ends = pa.array(np.searchsorted(row, np.arange(b - a + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(x, kind)) for x, kind in ((term.astype(np.int32), pa.int32()), (times, pa.int64()))]
                out = pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(total), *lists], ["doc_id", "n", "terms", "times"])
                yield out.filter(pa.array(total > 0))

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("text")).mapInArrow(kernel, _COUNTS)


class Shard:
    """Documents and their postings, by document and by term in descending order of impact."""

    def __init__(self, ids: np.ndarray, row: np.ndarray, term: np.ndarray, impact: np.ndarray, vocabulary: int):
        """ids ascend, so that of equal scores the lower row goes first; row ascends too; impacts are above 0."""
        self.ids, self.begins = ids, np.searchsorted(row, np.arange(len(ids) + 1))
        self.own_term, self.own_impact = term, impact
        order = np.lexsort((-impact, term))
        self.doc, self.impact = row[order], impact[order]
        self.first = np.searchsorted(term[order], np.arange(vocabulary + 1))
        self.sums, self.wanted = np.zeros(len(ids), np.int64), np.zeros(vocabulary, bool)
        self.read = self.held = 0

    def best(self, terms: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows, scores) of the k best for the terms, best first; scores above 0 only."""
        spans = [(self.first[t], self.first[t + 1]) for t in terms.tolist() if self.first[t] < self.first[t + 1]]
        if not spans:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        impact = np.concatenate([self.impact[a:b] for a, b in spans])
        doc = np.concatenate([self.doc[a:b] for a, b in spans])
        order = np.argsort(-impact, kind="stable")
        impact, doc = impact[order], doc[order]
        groups = np.append(np.flatnonzero(np.concatenate([[True], impact[1:] != impact[:-1]])), len(impact))
        self.sums[:] = 0
        at, step, proven = 0, FIRST_STEP, None
        while at < len(impact) and proven is None:
            to = int(groups[np.searchsorted(groups, min(at + step, len(impact)))])  # whole groups of one impact
            np.add.at(self.sums, doc[at:to], impact[at:to])
            at, step = to, step * 2
            if at < len(impact):
                proven = self._proven(spans, int(impact[at]), k)
        self.read, self.held = self.read + at, self.held + len(impact)
        if proven is None:
            return self._top(np.flatnonzero(self.sums), k)
        self.wanted[terms] = True
        for d in proven.tolist():
            own = slice(self.begins[d], self.begins[d + 1])
            self.sums[d] = self.own_impact[own][self.wanted[self.own_term[own]]].sum()
        self.wanted[terms] = False
        return self._top(proven, k)

    def _proven(self, spans: list[tuple[int, int]], following: int, k: int) -> np.ndarray | None:
        """The k rows that no other can reach any more, if so; `following` is the highest impact not yet added."""
        if len(self.sums) <= k:
            return None
        top = np.argpartition(self.sums, len(self.sums) - k - 1)
        least, most = self.sums[top[len(self.sums) - k :]].min(), self.sums[top[len(self.sums) - k - 1]]
        if least <= most + following:
            return None
        left = 0  # of each term the next impact: its first one that is `following` or less
        for a, b in spans:
            next_ = a + int(np.searchsorted(-self.impact[a:b], -following))
            left += int(self.impact[next_]) if next_ < b else 0
        return top[len(self.sums) - k :] if least > most + left else None

    def _top(self, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        if len(rows) > k:
            cut = np.partition(self.sums[rows], len(rows) - k)[len(rows) - k]
            rows = rows[self.sums[rows] >= cut]
        rows = rows[np.lexsort((rows, -self.sums[rows]))][:k]
        return rows, self.sums[rows]


def _shards(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Rows of counts in tables of about `most` postings; a batch of more is cut."""
    held, size = [], 0
    for batch in batches:
        ends = batch.column(2).offsets.to_numpy().astype(np.int64)
        for a, b in groups_of(ends, most):
            n = int(ends[b] - ends[a])
            if held and size + n > most:
                yield pa.Table.from_batches(held)
                held, size = [], 0
            held.append(batch.slice(a, b - a))
            size += n
    if held:
        yield pa.Table.from_batches(held)


def _searched(counts: DataFrame, sent, vocabulary: int, documents: int, terms: int, k: int, scoring: Scoring, most: int) -> DataFrame:
    """(item, doc_id, score): of every shard the k best an item; sent is a broadcast of the weights and the items' terms."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, items = pickle.loads(sent.value)
        for t in _shards(batches, most):
            t = t.sort_by([("doc_id", "ascending")]).combine_chunks()  # null ids last
            lists, n = t["terms"].combine_chunks(), t["n"].to_numpy()
            sizes = np.diff(lists.offsets.to_numpy().astype(np.int64))
            row, term, tf = np.repeat(np.arange(len(t)), sizes), lists.flatten().to_numpy(), t["times"].combine_chunks().flatten().to_numpy()
            impact = scoring.impacts(weight[term], tf, n[row], documents, terms)
            live = impact > 0
            shard = Shard(np.arange(len(t)), row[live], term[live].astype(np.int64), impact[live], vocabulary)
            ids = t["doc_id"].combine_chunks()
            for number, own in enumerate(items):
                rows, scores = shard.best(own, k)
                if len(rows):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), number, np.int64)), ids.take(pa.array(rows)), pa.array(scores)], ["item", "doc_id", "score"])

    return counts.mapInArrow(kernel, "item long, doc_id long, score long")


def _block(docs: DataFrame, items: list, k: int, scoring: Scoring, id_col: str, text_col: str, chunk: int, most: int) -> DataFrame:
    """(item, doc_id, score, rank) of a block of items, as lists of terms; the counts go when it is done."""
    spark = docs.sparkSession
    vocabulary = sorted({t for own in items for t in own})
    numbers = {t: i for i, t in enumerate(vocabulary)}
    names = spark.sparkContext.broadcast([t.encode() for t in vocabulary])
    counts, path = written(_counted(docs, names, id_col, text_col, chunk))
    documents, terms = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(vocabulary), np.int64)
    for term, n in counts.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # a row a term of the block
        df[term] = n
    weight = np.array([scoring.weight(documents, int(n)) for n in df], np.int64)
    own = [np.array([numbers[t] for t in terms_], np.int64) for terms_ in items]
    sent = spark.sparkContext.broadcast(pickle.dumps((weight, own)))
    best = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    found = _searched(counts, sent, len(vocabulary), documents, terms, k, scoring, most)
    out = durable(found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k))  # limited in each task first
    names.destroy()
    sent.destroy()
    remove(spark, path)
    return out


def search(docs: DataFrame, items: DataFrame, k: int = 10, scoring: Scoring = Scoring(), id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", block_bytes: int = BLOCK_BYTES, chunk: int = CHUNK_BYTES, shard_postings: int = SHARD_POSTINGS) -> DataFrame:
    """(item, rank, doc_id, score): of each item (id and text in text_col) its k best documents of a score above 0."""
    spark = docs.sparkSession
    text = F.coalesce(text_col, F.lit(""))
    known = items.select(F.col(item_col).alias("item"), text.alias("text")).distinct()
    total = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = known.select(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)).alias("block"), "item", "text", F.array_distinct(F.regexp_extract_all(lowered, F.lit(TERM), F.lit(0))).alias("terms"))
    out = []
    for block in range(blocks):
        rows = terms.where((F.col("block") == block) & (F.size("terms") > 0)).select("item", "terms").collect()  # block_bytes of text in the mean
        names = spark.createDataFrame([(i, r["item"]) for i, r in enumerate(rows)], f"number long, name {items.schema[item_col].dataType.simpleString()}")
        found = _block(docs, [r["terms"] for r in rows], k, scoring, id_col, text_col, chunk, shard_postings)
        out.append(found.join(F.broadcast(names), F.col("item") == F.col("number")).select(F.col("name").alias(item_col), "rank", F.col("doc_id").alias(id_col), "score"))  # of one block
    every = out[0]
    for more in out[1:]:
        every = every.unionByName(more)
    return every


def op13_impact_ordered_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item, of all documents."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = f"regexp_extract_all(translate({{0}}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}')"
OP13_SQL = f"""with d as (select row_number() over () r, doc_id, {_TERMS.format("coalesce(text, '')")} w from documents), t as (select r, unnest(w) term from d), p as (select r, term, count(*)::bigint tf from t group by all),
c as (select count(*)::bigint nd, sum(len(w))::bigint nl from d where len(w) > 0), f as (select term, count(*)::bigint df from p group by term),
q as (select i, item_id, unnest(list_distinct({_TERMS.format("coalesce(text, '')")})) term from (select row_number() over () i, * from (select distinct item_id, text from benchmark))),
x as (select q.i, item_id, d.r, doc_id, floor(1000 * ln((2 * nd + 2) / (2 * df + 1)))::bigint w, tf, 10 + (90 * len(d.w)::bigint * nd) // nl m from q join f using (term) join p using (term) join d using (r), c),
s as (select i, item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::bigint score from x group by all)
select item_id, k::int rank, doc_id, score from (select *, row_number() over (partition by i order by score desc, doc_id) k from s where score > 0) where k <= 10"""
