"""Exact substring de-duplication with a distributed sparse suffix array.

A window is `width` bytes. Every byte covered by a window that also starts anywhere else is removed.

1. Anchors. A window's anchor is its least `gram`-byte substring (by hash, the leftmost of equal ones): equal windows
   have equal anchors at equal offsets. Consecutive windows with one anchor form a run, whose bytes go from its first
   window's start to its last one's end. Only (anchor, run digest, place) leave the documents.
2. Counts by anchor settle nearly everything: an anchor that occurs in one place has no repeated window, and a run whose
   bytes occur twice is repeated as a whole. Left open are runs that share an anchor with other bytes around it.
3. For those, one representative of each distinct run sends its suffixes, one for every `grid` offsets of the anchor.
   The suffixes are range-partitioned by their leading bytes with sampled splitters, and each bucket sorts its own by
   multikey quicksort on 8-byte tokens. Longest common prefixes of neighbours and of the bytes on the left of their
   starts decide which windows are equal. Groups that reach a bucket's first or last suffix may go on in the next
   bucket: their windows are compared across boundaries by digest, after each bucket has merged its own.
4. The places of repeated windows return to their documents, which drop the covered bytes.

A hot passage costs one row per task and run in the counts; what many texts share with different surroundings is spread
over many buckets by the range partitioning, as the order goes on into the surroundings.

Defined results: null and empty texts have no bytes and no spans; a text shorter than a window loses nothing; equal
texts of a window or more lose all; repeated rows are documents of their own, also with equal ids; null ids work like
others; an empty table gives an empty result; what is left of a character that was cut is kept as bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binloom.llm.common import Roller, buffers, durable_table, groups_of, mix64, table, utf8

WIDTH, GRAM, GRID = 200, 32, 24
#: Bytes that one step of the anchor scan handles; a longer text is scanned in overlapping pieces.
STEP = 1 << 19
#: Suffixes that a bucket has in the mean, and tasks that they are dealt to at most (a task may hold several buckets).
BUCKET_ROWS, MAX_TASKS = 40_000, 20_000
_PLACE_BITS = 22


def _pieces(off: np.ndarray, width: int) -> Iterator[tuple[int, int, int, int]]:
    """(first row, last row, from byte, to byte): rows together, or a long row's pieces that overlap by width - 1."""
    for a, b in groups_of(off, STEP):
        low, high = int(off[a]), int(off[b])
        if b == a + 1:
            while high - low > 2 * STEP:
                yield a, b, low, low + STEP + width - 1
                low += STEP
        yield a, b, low, high


def runs_of(data: np.ndarray, edges: np.ndarray, roll: Roller, width: int = WIDTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(first window, last window, anchor place, anchor hash) of each run in bytes cut by the edges."""
    n, k = len(data), width - gram + 1
    none = np.zeros(0, np.int64)
    if n < width:
        return none, none, none, none.view(np.uint64)
    h = mix64(roll.grams(roll.prefix(data), gram))
    packed = (h >> np.uint64(_PLACE_BITS)) << np.uint64(_PLACE_BITS) | np.arange(len(h), dtype=np.uint64)
    fill = -len(packed) % k
    grid = np.concatenate([packed, np.full(fill, np.iinfo(np.uint64).max)]).reshape(-1, k)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = n - width + 1
    least = np.minimum(behind[:windows], ahead[k - 1 : k - 1 + windows])
    place = (least & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int64)
    ok = np.zeros(n + 1, np.int32)
    first, last = edges[:-1], edges[1:] - width + 1
    real = last > first
    np.add.at(ok, first[real], 1)
    np.add.at(ok, last[real], -1)
    start = np.zeros(windows + 1, bool)
    start[edges[:-1][edges[:-1] <= windows]] = True
    inside = np.flatnonzero(np.cumsum(ok[:windows]) > 0)
    if not len(inside):
        return none, none, none, none.view(np.uint64)
    p = place[inside]
    new = np.ones(len(inside), bool)
    new[1:] = (p[1:] != p[:-1]) | (inside[1:] != inside[:-1] + 1) | start[inside[1:]]
    at = np.flatnonzero(new)
    return inside[at], inside[np.append(at[1:], len(inside)) - 1], p[at], h[p[at]]


def anchors(docs: DataFrame, width: int, gram: int) -> DataFrame:
    """(anchor, run, n, doc_id, tie, low, high): a row for each distinct run of a step of the scan.

    n > 1: the run is in n places of the step. Its places are rows of n = 0 then, as they are settled already.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll, digest = Roller(2 * STEP + width), xxhash.xxh3_64_intdigest
        for batch in batches:
            ids, ties = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False)
            data, off = buffers(batch.column(2))
            for a, b, low, high in _pieces(off, width):
                part = data[low:high]
                edges = np.clip(off[a : b + 1] - low, 0, high - low)
                first, last, _, anchor = runs_of(part, edges, roll, width, gram)
                if not len(first):
                    continue
                view = memoryview(part)
                run = np.array([digest(view[x:y]) for x, y in zip(first.tolist(), (last + width).tolist())], np.uint64)
                row = np.searchsorted(edges, first, "right") - 1
                place = low - off[a + row] + first
                order = np.lexsort((run, anchor))
                same = (anchor[order][1:] == anchor[order][:-1]) & (run[order][1:] == run[order][:-1])
                head = np.concatenate([[True], ~same])
                count = np.diff(np.append(np.flatnonzero(head), len(order)))
                n = np.zeros(len(order), np.int32)
                n[order[head]] = count
                settled = np.zeros(len(order), bool)
                settled[order] = np.repeat(count, count) > 1
                pick = np.flatnonzero(n > 0)
                yield _batch(ids, ties, a + row[pick], anchor[pick], run[pick], n[pick], place[pick], place[pick] + last[pick] - first[pick])
                got = np.flatnonzero(settled)  # places of runs that this step has twice, merged where they touch
                if len(got):
                    got = got[np.lexsort((first[got], row[got]))]
                    joined = (row[got][1:] == row[got][:-1]) & (first[got][1:] == last[got][:-1] + 1)
                    heads = np.flatnonzero(np.concatenate([[True], ~joined]))
                    tails = np.append(heads[1:], len(got)) - 1
                    begin, end = got[heads], got[tails]
                    zero = np.zeros(len(begin), np.int64)
                    yield _batch(ids, ties, a + row[begin], zero.view(np.uint64), zero.view(np.uint64), zero.astype(np.int32), place[begin], place[end] + last[end] - first[end])

    return docs.mapInArrow(kernel, "anchor long, run long, n int, doc_id long, tie long, low long, high long")


def _batch(ids: pa.Array, ties: np.ndarray, row: np.ndarray, anchor: np.ndarray, run: np.ndarray, n: np.ndarray, low: np.ndarray, high: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array(anchor.view(np.int64)), pa.array(run.view(np.int64)), pa.array(n), ids.take(pa.array(row)), pa.array(ties[row]), pa.array(low), pa.array(high)]
    return pa.RecordBatch.from_arrays(columns, ["anchor", "run", "n", "doc_id", "tie", "low", "high"])


def open_suffixes(docs: DataFrame, width: int, gram: int, grid: int) -> DataFrame:
    """Suffixes of the runs listed in `open` (anchor place is found again): for each `grid` offsets of a run's windows
    the suffix that all of them contain the beginning of, cut at width, the grid - 1 bytes before, and which offsets."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll = Roller(1 << 14)
        for batch in batches:
            ids, ties = batch.column(0), batch.column(1)
            data, off = buffers(batch.column(2))
            view = memoryview(data)
            picks, out = [], {k: [] for k in ("suffix", "left", "start", "least", "most", "once")}

            def flush() -> pa.RecordBatch:
                pick = pa.array(picks, pa.int64())
                kinds = (("suffix", pa.binary()), ("left", pa.binary()), ("start", pa.int64()), ("least", pa.int32()), ("most", pa.int32()), ("once", pa.bool_()))
                return pa.RecordBatch.from_arrays([*(pa.array(out[k], t) for k, t in kinds), ids.take(pick), ties.take(pick)], [*out, "doc_id", "tie"])

            lists = batch.column(3)
            flat, cuts = lists.flatten(), np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(int)
            lows, highs, onces = (flat.field(name).to_numpy(zero_copy_only=False) for name in ("low", "high", "once"))
            for k in range(batch.num_rows):
                base, stop, own = int(off[k]), int(off[k + 1]), slice(cuts[k], cuts[k + 1])
                for low, high, once in sorted(zip(lows[own].tolist(), highs[own].tolist(), onces[own].tolist())):
                    part = data[base + low : base + high + width]
                    _, _, anchor, _ = runs_of(part, np.array([0, len(part)]), roll, width, gram)
                    m = low + int(anchor[0])  # all windows of a run have this anchor
                    for c in range((m - high) // grid, (m - low) // grid + 1):
                        s = m - grid * c
                        least, most = max(0, s - high), min(grid - 1, s - low)
                        if most >= least:
                            begin = base + s
                            out["suffix"].append(bytes(view[begin : min(begin + width, stop)]))
                            out["left"].append(bytes(view[max(base, begin - grid + 1) : begin]))
                            for name, value in (("start", s), ("least", least), ("most", most), ("once", once)):
                                out[name].append(value)
                            picks.append(k)
                    if len(picks) >= 20_000:
                        yield flush()
                        picks.clear()
                        for v in out.values():
                            v.clear()
            if picks:
                yield flush()

    schema = "suffix binary, left binary, start long, least int, most int, once boolean, doc_id long, tie long"
    return docs.mapInArrow(kernel, schema)


def multikey_quicksort(tokens: np.ndarray) -> np.ndarray:
    """The order of rows of 8-byte tokens: ternary partitions around a pivot of each segment, all segments at once;
    the middle part goes on with the next token."""
    n, depth_end = tokens.shape
    order = np.arange(n)
    at, seg, depth = np.arange(n), np.zeros(n, np.int64), np.zeros(n, np.int64)  # places not yet settled
    while len(at):
        starts = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]]))
        size = np.diff(np.append(starts, len(seg)))
        key = tokens[order[at], depth]
        # Median of three: first, middle, last of the segment.
        trio = np.stack([key[starts], key[starts + size // 2], key[starts + size - 1]])
        pivot = np.repeat(np.sort(trio, axis=0)[1], size)
        side = np.where(key < pivot, 0, np.where(key == pivot, 1, 2))
        where = np.argsort(seg * 3 + side, kind="stable")
        order[at] = order[at][where]
        side, seg, depth = side[where], seg[where], depth[where]
        depth = depth + (side == 1)
        new = np.concatenate([[True], (seg[1:] != seg[:-1]) | (side[1:] != side[:-1])])
        seg = np.cumsum(new)
        alone = np.diff(np.append(np.flatnonzero(new), len(seg)))
        left = (np.repeat(alone, alone) > 1) & (depth < depth_end)
        at, seg, depth = at[left], seg[left], depth[left]
    return order


def _matrix(column: pa.ChunkedArray | pa.Array, width: int, right: bool) -> np.ndarray:
    """Rows of bytes padded with zeros to the width, at the right (suffixes) or the left (what stands before them)."""
    data, off = buffers(column)
    size = np.diff(off)
    out = np.zeros((len(size), width), np.uint8)
    row = np.repeat(np.arange(len(size)), size)
    inner = np.arange(int(size.sum())) - np.repeat(off[:-1] - off[0], size)
    out[row, inner if right else inner + np.repeat(width - size, size)] = data[off[0] : off[-1]]
    return out


def bucket_matches(t: pa.Table, width: int, grid: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, offset) of windows repeated inside a bucket, and (row, offset) of one window each, by count, that may
    have partners in other buckets."""
    wide = -(-width // 8) * 8
    suffix, left = _matrix(t["suffix"], wide, True), _matrix(t["left"], grid - 1, False)
    order = multikey_quicksort(suffix.view(">u8").astype(np.uint64))
    suffix = suffix[order]
    lcp = np.zeros(len(order), np.int64)  # with the row before
    for a in range(1, len(order), 1 << 16):
        b = min(len(order), a + (1 << 16))
        differ = suffix[a:b] != suffix[a - 1 : b - 1]
        lcp[a:b] = np.where(differ.any(axis=1), differ.argmax(axis=1), wide)
    core = np.cumsum(lcp < width - grid + 1)
    edge = (core == core[0]) | (core == core[-1])
    least, most = t["least"].to_numpy()[order], t["most"].to_numpy()[order]
    before = np.zeros(len(order), np.uint64)
    rows, offsets, edge_rows, edge_offsets = [], [], [], []
    for j in range(grid):
        if j:
            before = mix64(before * np.uint64(0x9E3779B97F4A7C15) + left[order, grid - 1 - j].astype(np.uint64) + np.uint64(1))
        valid = np.flatnonzero((least <= j) & (j <= most))
        if not len(valid):
            continue
        key = mix64(np.cumsum(lcp < width - j).astype(np.uint64)[valid] * np.uint64(0xD6E8FEB86659FD93) ^ before[valid])
        _, head, inverse, count = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
        twice = count[inverse] > 1
        rows.append(order[valid[twice]])
        offsets.append(np.full(int(twice.sum()), j))
        at_edge = head[edge[valid[head]]]
        edge_rows.append(np.stack([order[valid[at_edge]], count[inverse[at_edge]]]))
        edge_offsets.append(np.full(len(at_edge), j))
    join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    ends = np.concatenate(edge_rows, axis=1) if edge_rows else np.zeros((2, 0), np.int64)
    return join(rows), join(offsets), ends, join(edge_offsets)


_HIT = "doc_id long, tie long, low long, high long, h1 long, h2 long, n int"


def search_buckets(suffixes: DataFrame, rows: int, width: int, grid: int, bucket_rows: int, max_tasks: int) -> DataFrame:
    """(doc_id, tie, low, high) of repeated windows, from sorted buckets and a comparison across their boundaries.

    A task is a bucket while max_tasks of them do; beyond, a task's suffixes come sorted and are cut into buckets there.
    """
    buckets = rows // bucket_rows + 1
    several = buckets > max_tasks

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got, size = [], 0
        for batch in batches:
            got.append(batch)
            size += batch.num_rows
            if several and size >= bucket_rows:
                yield from bucket(got)
                got, size = [], 0
        if size:
            yield from bucket(got)

    def bucket(got: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(got).combine_chunks()
        ids, ties, start, once = t["doc_id"], t["tie"], t["start"].to_numpy(), t["once"].to_numpy(zero_copy_only=False)
        rows, offsets, ends, end_offsets = bucket_matches(t, width, grid)

        def out(r: np.ndarray, low: np.ndarray, high: np.ndarray, h1: np.ndarray, h2: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            pick = pa.array(r)
            table_ = pa.table([ids.take(pick), ties.take(pick), pa.array(low), pa.array(high), pa.array(h1), pa.array(h2), pa.array(n.astype(np.int32))], names=[c.split()[0] for c in _HIT.split(", ")])
            yield from table_.combine_chunks().to_batches(max_chunksize=50_000)

        keep = once[rows]  # the others' places are known to repeat already
        rows, offsets = rows[keep], offsets[keep]
        if len(rows):
            o = np.lexsort((-offsets, rows))
            rows, offsets = rows[o], offsets[o]
            first = start[rows] - offsets
            head = np.concatenate([[True], (rows[1:] != rows[:-1]) | (first[1:] != first[:-1] + 1)])
            at = np.flatnonzero(head)
            zero = np.zeros(len(at), np.int64)
            yield from out(rows[at], first[at], first[np.append(at[1:], len(rows)) - 1], zero, zero, zero)
        if ends.shape[1]:
            r, n = ends
            suffix, left = t["suffix"].combine_chunks(), t["left"].combine_chunks()
            both = [xxhash.xxh3_128_intdigest((left[i].as_py()[len(left[i].as_py()) - j :] if j else b"") + suffix[i].as_py()[: width - j]) for i, j in zip(r.tolist(), end_offsets.tolist())]
            h1 = np.array([x >> 64 for x in both], np.uint64).view(np.int64)
            h2 = np.array([x & (1 << 64) - 1 for x in both], np.uint64).view(np.int64)
            low = start[r] - end_offsets
            # n: places in this bucket; 1 is the place itself, open if it is the run's only one.
            yield from out(r, low, low, h1, h2, np.where(once[r] | (n > 1), n, 2))

    order = ["suffix", "left", "doc_id", "start"]
    dealt = suffixes.repartitionByRange(min(buckets, max_tasks), *order)
    found = durable_table((dealt.sortWithinPartitions(*order) if several else dealt).mapInArrow(kernel, _HIT))
    inside = found.where("n = 0").select("doc_id", "tie", "low", "high")
    alone = F.when(F.col("n") == 1, F.struct("doc_id", "tie", "low", "high"))
    across = found.where("n > 0").groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.collect_list(alone).alias("places"))  # a place a bucket
    return inside.unionByName(across.where("n > 1").select(F.explode("places").alias("p")).select("p.*"))


def repeated_places(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, grid: int = GRID, bucket_rows: int = BUCKET_ROWS, max_tasks: int = MAX_TASKS) -> DataFrame:
    """(doc_id, tie, low, high): windows starting at bytes low to high are repeated. docs: (doc_id, tie, text binary)."""
    rows = durable_table(anchors(docs.where(F.octet_length("text") >= width), width, gram))
    places = rows.where("n > 0")
    mixed = places.groupBy("anchor").agg((F.min("run") != F.max("run")).alias("mixed"), F.sum("n").alias("all"))
    mixed = mixed.where("all > 1 and mixed").select("anchor", F.lit(True).alias("mixed"))
    runs = places.groupBy("anchor", "run").agg(F.sum("n").alias("total")).join(mixed, "anchor", "left")
    runs = runs.where("total > 1 or mixed").withColumnsRenamed({"anchor": "a2", "run": "r2"})
    known = durable_table(places.join(runs, (F.col("anchor") == F.col("a2")) & (F.col("run") == F.col("r2"))).drop("a2", "r2"))
    place = ["doc_id", "tie", "low", "high"]
    settled = rows.where("n = 0").select(*place).unionByName(known.where("n = 1 and total > 1").select(*place))
    open_runs = known.where("mixed").groupBy("anchor", "run").agg(F.min(F.struct(*place)).alias("at"), F.first("total").alias("total"))
    open_runs = open_runs.select("at.*", (F.col("total") == 1).alias("once"))
    per_doc = open_runs.groupBy("doc_id", "tie").agg(F.collect_list(F.struct("low", "high", "once")).alias("open"))
    with_open = docs.join(per_doc.withColumnsRenamed({"doc_id": "d2", "tie": "t2"}), F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("tie") == F.col("t2")))
    suffixes = durable_table(open_suffixes(with_open.select("doc_id", "tie", "text", "open"), width, gram, grid))
    return settled.unionByName(search_buckets(suffixes, suffixes.count(), width, grid, bucket_rows, max_tasks))


def _identified(docs: DataFrame) -> DataFrame:
    """(doc_id, tie, text): the tie, 64 bits of a digest of length and bytes, tells apart rows of one id; equal rows have
    equal places and results. Only rows of one id (or of none) could meet, a billion of them with a chance of one in 36."""
    text = utf8("text")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.octet_length(text), F.md5(text)).alias("tie"), text.alias("text"))


def remove_repeats(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, grid: int = GRID, bucket_rows: int = BUCKET_ROWS, max_tasks: int = MAX_TASKS) -> DataFrame:
    """(doc_id, n_bytes, spans, kept): the bytes removed, as [from, to) spans, and those left, of every document."""
    keyed = _identified(docs)
    places = repeated_places(keyed, width, gram, grid, bucket_rows, max_tasks)
    spans = places.groupBy("doc_id", "tie").agg(F.collect_list(F.struct("low", "high")).alias("places")).withColumnsRenamed({"doc_id": "d2", "tie": "t2"})
    both = keyed.join(spans, F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("tie") == F.col("t2")), "left").select("doc_id", "text", "places")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = buffers(batch.column(1))
            view = memoryview(data)
            lists = batch.column(2)
            flat, cuts = lists.flatten(), np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))]).astype(int)
            lows, highs = flat.field("low").to_numpy(zero_copy_only=False), flat.field("high").to_numpy(zero_copy_only=False) + width
            sizes, removed, kept = [], [], []
            for k in range(batch.num_rows):
                text = view[off[k] : off[k + 1]]
                low, high = lows[cuts[k] : cuts[k + 1]], highs[cuts[k] : cuts[k + 1]]
                spans_ = []
                if len(low):
                    o = np.argsort(low, kind="stable")
                    low, reach = low[o], np.maximum.accumulate(high[o])
                    head = np.flatnonzero(np.concatenate([[True], low[1:] > reach[:-1]]))
                    spans_ = list(zip(low[head].tolist(), reach[np.append(head[1:], len(low)) - 1].tolist()))
                at, left = 0, []
                for x, y in spans_:
                    left.append(text[at:x])
                    at = y
                left.append(text[at:])
                sizes.append(len(text))
                removed.append([{"from_byte": x, "to_byte": y} for x, y in spans_])
                kept.append(b"".join(left))
            kind = pa.list_(pa.struct([("from_byte", pa.int64()), ("to_byte", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, kind), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    return both.mapInArrow(kernel, "doc_id long, n_bytes long, spans array<struct<from_byte: long, to_byte: long>>, kept binary")


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document what is removed of it, strings of 200 bytes."""
    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["to_byte"] - x["from_byte"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
