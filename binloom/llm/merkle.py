"""Merkle-tree fingerprints of documents over sections and paragraphs.

A text is cut into sections (at blank lines), these into paragraphs (lines), these into leaves: runs of at most
LEAF_WORDS words that end at a sentence's end, so that an edit moves no cut outside its sentence. A leaf's digest is of
its exact characters, white space included; a node's digest is of its children's. The fingerprint writes the whole tree:

    <root, 32 hex>:<section>;<section>...   section = <digest, 8 hex>[<paragraph>,<paragraph>...]
    paragraph = its leaves' digests, 6 hex each, run together

Roots are equal just if texts are equal (128-bit BLAKE2b). Two trees are compared from the root down: equal sections are
aligned in order (`aligned`) and left alone with all below them; between them, the paragraphs of the sections that differ
are aligned, and between those that differ, their leaves. What is then left is what was edited: `differing` names those
leaves on both sides, so an inserted section is the only one named, and so is a removed one; `likeness` is twice the
aligned leaves over all leaves, 1.0 for equal roots.

Defined results: null is the empty text, which has one empty section; text of white space only has leaves like any other;
equal texts have equal fingerprints; very long words are cut at LEAF_CHARS characters.

`edited_documents` pairs each document with the next one in descending id. Rows are cut into ranges by splitters of a
sample of (id, text's hash); a range's first document is sent to the range before it too, so each range is walked by
itself as a sorted stream, a document or two in memory. Ties in the id go by the text's hash, so that a repeated or null
id is spread over ranges like others; null ids come last. Of rows equal in both, one follows the other.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from binloom.llm.common import buffers, numbered, pick, spread, table, utf8, without

LEAF_WORDS, LEAF_CHARS = 8, 64
_SECTIONS = re.compile(r"(?:\n[ \t\r]*){2,}")
_LEAF = re.compile(r"\s*(?:[^\s]{1,%d}(?<![.!?])\s+){0,%d}[^\s]{1,%d}\s*|\s+" % (LEAF_CHARS, LEAF_WORDS - 1, LEAF_CHARS))


def _digest(data: bytes, size: int) -> bytes:
    return hashlib.blake2b(data, digest_size=size).digest()


def tree(text: str) -> list[list[list[str]]]:
    """Sections of paragraphs of leaves; joined, they give the text."""
    sections, at = [], 0
    for m in _SECTIONS.finditer(text):
        sections.append(text[at : m.end()])
        at = m.end()
    if at < len(text) or not sections:
        sections.append(text[at:])
    return [[_LEAF.findall(line) for line in s.splitlines(keepends=True)] for s in sections]


def fingerprint(text: str) -> str:
    sections = []
    for section in tree(text):
        paragraphs = [[_digest(leaf.encode("utf-8", "surrogatepass"), 8) for leaf in p] for p in section]
        nodes = b"".join(_digest(b"p" + b"".join(p), 16) for p in paragraphs)
        sections.append((_digest(b"s" + nodes, 16), paragraphs))
    root = _digest(b"r" + b"".join(s for s, _ in sections), 16).hex()
    return root + ":" + ";".join(f"{s[:4].hex()}[{','.join(''.join(x[:3].hex() for x in p) for p in ps)}]" for s, ps in sections)


Node = tuple[str, list[str]]  # a section's digest and its paragraphs, each the digests of its leaves run together


def branches(print_: str) -> list[Node]:
    """The sections of a written fingerprint."""
    return [(x[:8], x[9:-1].split(",")) for x in print_[33:].split(";")]


def aligned(a: list, b: list) -> list[tuple[int, int, int, int]]:
    """The gaps (from a, to a, from b, to b) between elements of a and b that are equal in order.

    Common beginnings and ends are taken off; what occurs once on both sides, in the longest run of rising places, holds
    the middle, and the parts between are treated alike. O(n log n) for lists with few equal elements, and never worse
    than a step for each element and level.
    """
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
        if a0 == a1 or b0 == b1:
            if a0 < a1 or b0 < b1:
                out.append((a0, a1, b0, b1))
            continue
        once_a, once_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        where = {x: j for j, x in enumerate(b[b0:b1], b0) if once_b[x] == 1}
        pairs = [(i, where[x]) for i, x in enumerate(a[a0:a1], a0) if once_a[x] == 1 and x in where]
        if not pairs:
            out.append((a0, a1, b0, b1))
            continue
        tops, ends, before = [], [], []  # the longest rising run: least last place of each length, and its pair
        for k, (_, j) in enumerate(pairs):
            at = bisect_left(tops, j)
            tops[at : at + 1], ends[at : at + 1] = [j], [k]
            before.append(ends[at - 1] if at else -1)
        run, k = [], ends[-1]
        while k >= 0:
            run.append(pairs[k])
            k = before[k]
        for i, j in run:  # from the last to the first
            todo.append((i + 1, a1, j + 1, b1))
            a1, b1 = i, j
        todo.append((a0, a1, b0, b1))
    return sorted(out)


def _gaps(a: list[Node], b: list[Node]) -> Iterator[tuple[list, list]]:
    """What differs between two trees, as lists of leaves (place, digest) on both sides, from the gaps of each level."""
    for a0, a1, b0, b1 in aligned([x for x, _ in a], [x for x, _ in b]):
        one = [((i, j), p) for i in range(a0, a1) for j, p in enumerate(a[i][1])]
        two = [((i, j), p) for i in range(b0, b1) for j, p in enumerate(b[i][1])]
        for p0, p1, q0, q1 in aligned([p for _, p in one], [p for _, p in two]):
            x, y = ([((*at, k // 6), p[k : k + 6]) for at, p in some for k in range(0, len(p), 6)] for some in (one[p0:p1], two[q0:q1]))
            for x0, x1, y0, y1 in aligned([d for _, d in x], [d for _, d in y]):
                yield x[x0:x1], y[y0:y1]


def _likeness(root_a: str, a: list[Node], root_b: str, b: list[Node]) -> float:
    if root_a == root_b:
        return 1.0
    total = sum(len(p) // 6 for t in (a, b) for _, ps in t for p in ps)
    apart = sum(len(x) + len(y) for x, y in _gaps(a, b))
    return min((total - apart) / total, 1 - 1 / (total + 1)) if total else 0.0


def likeness(a: str, b: str) -> float:
    """Of two fingerprints, 0 to 1."""
    return _likeness(a[:32], branches(a), b[:32], branches(b))


def differing(a: str, b: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Where two fingerprints differ: the leaves (section, paragraph, leaf) that a has over b, and b over a."""
    if a[:32] == b[:32]:
        return [], []
    gaps = list(_gaps(branches(a), branches(b)))
    return tuple([at for gap in gaps for at, _ in gap[side]] for side in (0, 1))


def fingerprint_documents(docs: DataFrame, text_col: str = "text", out: str = "fingerprint") -> DataFrame:
    """All columns of docs and the fingerprint of the text, which takes the place of a column of its name."""
    kept = without(docs.columns, out)
    width = len(kept)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(t.decode("utf-8", "replace")) for t in batch.column(width).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(prints, pa.string())], [*kept, out])

    schema = docs.select(*pick(kept)).schema.add(out, "string")
    return numbered(docs, kept, utf8(text_col)).mapInArrow(kernel, schema)


def edit(text: str, other: str) -> str:
    """The last third of the characters replaced by as many first ones of the other text (or all it has)."""
    third = len(text) // 3
    return text[: len(text) - third] + other[:third]


def by_ranges(docs: DataFrame, ranges: int, per_range: int = 16) -> DataFrame:
    """(part, mine, doc_id, text, falling, tie): ranges of descending ids, each with its next range's first document.

    Two short passes: a sample of ids and text hashes (per_range a range) gives splitters, and the first row of each range
    comes from the same columns; a row a range is all that the driver gets of it.
    """
    spark, text = docs.sparkSession, utf8("text")
    falling = F.coalesce(F.bitwise_not(F.col("doc_id").cast("long")), F.lit((1 << 63) - 1))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), falling.alias("falling"), F.xxhash64(text).alias("tie"))
    bound, n = ranges * per_range, keyed.count()
    share = F.pmod(F.xxhash64("falling", "tie"), F.lit(1 << 30)) < int(min(1.0, bound / max(n, 1)) * (1 << 30)) + 1
    some = sorted((r["falling"], r["tie"]) for r in keyed.where(share).select("falling", "tie").distinct().collect()) if ranges > 1 else []
    cuts = [some[len(some) * k // ranges] for k in range(1, ranges)] if some else []
    cuts = sorted(set(cuts))
    parted = keyed.withColumn("part", _rank(cuts, F.col("falling"), F.col("tie")).cast("int"))
    firsts = parted.groupBy("part").agg(F.min(F.struct("falling", "tie")).alias("f")).orderBy("part").collect()
    goes = [(r["f"]["falling"], r["f"]["tie"], firsts[k - 1]["part"]) for k, r in enumerate(firsts)]  # to the range before; the very first goes round to the last
    head = spark.createDataFrame(goes, "hf long, ht long, goes_to int")
    shown = parted.join(F.broadcast(head), (F.col("falling") == F.col("hf")) & (F.col("tie") == F.col("ht")), "left")  # a row a range
    copies = F.filter(F.array(F.struct(F.col("part").alias("part"), F.lit(True).alias("mine")), F.struct(F.col("goes_to").alias("part"), F.lit(False).alias("mine"))), lambda x: x["part"].isNotNull())
    return shown.select("doc_id", "text", "falling", "tie", F.explode(copies).alias("c")).select("c.part", "c.mine", "doc_id", "text", "falling", "tie")


def _rank(cuts: list[tuple[int, int]], falling: Column, tie: Column) -> Column:
    """How many of the ascending cuts are not above (falling, tie), by binary search."""
    n = len(cuts)
    if not n:
        return F.lit(0)
    one, two = (F.lit(np.array([c[k] for c in cuts], np.int64)) for k in (0, 1))
    steps = F.array(*[F.lit(1 << k) for k in range(n.bit_length() - 1, -1, -1)])

    def ahead(low: Column, step: Column) -> Column:
        at = F.least(low + step, F.lit(n))
        x, y = F.element_at(one, at), F.element_at(two, at)
        return F.when((low + step <= n) & ((x < falling) | ((x == falling) & (y <= tie))), low + step).otherwise(low)

    return F.aggregate(steps, F.lit(0), ahead)


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_gone long, n_new long"
#: Bytes of text that a range has in the mean, while MAX_RANGES of them do.
RANGE_BYTES, MAX_RANGES = 32 << 20, 10_000


def edited_documents(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """Per document: its fingerprint, that of its edited text, the likeness to this and to the next document, and how many
    leaves the edit took and gave."""
    if ranges is None:
        size = docs.agg(F.sum(F.octet_length(utf8("text")))).first()[0] or 0
        ranges = min(MAX_RANGES, max(2 * spread(docs.sparkSession), size // RANGE_BYTES + 1))
    parted = by_ranges(docs, ranges)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # (part, doc_id, text, fingerprint, its branches) that waits for its next one
        rows: list[tuple] = []

        def row(one: tuple, text2: str, print2: str, tree2: list[Node]) -> tuple:
            _, doc_id, text, print1, tree1 = one
            new = edit(text, text2)
            print3 = fingerprint(new)
            tree3 = branches(print3)
            gone, fresh = (0, 0) if print1[:32] == print3[:32] else map(sum, zip((0, 0), *((len(x), len(y)) for x, y in _gaps(tree1, tree3))))
            total = sum(len(p) // 6 for t in (tree1, tree3) for _, ps in t for p in ps)
            near = 1.0 if print1[:32] == print3[:32] else min((total - gone - fresh) / total, 1 - 1 / (total + 1)) if total else 0.0
            sha = hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest()
            return doc_id, len(text), sha, print1, print3, near, _likeness(print1[:32], tree1, print2[:32], tree2), gone, fresh

        def out() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]
            names = [c.split()[0] for c in _OUT.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names)

        for batch in batches:
            parts, mine, ids = (batch.column(i).to_pylist() for i in range(3))
            data, off = buffers(batch.column(3))
            view = memoryview(data)
            for k in range(len(parts)):
                text = bytes(view[off[k] : off[k + 1]]).decode("utf-8", "replace")
                mark = fingerprint(text)
                tree_ = branches(mark)
                if held and held[0] == parts[k]:
                    rows.append(row(held, text, mark, tree_))
                held = (parts[k], ids[k], text, mark, tree_) if mine[k] else None
                if len(rows) >= 500:
                    yield out()
                    rows = []
        if rows:
            yield out()

    order = [F.col("part"), F.col("mine").desc(), F.col("falling"), F.col("tie"), F.col("doc_id").isNull()]
    dealt = parted.repartitionById(ranges, F.col("part")).sortWithinPartitions(*order)
    return dealt.select("part", "mine", "doc_id", "text").mapInArrow(kernel, _OUT)


def op7_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, with likenesses."""
    return edited_documents(table(spark, sf_dir, "documents"))
