"""Exact similarity joins pruned by pivots: angles obey the triangle inequality, so cells far apart share no near pair.

Some rows, the first by hash, are pivots; a row's home is the cell of the nearest one. For pairs within an angle, a row
is also a guest of the later cells whose pivot is no further from it than its own by more than twice the angle: whoever is
near it lives in one of them. For the k largest products, a row first meets its own cell, and its k-th score there is a
bound: it visits the cells whose members could reach it, by the cell's radius and longest vector. Guests meet members,
never each other. Members and guests of a cell are dealt to blocks of about BLOCK_ROWS rows, and a task multiplies two
blocks, a few rows at a time, so no task sees a whole cell.

At most MOST_PIVOTS pivots go to all tasks. Where nothing is near anything, rows visit all cells and the work is that of
all pairs: it grows with the square of the rows. Pairs within an angle then meet without cells in WHOLE blocks, so a row is
shuffled that often (floats stay floats on the way), more only over WHOLE times LARGE_ROWS rows. So do the k
largest products, with blocks of WIDE_ROWS at most, which a task goes through BLOCK_ROWS at a time. On data that cluster the work is that of the cells.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from binloom.sources.store import durable

#: Rows that a block has in the mean, and pivots at most: each has about BLOCK_ROWS rows while there are fewer.
BLOCK_ROWS, MOST_PIVOTS = 8192, 1024
#: Blocks without cells where these would send rows about more often, and rows that such a block has at most.
WHOLE, LARGE_ROWS = 8, 1 << 17
#: The same for the k largest products, whose tasks hold vectors as doubles.
WIDE_ROWS = 1 << 16
#: Rows that are multiplied at once, and that leave a task in one batch.
STRIPE_ROWS, BATCH_ROWS = 256, 4096
#: Scores that are ranked at once: what a task holds besides its two blocks.
SCORES = 1 << 18
#: Room for rounding in comparisons of angles and of scores (which count to six digits).
ANGLE_SLACK, SCORE_SLACK = 1e-6, 2e-6
#: Room for single precision in a cosine of unit rows: their rounding and that of sums of any usual length.
SCREEN_SLACK = 1e-4


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; a row whose sum is zero counts as 1/d everywhere, as in functions.medoid_normalise."""
    if not x.size:
        return x
    x = x.astype(np.float64)
    x = np.where((x.sum(axis=1) == 0)[:, None], 1.0 / x.shape[1], x)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _angles(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(unit(x) @ pivots.T, -1.0, 1.0))


def _rows(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(k, v): the rows, floats as floats, anything else as doubles."""
    kind = "array<float>" if df.schema[vector].dataType.simpleString() == "array<float>" else "array<double>"
    return df.select(F.col(key).cast("long").alias("k"), F.col(vector).cast(kind).alias("v"))


def _kind(rows: DataFrame) -> str:
    return rows.schema["v"].dataType.simpleString()


def _stripes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for one in batches:
        for at in range(0, one.num_rows, BATCH_ROWS):
            yield one.slice(at, BATCH_ROWS)


def _visitors(one: pa.RecordBatch, row: np.ndarray, cell: np.ndarray, homes: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """(cell, *homes, k, v): the rows in the cells they visit, BATCH_ROWS at a time."""
    for at in range(0, len(row), BATCH_ROWS):
        some, rows = slice(at, at + BATCH_ROWS), pa.array(row[at : at + BATCH_ROWS])
        yield pa.RecordBatch.from_arrays([pa.array(cell[some].astype(np.int32)), *(pa.array(h[some]) for h in homes), one.column(0).take(rows), one.column(1).take(rows)], ["cell", *["home"] * len(homes), "k", "v"])


def pivots_of(rows: DataFrame, pivots: int | None) -> np.ndarray:
    """Unit vectors of the pivots: as many as asked for, or one for each BLOCK_ROWS rows."""
    n = min(MOST_PIVOTS, pivots or max(1, rows.count() // BLOCK_ROWS))
    chosen = rows.select("k", "v").orderBy(F.xxhash64("k"), "k").limit(n).collect()  # MOST_PIVOTS rows at most
    return unit(np.array([r["v"] for r in chosen], np.float64)) if chosen else np.zeros((0, 0))


def _visits(x: np.ndarray, pivots: np.ndarray, reach: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, home): each row in its home cell, and with a reach also in the later cells that it must visit."""
    angle = _angles(x, pivots)
    home = angle.argmin(axis=1)
    own = angle[np.arange(len(home)), home]
    later = np.arange(len(pivots))[None, :] > home[:, None]
    visit = (angle <= (own + 2 * reach + ANGLE_SLACK)[:, None]) & later if reach is not None else np.zeros(angle.shape, bool)
    visit[np.arange(len(home)), home] = True
    row, cell = np.nonzero(visit)
    return row, cell, cell == home[row]


def homes(rows: DataFrame, pivots: np.ndarray, reach: float | None = None) -> DataFrame:
    """(cell, home, k, v): each row in its home cell, home true, and with a reach also in the later cells that it must visit."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one in _stripes(batches):
            row, cell, home = _visits(matrix(one.column(1)), pivots, reach)
            yield from _visitors(one, row, cell, [home])

    return rows.mapInArrow(kernel, f"cell int, home boolean, k long, v {_kind(rows)}")


def _counts(rows: DataFrame, pivots: np.ndarray, reach: float | None) -> DataFrame:
    """(cell, members, guests): rows that live in a cell and that visit it, without sending them there."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, len(pivots)), np.int64)
        for one in _stripes(batches):
            _, cell, home = _visits(matrix(one.column(1)), pivots, reach)
            total += [np.bincount(cell[at], minlength=len(pivots)) for at in (home, ~home)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(pivots), dtype=np.int32)), *map(pa.array, total)], ["cell", "n", "m"])

    return rows.mapInArrow(kernel, "cell int, n long, m long").groupBy("cell").agg(F.sum("n").alias("members"), F.sum("m").alias("guests")).where("members > 0")


def _dealt(rows: DataFrame, by: str, out: str) -> DataFrame:
    """rows with `out`, a block of their cell by hash, and `blocks`, how many the cell has."""
    sizes = rows.groupBy(by).agg(F.count(F.lit(1)).alias("__n")).withColumnRenamed(by, "__c")
    rows = rows.join(F.broadcast(sizes), F.col(by) == F.col("__c"))  # a row a pivot
    blocks = F.ceil(F.col("__n") / BLOCK_ROWS).cast("int")
    return rows.withColumn("blocks", blocks).withColumn(out, F.pmod(F.xxhash64("k", F.lit("block")), F.col("blocks")).cast("int")).drop("__n", "__c")


def _sent(sizes: DataFrame) -> tuple[int, int]:
    """Rows, and how many rows _tiles makes of them."""
    m, g = (F.ceil(F.col(c) / BLOCK_ROWS) for c in ("members", "guests"))
    found = sizes.agg(F.sum("members"), F.sum(F.col("members") * (m + g) + F.col("guests") * m)).first()
    return found[0] or 0, int(found[1] or 0)


def _tiles(celled: DataFrame, sizes: DataFrame, block_rows: int | None = None) -> DataFrame:
    """(cell, x, y, block, k, v): each row once for each block of its cell that its own one meets, x <= y.

    Members' blocks come first and meet all blocks, guests' blocks come after them and meet only members'."""
    blocks = lambda n: F.ceil(F.col(n) / (block_rows or BLOCK_ROWS)).cast("int")
    sizes = sizes.select(F.col("cell").alias("__c"), blocks("members").alias("m"), blocks("guests").alias("g"))
    draw = lambda n: F.pmod(F.xxhash64("k", F.lit("block")), F.col(n)).cast("int")
    rows = celled.join(F.broadcast(sizes), F.col("cell") == F.col("__c"))  # a row a pivot
    rows = rows.withColumn("block", F.when(F.col("home"), draw("m")).otherwise(F.col("m") + draw("g")))
    others = F.when(F.col("home"), F.col("m") + F.col("g")).otherwise(F.col("m"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), others - 1)))
    return rows.select("cell", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "k", "v")


def _halves(t: pa.Table) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray], bool]:
    """(keys, vectors) of the two blocks of a tile, in order of keys; whether both are the same block."""
    same = t["x"][0].as_py() == t["y"][0].as_py()
    t = t.sort_by("k")
    out = []
    for side in ("x", "y"):
        part = t.filter(pc.equal(t["block"], t[side])).combine_chunks()
        out.append((part["k"].to_numpy(), matrix(part["v"].combine_chunks())))
    return *out, same


def _within(a: np.ndarray, b: np.ndarray, most: float | None, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, distance) of unit rows within `most`, of one block with itself each pair once: single precision shows the
    candidates, double precision decides."""
    small, other = a.astype(np.float32), b.astype(np.float32).T
    step = max(1, min(STRIPE_ROWS, STRIPE_ROWS * BLOCK_ROWS // max(1, len(b))))
    for at in range(0, len(a), step):
        stripe = slice(at, at + step)
        few = None
        if most is not None:
            i, j = np.nonzero(small[stripe] @ other >= np.float32(1.0 - 2.0 * most - SCREEN_SLACK))
            few = len(i) <= len(small[stripe]) * len(b) // 16
        if few:
            d = 0.5 - 0.5 * np.einsum("nd,nd->n", a[i + at], b[j])
        else:
            whole = 0.5 - 0.5 * a[stripe] @ b.T
            i, j = np.nonzero(np.ones(whole.shape, bool) if most is None else whole <= most)
            d = whole[i, j]
        i = i + at
        ok = (np.ones(len(d), bool) if most is None else d <= most) & ((j > i) if same else True)
        yield i[ok], j[ok], d[ok]


def _near_tiles(df: DataFrame, key: str, vector: str, most: float | None, pivots: int | None) -> DataFrame:
    """The tiles in which all pairs within `most` meet, each pair in one."""
    rows = _rows(df, key, vector)
    centres = pivots_of(rows, 1 if most is None else pivots)
    reach = None if most is None else float(np.arccos(np.clip(1.0 - 2.0 * most, -1.0, 1.0)))
    sizes, block_rows = _counts(rows, centres, reach), None
    if len(centres) > 1:
        n, sent = _sent(sizes)
        if sent > WHOLE * n:
            centres, block_rows = centres[:1], min(LARGE_ROWS, -(-n // WHOLE))
            sizes = _counts(rows, centres, reach)
    return _tiles(homes(rows, centres, reach), sizes, block_rows)


def near_pairs(df: DataFrame, key: str, vector: str, most: float | None = None, pivots: int | None = None) -> DataFrame:
    """(i, j, distance), i < j, of all pairs, or of those within `most`; distance is half of one minus the cosine."""

    def kernel(t: pa.Table) -> pa.Table:
        (ki, a), (kj, b), same = _halves(t)
        found = list(_within(unit(a), unit(b), most, same)) if a.size and b.size else []
        i, j, d = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"i": np.minimum(ki[i], kj[j]), "j": np.maximum(ki[i], kj[j]), "distance": d})

    return _near_tiles(df, key, vector, most, pivots).groupBy("cell", "x", "y").applyInArrow(kernel, "i long, j long, distance double")


def near_rows(df: DataFrame, key: str, vector: str, most: float, pivots: int | None = None) -> DataFrame:
    """(k): the keys of all rows that have another within `most`, and maybe of some just beyond (by single precision). No
    pairs are made, so large groups of copies take no more room than others."""

    def kernel(t: pa.Table) -> pa.Table:
        (ki, a), (kj, b), same = _halves(t)
        near, back = np.zeros(len(ki), bool), np.zeros(len(kj), bool)
        if a.size and b.size:
            small, other = unit(a).astype(np.float32), unit(b).astype(np.float32).T
            step = max(1, min(STRIPE_ROWS, STRIPE_ROWS * BLOCK_ROWS // len(kj)))
            for at in range(0, len(ki), step):
                hit = ~(small[at : at + step] @ other < np.float32(1.0 - 2.0 * most - SCREEN_SLACK))
                if same:
                    hit[np.arange(len(hit)), np.arange(at, at + len(hit))] = False
                near[at : at + step] = hit.any(axis=1)
                back |= hit.any(axis=0)
        return pa.table({"k": np.unique(np.concatenate([ki[near], kj[back]]))})

    return _near_tiles(df, key, vector, most, pivots).groupBy("cell", "x", "y").applyInArrow(kernel, "k long").distinct()


def candidate_pairs(df: DataFrame, key: str, vector: str, most: float, pivots: int | None = None) -> int:
    """How many pairs near_pairs compares."""
    rows = _rows(df, key, vector)
    reach = float(np.arccos(np.clip(1.0 - 2.0 * most, -1.0, 1.0)))
    n, m = F.col("members"), F.col("guests")
    return _counts(rows, pivots_of(rows, pivots), reach).agg(F.coalesce(F.sum(n * (n - 1) / 2 + n * m), F.lit(0.0)).cast("long")).first()[0]


def similar_edges(df: DataFrame, key: str, vector: str, least: float, pivots: int | None = None) -> DataFrame:
    """(src, dst, weight): pairs of a cosine of `least` (above 0) and more, in both directions, and each row with itself."""
    near = near_pairs(df, key, vector, (1.0 - least) / 2, pivots).select("i", "j", (1.0 - 2.0 * F.col("distance")).alias("weight"))
    loops = df.select(F.col(key).cast("long").alias("i"), F.col(key).cast("long").alias("j"), F.lit(1.0).alias("weight"))
    back = near.select(F.col("j").alias("i"), F.col("i").alias("j"), "weight")
    return near.unionByName(back).unionByName(loops).toDF("src", "dst", "weight")


def _best(ki: np.ndarray, kj: np.ndarray, a: np.ndarray, b: np.ndarray, k: int) -> pa.Table:
    """The k largest products with b of each row of a, ties (of 6 digits) to the lower key."""
    found, step = [], max(1, min(STRIPE_ROWS, SCORES // max(1, len(b))))
    for at in range(0, len(a) if len(b) else 0, step):
        score = a[at : at + step] @ b.T
        rough = np.round(score, 6)
        last = score.shape[1] - k
        least = np.partition(rough, last, axis=1)[:, last : last + 1] if last > 0 else np.full((len(score), 1), -np.inf)
        i, j = np.nonzero(rough >= least)
        order = np.lexsort((kj[j], -rough[i, j], i))
        i, j = i[order], j[order]
        first = np.arange(len(i)) - np.searchsorted(i, i) < k
        found.append((ki[at + i[first]], kj[j[first]], score[i[first], j[first]]))
    i, j, score = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    return pa.table({"i": i, "j": j, "score": score})


def _best_of_wide(ki: np.ndarray, kj: np.ndarray, a: np.ndarray, b: np.ndarray, k: int, block_rows: int) -> pa.Table:
    """_best of blocks of more rows: by parts of b, of which the k best of a row are kept."""
    held = _best(ki, kj[:0], a, b[:0], k)
    for at in range(0, len(b), block_rows):
        both = pa.concat_tables([held, _best(ki, kj[at : at + block_rows], a, b[at : at + block_rows], k)])
        i, j, score = (both[c].to_numpy() for c in ("i", "j", "score"))
        order = np.lexsort((j, -np.round(score, 6), i))
        i = i[order]
        held = both.take(pa.array(order[np.arange(len(i)) - np.searchsorted(i, i) < k]))
    return held


_SCORES = "i long, j long, score double"


def top_products(df: DataFrame, key: str, vector: str, k: int, pivots: int | None = None) -> DataFrame:
    """(i, j, score, rank): the k largest dot products of each row, itself included; ties (of 6 digits) to the lower key."""
    rows = _rows(df, key, vector)
    centres = pivots_of(rows, pivots)
    best = Window.partitionBy("i").orderBy(F.round("score", 6).desc(), "j")
    ranked = lambda found: found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    celled = homes(rows, centres)

    def at_home(t: pa.Table) -> pa.Table:
        (ki, a), (kj, b), same = _halves(t)
        a, b = a.astype(np.float64, copy=False), b.astype(np.float64, copy=False)
        found = _best(ki, kj, a, b, k)
        return found if same else pa.concat_tables([found, _best(kj, ki, b, a, k)])

    own = ranked(_tiles(celled, _counts(rows, centres, None)).groupBy("cell", "x", "y").applyInArrow(at_home, _SCORES))
    if len(centres) < 2:
        return own.select("i", "j", "score", "rank")
    own = durable(own)

    # Radius, longest and shortest vector of each cell; a row visits the cells whose bound reaches its k-th score.
    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one in batches:
            if one.num_rows:
                x, cell = matrix(one.column(2)).astype(np.float64), one.column(0).to_numpy()
                angle, norm = _angles(x, centres)[np.arange(len(x)), cell], np.linalg.norm(x, axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(angle), pa.array(norm)], ["cell", "angle", "norm"])

    figures = celled.select("cell", "k", "v").mapInArrow(measured, "cell int, angle double, norm double").groupBy("cell").agg(F.max("angle"), F.max("norm"), F.min("norm")).collect()  # a row a pivot
    radius, longest, shortest = np.full(len(centres), -1.0), np.zeros(len(centres)), np.zeros(len(centres))
    for cell, *three in figures:
        radius[cell], longest[cell], shortest[cell] = three
    bound = own.groupBy("i").agg(F.min("score").alias("kth"), F.count(F.lit(1)).alias("n")).select(F.col("i").alias("k"), F.when(F.col("n") >= k, F.col("kth")).otherwise(F.lit(float("-inf"))).alias("kth"))

    def visited(one: pa.RecordBatch) -> np.ndarray:
        x, home, kth = matrix(one.column(1)).astype(np.float64), one.column(2).to_numpy(), one.column(3).to_numpy()
        cosine = np.cos(np.maximum(_angles(x, centres) - radius[None, :] - ANGLE_SLACK, 0.0))
        plain = x.sum(axis=1) != 0  # what unit() replaces has no angle of its own
        reached = np.linalg.norm(x, axis=1)[:, None] * np.where(cosine > 0, cosine * longest, cosine * shortest)
        visit = ((reached >= kth[:, None] - SCORE_SLACK) | ~plain[:, None] | odd[None, :]) & (radius >= 0)[None, :]
        visit[np.arange(len(x)), home] = False
        return visit

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one in _stripes(batches):
            yield from _visitors(one, *np.nonzero(visited(one)), [])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(centres), np.int64)
        for one in _stripes(batches):
            total += visited(one).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(centres), dtype=np.int32)), pa.array(total)], ["cell", "m"])

    def wide(t: pa.Table) -> pa.Table:
        (ki, a), (kj, b), same = _halves(t)
        a, b = a.astype(np.float64, copy=False), b.astype(np.float64, copy=False)
        found = _best_of_wide(ki, kj, a, b, k, part_rows)
        return found if same else pa.concat_tables([found, _best_of_wide(kj, ki, b, a, k, part_rows)])

    zero = celled.where(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double")) == 0).select("cell").distinct().collect()  # cells, a row a pivot
    odd = np.isin(np.arange(len(centres)), [r[0] for r in zero])
    guests = rows.join(celled.select("k", F.col("cell").alias("home")), "k").join(bound, "k").select("k", "v", "home", "kth")
    sizes, part_rows = _counts(rows, centres, None), BLOCK_ROWS
    blocks = lambda c: F.ceil(F.col(c) / BLOCK_ROWS)
    far = guests.mapInArrow(counted, "cell int, m long").groupBy("cell").agg(F.sum("m").alias("abroad"))
    n, sent = sizes.join(far, "cell").agg(F.sum("members"), F.sum(F.col("abroad") * blocks("members") + F.col("members") * blocks("abroad"))).first()
    if (sent or 0) > WHOLE * n:
        near, block_rows = centres[:1], min(WIDE_ROWS, -(-n // WHOLE))
        tiles = _tiles(homes(rows, near), _counts(rows, near, None), block_rows)
        return ranked(tiles.groupBy("cell", "x", "y").applyInArrow(wide, _SCORES)).select("i", "j", "score", "rank")
    guests = guests.mapInArrow(visits, f"cell int, k long, v {_kind(rows)}")
    guests = _dealt(guests, "cell", "x").withColumnRenamed("blocks", "guests")
    members = _dealt(celled.select("cell", "k", "v"), "cell", "y").withColumnRenamed("blocks", "members")
    # A tile is a block of guests and one of members of a cell: each goes to all blocks of the other kind.
    many = members.groupBy("cell").agg(F.max("members").alias("members"))
    some = guests.groupBy("cell").agg(F.max("guests").alias("guests"))
    guests = guests.join(F.broadcast(many), "cell").select("cell", "x", F.explode(F.sequence(F.lit(0), F.col("members") - 1)).alias("y"), F.lit(True).alias("guest"), "k", "v")  # a row a pivot
    members = members.join(F.broadcast(some), "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("guests") - 1)).alias("x"), "y", F.lit(False).alias("guest"), "k", "v")  # a row a pivot

    def abroad(t: pa.Table) -> pa.Table:
        a, b = (t.filter(t["guest"] if guest else pc.invert(t["guest"])).sort_by("k").combine_chunks() for guest in (True, False))
        x, y = (matrix(side["v"].combine_chunks()).astype(np.float64, copy=False) for side in (a, b))
        return _best(a["k"].to_numpy(), b["k"].to_numpy(), x, y, k)

    found = guests.unionByName(members).groupBy("cell", "x", "y").applyInArrow(abroad, _SCORES)
    return ranked(own.select("i", "j", "score").unionByName(found)).select("i", "j", "score", "rank")
