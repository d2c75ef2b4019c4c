"""Shared pieces of the text operators: tables, durable cuts of lineage, Arrow text buffers, vectorised words."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MASK64 = (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _shared_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; a folder of our own only where none is set and all runs in one process."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = sc.getConf().get("spark.checkpoint.dir")
        if not shared and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="binloom-"))
    return sc.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage of a small table by a checkpoint in the shared folder."""
    _shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def durable_table(df: DataFrame) -> DataFrame:
    """Cut the lineage of a large table by writing it as compressed Parquet to the shared folder and reading it back.

    The files go when the session's Python process ends.
    """
    return written(df)[0]


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """As durable_table, with the path for `remove`, for a table that is not needed any more before the process ends."""
    spark = df.sparkSession
    path = f"{_shared_dir(spark)}/binloom-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(remove, spark, path)
    return spark.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    if jvm is not None and spark.sparkContext._jsc is not None:  # a stopped session leaves its files to the folder's owner
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def spread(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


#: Slots of a filter of hashed keys; a row of it has 64, so it has 2^18 rows at most.
SLOTS = 1 << 24


def asked(df: DataFrame, key: str, some: DataFrame, slots: int = SLOTS) -> DataFrame:
    """df with a column `asked`: false only where the key is surely none of `some`'s (a column of the same name, no null).

    What tells is a bit for each slot of hashed keys. It goes to all tasks and is bounded, so the rows of df stay where they
    are; those that are asked for are left to an exact join. With many more keys than slots that is all of them.
    """
    slot = F.pmod(F.xxhash64(key), F.lit(slots))
    bits = some.select(slot.alias("slot")).groupBy(F.expr("shiftright(slot, 6)").alias("__word")).agg(F.expr("bit_or(shiftleft(1L, cast(slot & 63 as int)))").alias("__bits"))
    told = df.withColumn("__slot", slot).withColumn("__at", F.expr("shiftright(__slot, 6)")).join(F.broadcast(bits), F.col("__at") == F.col("__word"), "left")
    return told.select(*pick(df.columns), F.expr("coalesce(bit_get(__bits, cast(__slot & 63 as int)), 0) = 1").alias("asked"))


def without(columns: list[str], *names: str) -> list[str]:
    """The column names that differ from all of `names`, upper and lower case being the same to Spark."""
    gone = {n.lower() for n in names}
    return [c for c in columns if c.lower() not in gone]


def pick(names: list[str]) -> list[Column]:
    """Columns by their exact names, whatever characters these have."""
    return [F.col("`" + n.replace("`", "``") + "`") for n in names]


def numbered(df: DataFrame, names: list[str], last: Column) -> DataFrame:
    """The named columns and a last one, called by number: what Arrow functions can take, whatever the names are."""
    return df.select(*[c.alias(f"_{k}") for k, c in enumerate(pick(names))], last.alias("last"))


def utf8(col: str | Column) -> Column:
    """A text column as UTF-8 bytes, null as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit("")).cast("binary")


def row_identity(id_col: str, text_col: str) -> Column:
    """16 bytes that tell rows apart by id and text: equal just for equal ids and texts, nulls counted."""
    tag = F.coalesce(F.concat(F.lit("="), F.col(id_col).cast("string")), F.lit("null"))
    return F.unhex(F.md5(F.concat(F.concat(tag, F.lit(":")).cast("binary"), utf8(text_col))))


def tagged(col: str) -> Column:
    """A column as text in which null differs from every value."""
    return F.coalesce(F.concat(F.lit("="), F.col(col).cast("string")), F.lit("null"))


#: Values of functions.draw, of which `ranged` tells cells.
DRAWS = 2.0**60


def ranged(part: Column, cells: int) -> Column:
    """Which of `cells` equal ranges a number from 0 to 1 is in, so that cells rise with it."""
    return F.least(F.floor(part * cells), F.lit(cells - 1)).cast("long")


def cells_for(rows: int, least: int = 1024, mean: int = 1 << 16) -> int:
    """A power of two: how many cells rows are dealt to, so that one has about `mean` rows at most."""
    return max(least, 1 << (rows // mean).bit_length())


def each_copy(df: DataFrame, n: str, copy: str, step: int = 1 << 16) -> DataFrame:
    """A row for each of the n copies that a row stands for, numbered 0 to n - 1 as `copy`; many copies by many tasks."""
    count, columns = F.col(n), pick(df.columns)
    blocks = df.select(*columns, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((count - 1) / step).cast("long"))).alias("__block"))
    few, many = blocks.where(count <= step), blocks.where(count > step).repartition(F.xxhash64("__block", *columns))
    last = F.least(count - 1, (F.col("__block") + 1) * step - 1)
    return few.unionByName(many).select(*columns, F.explode(F.sequence(F.col("__block") * step, last)).alias(copy))


def fold_of(id_col: str, folds: int) -> Column:
    """crc32 of the id written as text, modulo folds; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % folds


def buffers(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a binary or string array without copying; offsets has one entry more than rows."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = arr.fill_null(b"" if pa.types.is_binary(arr.type) or pa.types.is_large_binary(arr.type) else "")
    wide = pa.types.is_large_binary(arr.type) or pa.types.is_large_string(arr.type)
    _, off, data = arr.buffers()
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(off, kind)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64) if len(arr) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def groups_of(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts together have at most limit bytes (or one row)."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1
        b = min(n, max(b, a + 1))
        yield a, b
        a = b


def mix64(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


#: Words of more bytes than this are hashed one by one.
LONG_WORD = 256


def hashes_of(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes: eight bytes at a time are mixed in, so that no step is linear."""
    size = end - start
    out = mix64(size.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), np.dtype("<u8"), padded.tobytes(), strides=(1,))
    todo = np.flatnonzero(size <= LONG_WORD)
    at = 0
    while len(todo):
        left = np.minimum(size[todo] - at, 8).astype(np.uint64)
        chunk = eight[start[todo] + at] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * left))
        out[todo] = mix64((out[todo] ^ mix64(chunk)) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(at + 1))
        at += 8
        todo = todo[size[todo] > at]
    view = memoryview(data)
    for k in np.flatnonzero(size > LONG_WORD).tolist():
        out[k] = xxhash.xxh3_64_intdigest(view[start[k] : end[k]])
    return out


class Roller:
    """Hashes of substrings from prefix sums: h(i, j) = sum r[byte] * B^(t-i), modulo 2^64, r a fixed random table."""

    def __init__(self, limit: int):
        base = 0x2545F4914F6CDD1D
        self.r = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        with np.errstate(over="ignore"):
            self.up = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(limit, base, np.uint64)]))
            self.down = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(limit, pow(base, -1, 1 << 64), np.uint64)]))

    def grow(self, n: int) -> None:
        if n >= len(self.up):
            self.__init__(max(n, 2 * len(self.up)))

    def prefix(self, data: np.ndarray) -> np.ndarray:
        self.grow(len(data))
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.r[data] * self.up[: len(data)], out=out[1:])
        return out

    def grams(self, pre: np.ndarray, k: int) -> np.ndarray:
        n = len(pre) - k
        return (pre[k:] - pre[:n]) * self.down[:n] if n > 0 else np.zeros(0, np.uint64)

    def spans(self, pre: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (pre[end] - pre[start]) * self.down[start]
