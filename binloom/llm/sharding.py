"""Rendezvous (highest random weight) sharding of records, in DataFrame expressions only.

Every (key, shard) pair gets a uniform number u from an MD5 digest, which every engine has, so that other systems find a
record's shard as well; a record goes to the shard with the least -ln(u) / weight. A record's choice among the old shards does not change when a shard is added, so rows move only into
the new one, a share of them equal to its share of the weights.

Slots number the rows of a shard from 0 without a gap, in the order of numbers drawn by key and text. A shard is cut into
`cells`, ranges of these numbers, as many as the rows ask for; rows are numbered inside a cell, and a cell starts where the
cells before it end, so no task ever sees a whole shard, nor all rows of a repeated or null key; slots are the same for any
number of cells. Equal rows of `shard_records` are one row with a count until then.

Defined results: a null key is a key like any other (its rows meet in one shard); a null text has size `overhead` and
crc32 0; empty text likewise; repeated rows and equal keys share a shard and get slots of their own; an empty table gives
an empty result; `shard_records` ignores further columns, `shard_documents` keeps them, but its shard and slot take the
place of columns of these names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from binloom.functions import draw
from binloom.llm.common import DRAWS, cells_for, each_copy, pick, ranged, table, tagged, without


def rendezvous(key: str, weights: Sequence[float]) -> Column:
    """The shard of a key column; shards of weight 0 get nothing; ties (equal draws) go to the lower shard."""
    if not any(w > 0 for w in weights):
        raise ValueError("some shard needs a weight above 0")
    costs = []
    for shard, weight in enumerate(weights):
        if weight > 0:
            u = (draw(tagged(key), shard).cast("double") + 0.5) / F.lit(DRAWS)
            costs.append(F.struct((-F.ln(u) / F.lit(float(weight))).alias("cost"), F.lit(shard).alias("shard")))
    return (F.least(*costs) if len(costs) > 1 else costs[0])["shard"]


def number_slots(df: DataFrame, shard: str, part: Column, order: Sequence[Column], slot: str, cells: int, n: Column | None = None) -> DataFrame:
    """Add `slot`: 0, 1, 2 ... within each shard, by `part` (from 0 to 1) and then by `order`; a row that stands for n takes n."""
    n = F.lit(1) if n is None else n
    celled = df.withColumn("__part", part).withColumn("__cell", ranged(F.col("__part"), cells))
    before = Window.partitionBy(shard).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)  # a row a cell
    starts = celled.groupBy(shard, "__cell").agg(F.sum(n).alias("__n")).select(F.col(shard).alias("__shard"), F.col("__cell").alias("__cell2"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = F.coalesce(F.sum(n).over(Window.partitionBy(shard, "__cell").orderBy("__part", *order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return (
        celled.withColumn("__inside", inside)
        .join(starts, (F.col(shard) == F.col("__shard")) & (F.col("__cell") == F.col("__cell2")))
        .withColumn(slot, (F.col("__start") + F.col("__inside")).cast("long"))
        .drop("__part", "__cell", "__inside", "__shard", "__cell2", "__start")
    )


def shard_records(docs: DataFrame, weights: Sequence[float], id_col: str = "doc_id", text_col: str = "text", overhead: int = 8, grown: Sequence[float] | None = None, cells: int | None = None) -> DataFrame:
    """One row per document: id, size, text_crc32, shard, slot and, if `grown` weights are given, the shard under those."""
    text = F.col(text_col).cast("binary")
    rows = docs.select(
        F.col(id_col),
        (F.coalesce(F.octet_length(text), F.lit(0)) + overhead).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("").cast("binary"))).alias("text_crc32"),
    ).groupBy(id_col, "size", "text_crc32").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.select(
        "*",
        rendezvous(id_col, weights).cast("int").alias("shard"),
        (rendezvous(id_col, grown).cast("int") if grown else F.lit(None).cast("int")).alias("grown_shard"),
    )
    order = [F.col(id_col).asc_nulls_first(), F.col("text_crc32"), F.col("size")]
    part = draw(tagged(id_col), "text_crc32", "size").cast("double") / F.lit(DRAWS)
    out = number_slots(rows, "shard", part, order, "first_slot", cells or cells_for(docs.count()), F.col("n"))
    return each_copy(out, "n", "copy").withColumn("slot", F.col("first_slot") + F.col("copy")).select(id_col, "size", "text_crc32", "shard", "grown_shard", "slot")


def shard_documents(docs: DataFrame, weights: Sequence[float], id_col: str = "doc_id", text_col: str = "text", cells: int | None = None, position: str | None = None) -> DataFrame:
    """All columns of docs with `shard` and `slot`.

    Slots follow a column of positions from 0 to 1, if one is named. Else they are drawn by hash, and rows that repeat an id
    with its text, such as the passes of a mix, are spread evenly over their shard: of n, one in each n-th of it.
    """
    row = F.struct(*pick(without(docs.columns, "shard", "slot")))  # packed, so that no name meets those used here
    out = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash"), rendezvous(id_col, weights).cast("int").alias("shard"), row.alias("row"))
    if position is None:
        same, scale = Window.partitionBy("id", "hash"), float(1 << 30)
        drawn = F.pmod(F.xxhash64("id", "hash", F.lit("slot")), F.lit(1 << 30)) / scale
        at = (F.row_number().over(same.orderBy("hash")) - 1 + drawn) / F.count(F.lit(1)).over(same)
    else:
        at = F.coalesce(F.col("row")[position].cast("double"), F.lit(0.0))
    order = [F.col("hash"), F.col("id").asc_nulls_first()]
    out = number_slots(out, "shard", at, order, "slot", cells or cells_for(docs.count()))
    return out.select("row.*", "shard", "slot")


def op3_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 23 by doc_id; grown_shard is the shard of 25."""
    out = shard_records(table(spark, sf_dir, "documents"), [1.0] * 24, grown=[1.0] * 25)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


#: CRC-32 (reflected, polynomial EDB88320) of bytes of one bit each: fixed values, from which that of any byte is an xor.
CRC_BITS = (1996959894, 3993919788, 124634137, 249268274, 498536548, 997073096, 1994146192, 3988292384)
_STEP = "c >> 8"
for _bit, _value in enumerate(CRC_BITS):
    _STEP = f"xor({_STEP}, (xor(c, b) >> {_bit} & 1) * {_value})"

OP3_SQL = f"""with d as (select doc_id, coalesce('=' || doc_id, 'null') k, (coalesce(strlen(text), 0) + 8)::bigint size,
list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::bigint) bytes from documents),
c as (select doc_id, k, size, xor(list_reduce(bytes, lambda c, b: {_STEP}, 4294967295::bigint), 4294967295) text_crc32 from d),
keys as (select k, s, ('0x' || substr(md5(k || ':' || s), 1, 15))::bigint draw from (select distinct k from c), range(25) shards(s)),
placed as (select k, arg_max(s, [draw, -s]) filter (s < 24)::int shard, arg_max(s, [draw, -s])::int grown_shard from keys group by k)
select doc_id, size, text_crc32, 'key' law, shard, grown_shard, row_number() over (partition by shard
order by ('0x' || substr(md5(k || ':' || text_crc32 || ':' || size), 1, 15))::bigint::double, doc_id nulls first, text_crc32, size) - 1 slot
from c join placed using (k)"""
