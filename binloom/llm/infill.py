"""Fill-in-the-middle rows from documents, by relations over units (lines) of text.

A document is cut into units. Each unit is a row with its ordinal and its length; a running sum over the units of a
document gives where each ends. A document asks for two cuts, each by the ordinal of a unit; asked cuts meet the units
by ordinal, and each document's offsets are gathered. The texts themselves meet their offsets once and are put together
by substrings, so that units are never more than numbers.

Units travel as an array of lengths a document until they are exploded behind the exchange, and rows that repeat an id
with its text are one document until then: the sums and the cuts share one partitioning. Offsets are written, as a row a
document; Spark sends them to the texts while they are under its broadcast bound and else shuffles both, splitting a
repeated row by its skewed-join rule.

Defined results: a null text is an empty one; an empty text has no units and is plain; a text that holds a sentinel is
plain; a text without line ends is one unit, however long; a null id counts as an empty one in the digest that places the
cuts; repeated rows give equal rows, as many; equal ordinals make an empty middle; an empty table gives an empty result;
further columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from binloom.llm.common import durable_table, row_identity, table


@dataclass(frozen=True)
class Infill:
    """What a unit is, the three sentinels, the key of the digests, and how many rows of 100 are transformed, and of those
    have the suffix first."""

    unit: str = r"[^\n]*\n|[^\n]+"
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    key: str = "7:"
    rate: int = 100
    suffix_first: int = 50

    @property
    def sentinels(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle


def _draws(id_col: str, key: str) -> list[Column]:
    """Four numbers below 2^32 from the digest of the key and the id."""
    digest = F.sha2(F.concat(F.lit(key), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def cut_offsets(docs: DataFrame, settings: Infill = Infill(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, n, prefix_end, middle_end) of each different row: units, and characters before the first and the second cut."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lengths = F.transform(F.regexp_extract_all(text, F.lit(settings.unit), F.lit(0)), lambda unit: F.length(unit))
    rows = docs.select(row_identity(id_col, text_col).alias("row"), lengths.alias("lengths"), *[h.alias(f"h{i}") for i, h in enumerate(_draws(id_col, settings.key))])

    once = rows.groupBy("row").agg(F.first("lengths").alias("lengths"))
    units = once.select("row", F.posexplode("lengths").alias("pos", "length"))
    ends = F.sum(F.col("length").cast("long")).over(Window.partitionBy("row").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    units = units.select(F.col("row").alias("of"), (F.col("pos") + 1).alias("ordinal"), ends.alias("end"))

    n = F.size("lengths").cast("long")
    a, b = F.col("h0") % (n + 1), F.col("h1") % (n + 1)
    asked = rows.select("row", n.alias("n"), F.least(a, b).alias("first"), F.greatest(a, b).alias("second"))
    asked = asked.groupBy("row").agg(F.max("n").alias("n"), F.max("first").alias("first"), F.max("second").alias("second"))

    met = asked.join(units, (F.col("row") == F.col("of")) & F.col("ordinal").isin(F.col("first"), F.col("second")), "left")  # ordinal 0 meets no unit
    end_at = lambda cut: F.coalesce(F.max(F.when(F.col("ordinal") == F.col(cut), F.col("end"))), F.lit(0).cast("long"))
    return met.groupBy("row").agg(F.max("n").alias("n"), end_at("first").alias("prefix_end"), end_at("second").alias("middle_end"))


def infilled(docs: DataFrame, settings: Infill = Infill(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, n, form, prefix_chars, middle_chars, output) of every row: the text with its middle moved behind it.

    form is psm (prefix, suffix, middle), spm (suffix, prefix, middle) or plain (the text as it is)."""
    offsets = durable_table(cut_offsets(docs, settings, id_col, text_col))
    text = F.coalesce(F.col(text_col), F.lit(""))
    _, _, h3, h4 = _draws(id_col, settings.key)
    held = [F.contains(text, F.lit(s)) for s in settings.sentinels]
    plain = (text == "") | held[0] | held[1] | held[2] | (h3 % 100 >= settings.rate)
    form = F.when(plain, "plain").when(h4 % 100 < settings.suffix_first, "spm").otherwise("psm")
    rows = docs.select(row_identity(id_col, text_col).alias("row"), F.col(id_col), text.alias("text"), form.alias("form"))

    cut = rows.join(offsets, "row")
    start, end = F.col("prefix_end").cast("int"), F.col("middle_end").cast("int")
    part = lambda at, size: F.substring("text", at + 1, size)
    cut = cut.select("*", part(F.lit(0), start).alias("p"), part(start, end - start).alias("m"), part(end, F.length("text")).alias("s"))
    first, then, last = (F.lit(s) for s in settings.sentinels)
    output = F.when(F.col("form") == "psm", F.concat(first, "p", then, "s", last, "m")).when(F.col("form") == "spm", F.concat(then, "s", first, "p", last, "m")).otherwise(F.col("text"))
    moved = F.col("form") != "plain"
    return cut.select(
        id_col, "text", "n", "form",
        F.when(moved, F.col("prefix_end")).alias("prefix_chars"), F.when(moved, F.col("middle_end") - F.col("prefix_end")).alias("middle_chars"), output.alias("output"),
    )


def restored(output: Column, form: Column, settings: Infill = Infill()) -> Column:
    """The text as it was, from an output and its form alone: no text with a sentinel was cut, so each is there once."""
    sizes = [len(s) for s in settings.sentinels]
    p, s, m = (F.locate(x, output) for x in settings.sentinels)
    rest = F.length(output)
    between = lambda at, size, to: F.substring(output, at + size, to - at - size)
    middle = F.substring(output, m + sizes[2], rest)
    psm = F.concat(between(p, sizes[0], s), middle, between(s, sizes[1], m))
    spm = F.concat(between(p, sizes[0], m), middle, between(s, sizes[1], p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op11_infill_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their middle moved, as digests of the output and of the text restored from it."""
    out = infilled(table(spark, sf_dir, "documents"))
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


OP11_SQL = r"""with d as (select doc_id, coalesce(text, '') t, sha256('7:' || coalesce(doc_id::varchar, '')) g from documents),
u as (select *, regexp_extract_all(t, '[^\n]*\n|[^\n]+') units, [('0x' || substr(g, 8 * i + 1, 8))::bigint for i in range(4)] h from d),
c as (select *, len(units)::bigint n, least(h[1] % (len(units) + 1), h[2] % (len(units) + 1)) a, greatest(h[1] % (len(units) + 1), h[2] % (len(units) + 1)) b from u),
x as (select *, case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') then 'plain' when h[4] % 100 < 50 then 'spm' else 'psm' end form,
array_to_string(list_slice(units, 1, a), '') p, array_to_string(list_slice(units, a + 1, b), '') m, array_to_string(list_slice(units, b + 1, n), '') s from c)
select doc_id, n, form, case when form <> 'plain' then length(p) end prefix_chars, case when form <> 'plain' then length(m) end middle_chars,
sha256(case form when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m when 'spm' then '<S>' || s || '<P>' || p || '<M>' || m else t end) output_sha256, sha256(t) restored_sha256 from x"""
