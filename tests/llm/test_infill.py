"""Fill-in-the-middle by units against SQL and a plain version, on odd texts and the smallest driver tables."""

import hashlib
import re

import pytest
from oracle import compare, connect
from pyspark.sql import functions as F

from binloom.llm import infill

SF = "/root/testdata/sf0.001"
TEXTS = [None, "", "\n", "\n\n\n", "one line", "a\nb", "a\nb\n", "é漢🙂\n\r\nx y\n", "has <P> in it\nand more", "ends <S>", "<", "<P\n>\n<<S\nM>", "x\n" * 5000, "y" * 300_000, "line of words\n" * 40 + "end"]


def plain(doc_id, text, settings=infill.Infill()):
    text = text or ""
    units = re.findall(settings.unit, text)
    digest = hashlib.sha256(f"{settings.key}{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted(h[i] % (len(units) + 1) for i in range(2))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in settings.sentinels) or h[2] % 100 >= settings.rate:
        return (doc_id, text, len(units), "plain", None, None, text)
    one, two, three = settings.sentinels
    form = "spm" if h[3] % 100 < settings.suffix_first else "psm"
    return (doc_id, text, len(units), form, len(p), len(m), one + p + two + s + three + m if form == "psm" else two + s + one + p + three + m)


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "clash", 1, 2, "r") for i, t in enumerate(TEXTS)]
    rows += [rows[5], rows[13], rows[13], (None, "no id\nat all\nhere", None, None, None, None), (None, None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, form string, n int, ordinal long, row string").repartition(3)


@pytest.mark.parametrize("settings", [infill.Infill(), infill.Infill(rate=40, suffix_first=0, key="x"), infill.Infill(unit=r"[^ ]* |[^ ]+", prefix="[a]", suffix="[bb]", middle="[c]", suffix_first=100)])
def test_rows_equal_a_plain_version(odd, settings):
    want = [plain(*r, settings) for r in odd.select("doc_id", "text").collect()]
    out = infill.infilled(odd, settings)
    assert sorted((tuple(r) for r in out.collect()), key=repr) == sorted(want, key=repr)
    assert out.where(infill.restored(F.col("output"), F.col("form"), settings) != F.col("text")).isEmpty()


def test_both_forms_and_empty_middles_occur(odd):
    got = infill.infilled(odd.select("text").crossJoin(odd.sparkSession.range(20).withColumnRenamed("id", "doc_id"))).collect()
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    assert any(r["middle_chars"] == 0 for r in got) and any(r["prefix_chars"] == 0 for r in got if r["form"] != "plain")


def test_empty_table(odd):
    assert infill.infilled(odd.limit(0)).isEmpty()


def test_query_equals_sql(spark):
    con = connect(SF)
    assert compare(infill.op11_infill_units(spark, SF), con, infill.OP11_SQL) == ""


def test_query_equals_sql_on_odd_rows(spark, odd, tmp_path):
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    con = connect(SF)
    con.execute(f"create or replace view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert compare(infill.op11_infill_units(spark, str(tmp_path)), con, infill.OP11_SQL) == ""
