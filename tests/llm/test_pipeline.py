"""The pipeline's stages, each held against a plain version of its own input: driver tables and a table of odd rows."""

import re
from collections import Counter

import corpus_pipeline as p
import pytest
from test_near_copies import brute
from test_operators import PASSAGE, TEXTS, brute_windows, plain_features, plain_shard, water

from binloom.llm import quality

SF = "/root/testdata/sf0.001"
#: Further columns, with names that the operators use inside.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, whole int, hash long, before double, cell int, `a.b` string"


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    rows = [(i, t, None if i % 3 else "en", None if i % 4 == 0 else f"s{i % 3}", len(t or ""), f"r{i}", i, 5, 1.5, 3, "x") for i, t in enumerate(TEXTS)]
    none = (None, "no id at all here, and a few more words to make some", None, None, 0, None, None, None, None, None, None)
    rows += [rows[5], rows[8], none, none, (3, "another text of the same id as before", "en", "s1", 0, "q", 1, 2, 0.0, 9, "y")]
    rows += [(50, None, None, None, None, None, None, None, None, None, None), (51, PASSAGE + "x", "en", "s9", 1, "", 0, 0, 0.0, 0, "")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def folder(spark, odd, tmp_path_factory):
    """Labels and a benchmark that say something of the odd rows."""
    path = tmp_path_factory.mktemp("odd")
    spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(15)] * 2 + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog while forty two other animals"), (2, None), (3, "ONE two")], "item_id long, text string").write.parquet(str(path / "benchmark.parquet"))
    return str(path)


def pairs(df):
    return Counter((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect())


def plain(name, spark, docs, sf):
    """(doc_id, text) of the rows that a stage keeps, with their number."""
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.select("doc_id", "text", "source").collect()]
    if name == "quality":
        model = quality.fit_quality(docs, spark.read.parquet(f"{sf}/labels.parquet"))
        worth = lambda t: sum(w for w, on in zip(model.weights, (x >= c for x, cuts in zip(plain_features(t), model.cuts) for c in cuts)) if on)
        return Counter((d, t) for d, t, _ in rows if worth(t) >= model.threshold - 1e-9)
    if name == "near_duplicates":
        label, _, _ = brute([r[:2] for r in rows])
        best = {}
        for (d, t, _), c in zip(rows, label):
            best.setdefault(c, []).append((d is None, d or 0, d, t))
        least = [(min(g, key=lambda x: x[:2])[2], {x[3] for x in g if x[:2] == min(y[:2] for y in g)}) for g in best.values()]
        return least
    if name == "decontaminate":
        items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
        hits = list(brute_windows([r[:2] for r in rows], items))
        return Counter(r[:2] for r, h in zip(rows, hits) if not h[2])
    raise KeyError(name)


@pytest.mark.parametrize("table", ["driver", "odd"])
def test_stages(spark, tmp_path, odd, folder, table):
    sf = SF if table == "driver" else folder
    docs = spark.read.parquet(f"{SF}/documents.parquet") if table == "driver" else odd
    for k, (name, stage) in enumerate(p.STAGES):
        out = stage(spark, docs, sf)
        out.write.parquet(str(tmp_path / name))
        kept = spark.read.parquet(str(tmp_path / name))
        had, got = pairs(docs), pairs(kept)
        assert kept.columns == docs.columns + (["shard", "slot"] if k == 4 else [])
        whole = Counter(map(tuple, docs.collect()))
        assert all(tuple(r)[: len(docs.columns)] in whole for r in kept.collect())
        if name in ("quality", "decontaminate"):
            assert got == plain(name, spark, docs, sf)
        elif name == "near_duplicates":
            want, left = plain(name, spark, docs, sf), got.copy()
            for d, texts in want:
                one = next(t for t in texts if left[(d, t)])
                left[(d, one)] -= 1
            assert not +left
        elif name == "mix":
            size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
            rows = [(r["source"], size(r["text"])) for r in docs.select("source", "text").collect()]
            totals = Counter()
            for s, n in rows:
                totals[s] += n
            names = sorted(totals, key=lambda s: (s is None, s or ""))
            goal = water(dict(totals), {s: (3, 1, 2)[j % 3] for j, s in enumerate(names)}, 1.5 * sum(totals.values()), 2)
            words, longest = Counter(), Counter()
            for r in kept.select("source", "text").collect():
                words[r["source"]] += size(r["text"])
            for s, n in rows:
                longest[s] = max(longest[s], n)
            # whole documents: the last one of a source may go over its target
            assert all(goal[s] - 1 <= words[s] < goal[s] + longest[s] + 1 for s in names if totals[s])
            assert all(got[x] <= 2 * had[x] for x in got) and not any(size(t) == 0 for _, t in got)
        else:
            rows = kept.select("doc_id", "shard", "slot").toPandas()
            assert got == had and rows.groupby("shard").slot.agg(lambda s: sorted(s) == list(range(len(s)))).all()
            assert all(r["shard"] == plain_shard(r["doc_id"], p.SHARDS) for r in kept.select("doc_id", "shard").collect())
        docs = kept if table == "driver" else odd


def test_run_is_the_stages_in_turn(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in p.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    assert Counter(map(tuple, p.run(spark, SF).collect())) == Counter(map(tuple, docs.collect()))


def test_empty_documents(spark, odd, folder):
    for docs in (spark.read.parquet(f"{SF}/documents.parquet").limit(0), odd.limit(0)):
        for _, stage in p.STAGES:
            docs = stage(spark, docs, folder)
            assert docs.count() == 0
