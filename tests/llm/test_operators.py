"""The ten operators against brute force, on small tables of odd texts and on the smallest driver tables."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import oracle
import pytest
import xxhash
from pyspark.sql import functions as F

from binloom.llm import decontaminate, html_mincut, merkle, mixing, near_copies, quality, queries, sharding, simhash, substrings, token_counts, toxicity

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"word{i % 977}" for i in range(30_000))
PASSAGE = "the quick brown fox jumps over the lazy dog while forty two other animals look on in silence and wonder what comes next " * 3
TEXTS = [None, "", "   \n\t ", "one", "one two", "same text here", "same text here", "A b. C d!\n\nNext part\nline", LONG, LONG + " tail", "x" * 5000, "é ñ 漢字 🙂 test", PASSAGE, "before " + PASSAGE + "after", "Der " * 800]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tie string, part int, cell int, shard_id int, key string, run long, anchor long"


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts with repeated rows, a null id, null sources, and columns whose names the operators use inside."""
    rows = [(i, t, None if i % 3 else "en", None if i % 4 == 0 else f"s{i % 3}", len(t or ""), "t", 1, 2, 3, "k", 4, 5) for i, t in enumerate(TEXTS)]
    rows += [rows[5], rows[8], (None, "no id at all", None, None, 0, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# 1


def test_minimum_cut_is_exact():
    r = random.Random(2)
    for _ in range(300):
        n = r.randint(1, 9)
        costs, edges = [r.uniform(-3, 3) for _ in range(n)], [(i, j, r.uniform(0, 2)) for i in range(n) for j in range(i) if r.random() < 0.5]
        energy = lambda x: sum(abs(round(c * 1000)) for c, b in zip(costs, x) if (c > 0) != b) + sum(round(w * 1000) for i, j, w in edges if x[i] != x[j])  # noqa: B023, E731
        assert energy(html_mincut.minimum_cut(costs, edges)) == min(map(energy, itertools.product([False, True], repeat=n)))


PAGE = """<html><head><title>T</title><style>p{}</style></head><body class=page><header><a href=/>Home</a></header><nav><ul><li><a href=a>A</a></ul></nav>
<div class="cookie-notice">We use cookies, a lot of them, on this site.</div><div id=main-content><article><h1>Head &amp; title</h1><p>First  <b>para</b>graph,
with&nbsp;a <a href=x>link</a>.<p>Of.<aside>By the way.</aside><script>var t="</p>";</script><form><p>Your mail</p><input></form></article>
<section class="comments"><p>First reader comment, quite long, with many words in it.</p></section></div><footer>&copy; us</footer></body></html>"""


def test_extraction_keeps_the_article_only():
    assert html_mincut.extract(PAGE) == "Head & title\n\nFirst paragraph, with a link.\n\nOf."
    for cut in range(0, len(PAGE), 7):
        html_mincut.extract(PAGE[:cut])  # any page may end anywhere


def test_names_that_tell_of_other_elements():
    menu, text = "<ul class='menu'><li><a href=a>Home</a></li></ul>", "<p>The text of the page, long enough to be one.</p>"
    page = f"<div class='layout has-sidebar no-comments'>{menu}<div class='post'><div class='post-header'><h1>Title</h1></div>{text}</div><div class='post-comments'>{text}</div></div>"
    assert html_mincut.extract(page) == "Title\n\nThe text of the page, long enough to be one."


MENU = "<ul><li><a href=a>Home</a></li><li><a href=b>News</a></li><li><a href=c>About us</a></li></ul>"
LINES = ["The title", "First paragraph of the story, with enough words to be one.", "Of", "Another paragraph that is long enough to be text, as before."]
STORY = f"<h1>{LINES[0]}</h1>" + "".join(f"<p>{x}</p>" for x in LINES[1:])


@pytest.mark.parametrize("name", ["story-form", "text search-result", "side-story", "article tags-2", "article-comments-enabled", "search", "comments", "sidebar menu"])
def test_a_name_around_the_article_does_not_drop_it(name):
    page = f"<body><nav>{MENU}</nav><div class='{name}'><article>{STORY}</article></div><div class=ad>Buy our things now, they are good.</div><footer>us</footer></body>"
    assert html_mincut.extract(page) == "\n\n".join(LINES)


def test_the_cut_outvotes_the_classifier():
    """Neutral names, no article: neighbours keep a line that looks like none, and drop a comment that looks like text."""
    remark = "<h3>2 comments</h3><p>I liked this one a lot, thank you for it.</p><p>Bob</p>"
    more = "And one more that goes on for a while, to fill the page with words."
    page = f"<div class=a1>{MENU}</div><div class=a2>{STORY}<ul><li>Point</li><li>Item</li></ul><p><a href=x>The source</a></p><p>{more}</p></div><div class=a3>{remark}</div><div class=a4>Copyright us</div>"
    assert html_mincut.extract(page) == "\n\n".join([*LINES, "Point", "Item", "The source", more])
    assert html_mincut.extract(page, smoothness=0.0) != html_mincut.extract(page)
    blocks, elements = html_mincut.blocks_of(page)
    costs = html_mincut.costs_of(blocks, elements)
    keep = html_mincut.minimum_cut(costs, html_mincut.edges_of(blocks))
    assert {b.text for b, c, k in zip(blocks, costs, keep) if (c > 0) != k} == {"I liked this one a lot, thank you for it.", "The source"}


def test_boilerplate_beside_and_inside_an_article():
    remarks = "<section class='comments'><article><p>First reader comment, quite long, with many words in it.</p></article><article><p>Another one.</p></article></section>"
    inside = "<aside>By the way, something else.</aside><div class='ad-box'><p>Buy our things now, they are really good, and cheap.</p></div>"
    half = STORY.replace("<p>Of</p>", f"{inside}<p>Of</p>")
    page = f"<header><h1>Site</h1></header><main><article><header><h1>{LINES[0]}</h1></header>{half.replace(f'<h1>{LINES[0]}</h1>', '')}</article></main>{remarks}<div class=x><p>A teaser of some length, for another page.</p></div>"
    assert html_mincut.extract(page) == "\n\n".join(LINES)


def test_nesting_costs_nothing():
    import time

    def seconds(n):
        began = time.process_time()
        assert html_mincut.extract("<div><b>x</i>" * n + "</p>" * n) is not None
        return time.process_time() - began

    seconds(100)
    assert seconds(16_000) < 16 * seconds(2000) + 0.5


def test_clashing_columns_give_way(spark, docs, labels):
    """Extra columns with an operator's own names, dots in them or not: the result's columns take their place, others stay."""
    taken = "score Shard slot fingerprint utf8 __score __row __cell __shard hash id row size y a.b".split()
    odd = docs.select("*", *[F.lit(k).alias(n) for k, n in enumerate(taken)])
    left = lambda *gone: [c for c in odd.columns if c.lower() not in gone]
    model = quality.fit_quality(odd, labels)
    assert quality.with_score(odd, model).columns == [*left("score"), "score"]
    assert rows(quality.with_score(odd, model).select("doc_id", "score")) == rows(quality.with_score(docs, model).select("doc_id", "score"))
    prints = merkle.fingerprint_documents(odd)
    assert prints.columns == [*left("fingerprint"), "fingerprint"] and {r["fingerprint"][32] for r in prints.select("fingerprint").collect()} == {":"}
    shards = sharding.shard_documents(odd, [1.0] * 5)
    assert shards.columns == [*left("shard", "slot"), "shard", "slot"] and shards.where("shard between 0 and 4").count() == docs.count()
    for whole in (lambda d: quality.accepted_documents(d, labels), near_copies.distinct_documents, lambda d: decontaminate.clean_documents(d, docs.limit(0).select(F.col("doc_id").alias("item_id"), "text")), mixing.mixed_corpus):
        assert rows(whole(odd).select("doc_id", "`a.b`", "__row")) == rows(whole(docs).select("doc_id", F.lit(14), F.lit(6)))
    pages = spark.createDataFrame([(1, "u", PAGE, "old", 7)], "page_id long, url string, html string, Text string, n_chars int")
    assert [c for c in html_mincut.extract_pages(pages).columns] == ["page_id", "url", "text", "n_chars"]


def test_pages_and_odd_pages(spark):
    pages = spark.createDataFrame([(1, "u", None, "x"), (2, None, "", "x"), (3, "u", "</p><p>", None), (3, "u", "</p><p>", None), (4, "u", PAGE, "y"), (5, "u", "plain & text", "y"), (6, "u", "<p>" + "a " * 50_000, "y")], "page_id long, url string, html string, block string")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_mincut.extract_pages(pages).collect()}
    assert got[1] == got[2] == got[3] == ("", 0) and got[4][0].startswith("Head") and got[6][1] == 99_999
    assert html_mincut.extract_pages(pages.limit(0)).count() == 0
    real = spark.read.parquet(f"{SF}/pages.parquet")
    for r in html_mincut.op1_mincut_html(spark, SF).join(real.select("page_id", "html"), "page_id").collect():
        body = re.search(r"<article>(.*?)(</article>|\Z)", r["html"], re.S)[1]
        import html as h

        want = [" ".join(h.unescape(re.sub(r"</?b>|<br>", " ", p)).split()) for p in re.split(r"</?(?:p|h1)>", body)]
        assert r["text"] == "\n\n".join(w for w in want if w) and r["n_chars"] == len(r["text"])


# 2 and 6


def plain_mix(x):
    m = (1 << 64) - 1
    for _ in range(2):
        x = (x ^ x >> 32) * 0xD6E8FEB86659FD93 & m
    return x ^ x >> 32


def plain_bucket(gram):
    """The bucket of one n-gram, from its characters alone."""
    base, m = 0x2545F4914F6CDD1D, (1 << 64) - 1
    h = sum(plain_mix(ord(c) + 1) * pow(base, k, 1 << 64) for k, c in enumerate(gram)) & m
    return plain_mix(h * (2 * len(gram) + 0x9E3779B97F4A7C15) & m) >> 64 - toxicity.BUCKET_BITS


def plain_grams(text):
    low = (text or "").lower()
    return Counter(plain_bucket(low[i : i + n]) for n in toxicity.ORDERS for i in range(len(low) - n + 1))


def test_toxicity_against_a_plain_version(spark, docs, labels):
    """Counts, ratios and scores from strings and dictionaries; the weights alone are the model's."""
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    train = [(texts[r["doc_id"]], r["toxic"]) for r in labels.collect() if r["toxic"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5]
    grams = [(plain_grams(t), y) for t, y in train]
    df = {y: Counter(b for g, z in grams if z == y for b in g) for y in (0, 1)}
    rows = toxicity.labelled_documents(docs, labels, "toxic", 5, 0).select("text", "y")
    got = {r["bucket"]: (r["clean"], r["toxic"]) for r in toxicity._count_grams(rows, toxicity.ORDERS).collect()}
    assert got == {b: (df[0][b], df[1][b]) for b in df[0].keys() | df[1].keys()}
    model = toxicity.fit_toxicity(docs, labels)
    chosen = {int(b): int(k) for b, k in enumerate(model.index) if k >= 0}
    n = Counter(y for _, y in train)

    def chi(b):
        c, t = df[0][b], df[1][b]
        return (n[0] + n[1]) * (t * n[0] - c * n[1]) ** 2 / (n[0] * n[1] * (c + t) * (n[0] + n[1] - c - t + 1))

    assert sorted(chosen) == sorted(b for b in got if sum(got[b]) >= 3 and chi(b) >= toxicity.LEVEL)
    for r in toxicity.score_toxicity(docs.where("doc_id < 30"), model).collect():
        total = model.bias + sum(model.weights[chosen[b]] * (1 + math.log(tf)) for b, tf in plain_grams(texts[r["doc_id"]]).items() if b in chosen)
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-total)), abs=1e-6)


def test_sparse_fit_is_the_dense_one(monkeypatch):
    from binloom.llm import linear

    monkeypatch.setattr(linear, "FIT_ENTRIES", 100)
    r = np.random.default_rng(5)
    x = r.normal(size=(300, 12)).astype(np.float32) * (r.random((300, 12)) < 0.3)
    y = (r.random(300) < 1 / (1 + np.exp(-(x @ r.normal(size=12) + 0.5)))).astype(float)
    row, feature = np.nonzero(x)
    got = linear.fit_sparse_logistic(row, feature, x[row, feature], y, 12, 1.0)
    assert np.allclose(got, linear.fit_logistic(x, y, 1.0), atol=1e-3)
    assert linear.fit_sparse_logistic(row[:0], feature[:0], x[row, feature][:0], y, 0, 1.0) == pytest.approx([math.log(y.mean() / (1 - y.mean()))], abs=1e-3)


def test_a_text_in_pieces_has_the_grams_of_the_whole():
    r = random.Random(3)
    text = "".join(r.choice("abcdeÉß ") for _ in range(5000))
    for step in (64, 997, 10_000):
        found = Counter()
        for *_, bucket, done in toxicity.gram_steps([text], toxicity.ORDERS, toxicity.Roller(100), step):
            found.update(bucket.tolist())
        assert done and found == plain_grams(text)


def plain_features(text):
    data = (text or "").encode()
    size, words = max(len(data), 1), data.split(None)
    words = [w for w in re.split(rb"[ \t\n\r\x0b\x0c]+", data) if w]
    n, pairs = max(len(words), 1), list(zip(words, words[1:]))
    share = lambda chars: sum(b in chars for b in data) / size
    caps = sum(2 * sum(65 <= b < 91 for b in w) >= max(len(w), 3) for w in words) / n
    return [
        math.log1p(len(words)), sum(map(len, words)) / n, sum(len(w) > 12 for w in words) / n, share(range(65, 91)), share(range(48, 58)), share(b".!?"), share(b",;:"), share(b"|"),
        share(b"#$%&*@^~=+<>_\\/{}[]"), share(b"\"'()-`"), share(range(128, 256)), share(b" \t\r\x0b\x0c"), share(b"\n"), len(set(words)) / n, len(set(pairs)) / max(len(words) - 1, 1),
        sum(a == b for a, b in pairs) / n, max(Counter(words).values(), default=0) / n, caps, sum(65 <= w[0] < 91 for w in words) / n, math.log1p(len(words) / (data.count(b"\n") + 1)),
    ]


def test_quality_against_a_plain_version(spark, docs, labels, monkeypatch):
    """Features from strings; the threshold as the quantile of all labelled; scores from steps one by one."""
    texts = [*TEXTS, *(r["text"] for r in docs.limit(60).collect())]
    data = [(t or "").encode() for t in texts]
    edges = np.concatenate([[0], np.cumsum([len(d) for d in data])])
    for step in (quality.STEP_BYTES, 100):
        monkeypatch.setattr(quality, "STEP_BYTES", step)
        x = quality.describe(np.frombuffer(b"".join(data), np.uint8), edges)
        assert np.allclose(x, [plain_features(t) for t in texts])
    monkeypatch.undo()
    model = quality.fit_quality(docs, labels)
    worth = lambda t: sum(w for w, on in zip(model.weights, (plain >= c for plain, cuts in zip(plain_features(t), model.cuts) for c in cuts)) if on)
    of = {r["doc_id"]: r["text"] for r in docs.collect()}
    train = [(worth(of[r["doc_id"]]), r["quality"]) for r in labels.collect() if r["quality"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2]
    bad = sum(y == 0 for _, y in train)
    assert sorted(w for w, _ in train)[bad - 1] == pytest.approx(model.threshold, abs=1e-6)
    for r in quality.with_score(docs, model).where("doc_id < 40").collect():
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-(worth(r["text"]) - model.threshold + math.log(0.7 / 0.3)))), abs=1e-6)


def test_every_row_of_both_classes_is_in_pairs():
    for n, m in ((3, 50), (1, 1), (200, 7)):
        winner, loser = quality.pairings(np.arange(n), 1000 + np.arange(m), 4)
        for side, size in ((winner, n), (loser, m)):
            assert len(side) == 4 * max(n, m) and min(Counter(side.tolist()).values()) >= 4 * max(n, m) // size and len(set(side.tolist())) == size


def test_the_sample_is_bounded_by_documents(spark):
    """An id that repeats with other texts counts for each; repeated rows count once."""
    docs = spark.createDataFrame([(1, f"text number {k}") for k in range(3000)] + [(2, "the same text")] * 500, "doc_id long, text string")
    known = quality.labelled_documents(docs, spark.createDataFrame([(1, 1), (2, 0), (None, 1)], "doc_id long, quality int"), "quality", 4, 9)
    assert known.count() == 3001 and 150 < quality.sampled(known, 300).count() < 450


@pytest.mark.parametrize("fit, score, label", [(toxicity.fit_toxicity, toxicity.score_toxicity, "toxic"), (quality.fit_quality, quality.with_score, "quality")])
def test_classifiers(spark, odd, empty, fit, score, label):
    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    marks = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = fit(big, marks)
    got = score(big.select("doc_id", "text"), model).join(marks, "doc_id").where("crc32(cast(doc_id as string)) % 5 = 0").toPandas()
    good = (got["score"] >= (0.5 if label == "toxic" else 0.7)) == (got[label] == 1)
    assert good.mean() > 0.9
    found = score(odd, model)
    assert found.count() == odd.count() and found.where("score is null or score < 0 or score > 1").count() == 0
    assert found.where("doc_id in (5, 6)").select("score").distinct().count() == 1
    assert score(empty, model).count() == 0
    blind = fit(big, marks.limit(0))
    assert score(odd, blind).where("score is null").count() == 0
    assert rows(score(odd, fit(big, marks)).select("doc_id", "score")) == rows(found.select("doc_id", "score"))


# 3


def plain_draw(*parts):
    """A number below 2^60 from MD5, nulls told apart from texts."""
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:15], 16)


def tag(value):
    return "null" if value is None else f"={value}"


def plain_shard(key, shards):
    """The shard of the least -ln(u), one key and shard at a time."""
    return min(range(shards), key=lambda shard: -math.log((plain_draw(tag(key), shard) + 0.5) / 2.0**60))


def test_sharding_against_a_plain_version(docs, odd):
    for df in (docs, odd):
        got = sharding.shard_records(df, [1.0] * 24, grown=[1.0] * 25).collect()
        want = sorted(((r["doc_id"], len((r["text"] or "").encode()) + 8, zlib.crc32((r["text"] or "").encode()), plain_shard(r["doc_id"], 24), plain_shard(r["doc_id"], 25)) for r in df.select("doc_id", "text").collect()), key=repr)
        assert sorted(((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["grown_shard"]) for r in got), key=repr) == want
        order = sorted(got, key=lambda r: (r["shard"], plain_draw(tag(r["doc_id"]), r["text_crc32"], r["size"])))
        for shard in {r["shard"] for r in got}:
            assert [r["slot"] for r in order if r["shard"] == shard] == list(range(sum(r["shard"] == shard for r in got)))


@pytest.mark.parametrize("table", ["driver", "odd"])
@pytest.mark.parametrize("name", ["op3_rendezvous_sharding", "op4_curriculum_mixing"])
def test_shards_and_mix_match_sql(spark, odd, tmp_path, table, name):
    """Row for row, on the driver's table and on odd rows, some of them repeated."""
    sf = SF
    if table == "odd":
        sf = str(tmp_path)
        twice = odd.select("doc_id", "text", "lang", "source")
        twice.unionByName(twice.where("doc_id is null or doc_id % 2 = 0")).coalesce(1).write.parquet(f"{sf}/documents.parquet")
        con = duckdb.connect()
        con.execute(f"create view documents as select * from read_parquet('{sf}/documents.parquet/*.parquet')")
    else:
        con = oracle.connect(sf)
    assert oracle.compare(queries.QUERIES[name](spark, sf), con, queries.ORACLE_SQL[name]) == ""


def test_copies_by_many_tasks(spark):
    from binloom.llm.common import each_copy

    df = spark.createDataFrame([("a", 1), ("b", 10), ("c", 3)], "k string, n long")
    assert rows(each_copy(df, "n", "copy", 3).select("k", "copy")) == sorted((k, i) for k, n in (("a", 1), ("b", 10), ("c", 3)) for i in range(n))
    same = spark.createDataFrame([(7, "one text")] * 50 + [(None, f"text {i}") for i in range(50)] + [(None, "null id")] * 9, "doc_id long, text string")
    got = sharding.shard_records(same, [1.0] * 3, cells=4).toPandas()
    assert len(got) == 109 and got.groupby("shard").slot.agg(lambda s: sorted(s) == list(range(len(s)))).all()


def test_sharding(odd, empty):
    got = sharding.shard_records(odd, [1.0] * 5, grown=[1.0] * 6, cells=4).toPandas()
    assert len(got) == odd.count() and (got.groupby("shard").slot.agg(lambda s: sorted(s) == list(range(len(s))))).all()
    assert set(got.grown_shard[got.shard != got.grown_shard]) <= {5}
    assert got.loc[got.doc_id == 0, "size"].item() == 8 and got.loc[got.doc_id == 0, "text_crc32"].item() == 0
    assert sharding.shard_records(empty, [1.0] * 5).count() == 0
    assert sharding.shard_documents(odd, [1.0] * 5).columns == [*odd.columns, "shard", "slot"]


def test_shards_follow_weights(spark):
    got = spark.range(20_000).select(sharding.rendezvous("id", [1.0, 0.0, 3.0]).alias("s")).groupBy("s").count().collect()
    share = {r["s"]: r["count"] / 20_000 for r in got}
    assert set(share) == {0, 2} and abs(share[2] - 0.75) < 0.02


# 4


def water(sizes, weights, total, cap):
    """Targets by sharing anew until none is above its cap."""
    out, free, left = {}, set(sizes), total
    while free:
        whole = sum(weights[s] for s in free)
        over = {s for s in free if left * weights[s] / whole > cap * sizes[s]}
        if not over:
            return out | {s: left * weights[s] / whole for s in free}
        for s in over:
            out[s] = cap * sizes[s]
        left -= sum(out[s] for s in over)
        free -= over
    return out


def test_mixing(docs, odd, empty):
    for df in (docs, odd):
        got = mixing.mix_documents(df).toPandas()
        got["source"] = got["source"].where(got["source"].notna(), None)
        got["s"] = [("1" if s is None else "0") + (s or "") for s in got["source"]]
        sizes = got.groupby("s")["size"].sum().to_dict()
        want = water(sizes, {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(sizes))}, 1.5 * sum(sizes.values()), 2)
        for s, g in got.groupby("s"):
            assert g.target.iloc[0] == pytest.approx(want[s]) and abs(g.taken.sum() - want[s]) <= 1 and g.source_size.iloc[0] == sizes[s]
        assert (got.taken <= 2 * got["size"]).all() and len(got) == df.count()
        assert all(0 <= x <= 1 for p in got.positions for x in p)
        assert rows(mixing.mix_documents(df.repartition(5)).select("doc_id", "taken")) == rows(mixing.mix_documents(df).select("doc_id", "taken"))
    assert mixing.mix_documents(empty).count() == 0 and mixing.mixed_corpus(empty).count() == 0
    assert mixing.mixed_corpus(docs).columns == docs.columns


def test_mix_against_a_plain_version(spark, docs, odd):
    """Which words of which document are taken, and when, by walking the order of each source word by word."""
    for df in (docs, odd, spark.createDataFrame([(1, "a b c", "x")] * 5 + [(None, "d e", "x"), (2, "f", None)], "doc_id long, text string, source string")):
        data = [(r["doc_id"], r["text"], r["source"]) for r in df.select("doc_id", "text", "source").collect()]
        size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        sources = sorted({s for *_, s in data}, key=lambda s: (s is None, s or ""))
        totals = {s: sum(size(t) for _, t, z in data if z == s) for s in sources}
        goal = water(totals, {s: (3, 1, 2)[k % 3] for k, s in enumerate(sources)}, 1.5 * sum(totals.values()), 2)
        want = []
        for k, s in enumerate(sources):
            order = sorted((r for r in data if r[2] == s), key=lambda r: plain_draw(tag(r[0]), r[1] or ""))
            taken, first, at = [0] * len(order), [None] * len(order), 0
            knots = mixing.SCHEDULES[k % 3]
            grid = np.linspace(0, 1, 100_001)
            w = np.interp(grid, *zip(*knots))
            demand = np.concatenate([[0], np.cumsum((w[1:] + w[:-1]) / 2)])
            for _ in range(2):
                for i, r in enumerate(order):
                    n = max(0, min(size(r[1]), round(goal[s]) - at))
                    if n and first[i] is None:
                        first[i] = float(np.interp(at / goal[s], demand / demand[-1], grid))
                    taken[i], at = taken[i] + n, at + size(r[1])
            want += [(r[0], s, size(r[1]), taken[i], first[i]) for i, r in enumerate(order)]
        got = [(r["doc_id"], r["source"], r["size"], r["taken"], r["positions"][0] if r["positions"] else None) for r in mixing.mix_documents(df, cells=1024).collect()]
        assert len(got) == len(want)
        for x, y in zip(sorted(got, key=repr), sorted(want, key=repr)):
            assert x[:4] == y[:4] and (x[4] is None) == (y[4] is None) and (x[4] is None or abs(x[4] - y[4]) < 1e-3)
        mixed = [r["doc_id"] for r in mixing.mixed_corpus(df, cells=1024).collect()]
        passes = lambda w: (w[3] > 0) + (w[3] > w[2])
        assert Counter(mixed) == Counter(d for w in want for d in [w[0]] * passes(w))


def test_schedule_inverse(spark):
    knots = [(0.0, 0.0), (0.3, 2.0), (0.6, 0.0), (1.0, 1.0)]
    got = spark.range(1, 100).select((F.col("id") / 100).alias("x"), mixing.invert(F.col("id") / 100, knots).alias("t")).collect()
    grid = np.linspace(0, 1, 200_001)
    w = np.interp(grid, *zip(*knots))
    c = np.concatenate([[0], np.cumsum((w[1:] + w[:-1]) / 2)])
    for r in got:
        assert r["t"] == pytest.approx(np.interp(r["x"], c / c[-1], grid), abs=1e-3)


# 5


def brute_windows(docs, items, window=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = lambda s: word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), s or ""))
    of = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            of.setdefault(tuple(w[k : k + window]), set()).add(str(i))
    for d, t in docs:
        w = words(t)
        hit, found = set(), set()
        for n in {len(x) for x in of}:
            for k in range(len(w) - n + 1):
                if (who := of.get(tuple(w[k : k + n]))) is not None:
                    found |= who
                    hit |= set(range(k, k + n))
        yield d, len(w), len(hit), sorted(found)


def test_decontamination(spark, docs, odd, empty):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text")
    short = spark.createDataFrame([(900, "Same TEXT"), (901, "one"), (902, None), (903, " ... "), (904, "漢字 🙂 test"), (10, PASSAGE), (10, PASSAGE)], "item_id long, text string")
    thue = "a"  # a word of 1,024 letters and its opposite, which a linear hash of the bytes cannot tell apart
    while len(thue) < 1024:
        thue += thue.translate(str.maketrans("ab", "ba"))
    other = thue.translate(str.maketrans("ab", "ba"))
    words = spark.createDataFrame([(1, other), (2, thue), (3, "x " * 30 + thue + " " + PASSAGE * 40), (4, (thue + " ") * 30 + PASSAGE)], "doc_id long, text string")
    for df, b in ((docs, bench), (odd, short), (docs, short), (words, short), (words, spark.createDataFrame([(1, thue), (2, PASSAGE)], "item_id long, text string"))):
        want = sorted(brute_windows([(r[0], r[1]) for r in df.select("doc_id", "text").collect()], [tuple(r) for r in b.collect()]), key=repr)
        for size, shard in ((decontaminate.BLOCK_BYTES, decontaminate.SHARD_BYTES), (decontaminate.BLOCK_BYTES, 700), (1500, decontaminate.SHARD_BYTES)):  # one block or several; texts whole or in pieces
            found = decontaminate.find_windows(df, b, block_bytes=size, shard_bytes=shard)
            assert rows(found.select("doc_id", "n_words", "n_hit", "item_ids")) == want
            clean = Counter(r[0] for r in decontaminate.clean_documents(df, b, block_bytes=size, shard_bytes=shard).collect())
            assert clean == Counter(w[0] for w in want if not w[2])
    assert decontaminate.clean_documents(empty, bench).count() == 0
    assert decontaminate.clean_documents(odd, bench.limit(0)).count() == odd.count()


# 7


def test_merkle_trees():
    assert merkle.fingerprint("a b.\n\nc d") == merkle.fingerprint("a b.\n\nc d") != merkle.fingerprint("a b.\n\nc  d")
    for t in TEXTS:
        assert "".join(x for s in merkle.tree(t or "") for p in s for x in p) == (t or "")
    a, b = (merkle.fingerprint(f"First part here.\n\nSecond {x} there.\nThird one.") for x in ("part", "item"))
    assert merkle.differing(a, b) == ([(1, 0, 0)], [(1, 0, 0)]) and merkle.differing(a, a) == ([], []) and 0 < merkle.likeness(a, b) < 1


def test_an_inserted_or_removed_section_is_the_only_one_named():
    sections = [f"Section {k} starts. It has two lines\nand a second line here." for k in range(4)]
    whole = merkle.fingerprint("\n\n".join(sections))
    for k in range(4):
        more = merkle.fingerprint("\n\n".join([*sections[:k], "Something new. And more.", *sections[k:]]))
        gone, new = merkle.differing(whole, more)
        assert gone == [] and {at[0] for at in new} == {k} and merkle.differing(more, whole) == (new, gone)
    moved = merkle.differing(whole, merkle.fingerprint("\n\n".join([sections[0], sections[1].replace("two", "no"), "New one.", *sections[2:]])))
    assert {at[0] for at in moved[0]} == {1} and {at[0] for at in moved[1]} == {1, 2}


def plain_lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_alignment_is_in_order_and_near_the_longest():
    r = random.Random(8)
    for _ in range(300):
        a = [r.randrange(40) for _ in range(r.randrange(15))]
        b = a.copy()
        for _ in range(r.randrange(4)):
            at = r.randrange(len(b) + 1)
            b[at : at + r.randrange(3)] = [r.randrange(100, 200) for _ in range(r.randrange(3))]
        gaps = merkle.aligned(a, b)
        keep = lambda x, side: [v for k, v in enumerate(x) if not any(g[side] <= k < g[side + 1] for g in gaps)]
        assert keep(a, 0) == keep(b, 2) and len(keep(a, 0)) <= plain_lcs(a, b)
        if len(set(a)) == len(a) and len(set(b)) == len(b):
            assert len(keep(a, 0)) == plain_lcs(a, b)


def plain_fingerprint(text):
    """The tree from its definition: sections end after blank lines, paragraphs at lines, leaves at sentences or 8 words."""
    digest = lambda data, size: hashlib.blake2b(data, digest_size=size).digest()
    sections, lines = [[]], (text or "").splitlines(keepends=True)
    for k, line in enumerate(lines):
        sections[-1].append(line)
        if line.endswith("\n") and not line.strip(" \t\r\n") and k and (k + 1 == len(lines) or lines[k + 1].strip(" \t\r\n")) and lines[k - 1].endswith("\n"):
            sections.append([])
    sections = [s for s in sections if s] or [[]]

    def leaves(line):
        out, words = [""], 0
        for piece in re.findall(r"\s+|\S+", line):
            if words and (words == 8 or ended) and not piece.isspace():  # noqa: F821
                out, words = [*out, ""], 0
            out[-1] += piece
            if not piece.isspace():
                words, ended = words + 1, piece[-1] in ".!?"  # noqa: F841
        return [x for x in out if x]

    marks = [[[digest(x.encode(), 8) for x in leaves(line)] for line in s] for s in sections]
    heads = [digest(b"s" + b"".join(digest(b"p" + b"".join(p), 16) for p in s), 16) for s in marks]
    return digest(b"r" + b"".join(heads), 16).hex() + ":" + ";".join(f"{h[:4].hex()}[{','.join(''.join(x[:3].hex() for x in p) for p in s)}]" for h, s in zip(heads, marks))


def test_fingerprints_against_a_plain_version():
    for t in ["", "one", "A b. C d!\n\nNext part\nline", "Two. Sentences here, of many words that go on and on. Yes\n\n\nThree\n\nend.", PASSAGE, " lead\n x"]:
        assert merkle.fingerprint(t) == plain_fingerprint(t)


def test_a_repeated_id_is_spread_over_ranges(spark):
    df = spark.createDataFrame([(7, f"text number {k}") for k in range(200)] + [(None, f"none {k}") for k in range(200)], "doc_id long, text string")
    sizes = merkle.by_ranges(df, 8).where("mine").groupBy("part").count().toPandas()["count"]
    assert len(sizes) == 8 and sizes.max() < 150
    got = merkle.edited_documents(df, 8)
    assert got.count() == 400 and got.select("fingerprint").distinct().count() == 400


@pytest.mark.parametrize("ranges", [1, 3, 8])
def test_edited_documents(docs, odd, empty, ranges):
    one = odd.where("doc_id is null or doc_id not in (5, 8)")
    for df in (docs, one):
        data = sorted(((r[0], r[1] or "") for r in df.select("doc_id", "text").collect()), key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
        got = {r["doc_id"]: r for r in merkle.edited_documents(df, ranges).collect()}
        assert len(got) == len(data)
        for k, (i, t) in enumerate(data):
            other = data[(k + 1) % len(data)][1]
            new = merkle.edit(t, other)
            assert got[i]["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest() and got[i]["n_chars"] == len(t)
            assert got[i]["fingerprint"] == merkle.fingerprint(t) and got[i]["edited_fingerprint"] == merkle.fingerprint(new)
            for column, text in (("near_next", other), ("near_edited", new)):
                gone, fresh = merkle.differing(merkle.fingerprint(t), merkle.fingerprint(text))
                leaves = sum(len(p) for x in (t, text) for s in merkle.tree(x) for p in s)
                near = got[i][column]
                assert near == 1.0 if t == text else near == pytest.approx(min((leaves - len(gone) - len(fresh)) / max(leaves, 1), 1 - 1 / (leaves + 1)) if leaves else 0.0)
                if column == "near_edited":
                    assert (got[i]["n_gone"], got[i]["n_new"]) == (len(gone), len(fresh))
    assert merkle.edited_documents(empty, ranges).count() == 0
    assert merkle.edited_documents(odd, ranges).count() == odd.count()  # ties in the id


# 8


def greedy(word, pieces, unknown):
    at = n = 0
    while at < len(word):
        size = next((k for k in range(len(word) - at, 0, -1) if word[at : at + k] in pieces), 0)
        n += 1 if size else unknown(word[at])
        at += size or 1
    return n


def test_longest_match_equals_greedy(odd, empty, docs):
    r = random.Random(1)
    for _ in range(500):
        pieces = {"".join(r.choice("abc") for _ in range(r.randint(1, 5))) for _ in range(r.randint(1, 8))}
        m = token_counts.LongestMatch(pieces)
        for _ in range(10):
            w = "".join(r.choice("abcd") for _ in range(r.randint(0, 14)))
            assert m.count(w) == greedy(w, pieces, m.unknown)
    pieces, fallback = token_counts.read_pieces(token_counts.VOCABULARY)
    m, known = token_counts.LongestMatch(pieces, fallback), set(pieces)
    got = {r["doc_id"]: r for r in token_counts.count_tokens(docs).collect()}
    for d in docs.collect():
        if d["doc_id"] in got:
            assert got[d["doc_id"]]["n_tokens"] == sum(greedy("▁" + w.decode(), known, m.unknown) for w in d["text"].encode().split())
    assert token_counts.count_tokens(odd).count() == odd.count() and token_counts.count_tokens(empty).count() == 0


# 9


def brute_simhash(text, k=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(points, budget=2):
    label = list(range(len(points)))
    find = lambda x: x if label[x] == x else find(label[x])
    for i in range(len(points)):
        for j in range(i):
            if (points[i][1] ^ points[j][1]).bit_count() <= budget:
                label[find(max(find(i), find(j)))] = min(find(i), find(j))
    least = {}
    for i, (d, _) in enumerate(points):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [least.get(find(i)) for i in range(len(points))]


@pytest.fixture(scope="module")
def bridged(spark):
    """Fingerprints that only a null id's text links: three words, and two near ones found by trying."""
    r = random.Random(4)
    text = lambda: " ".join(r.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(400))
    seeds = [text() for _ in range(40)]
    near = [s.split() for s in seeds]
    rows = [(i, s) for i, s in enumerate(seeds)]
    for k, w in enumerate(near):
        for j in range(6):
            v = w.copy()
            v[r.randrange(len(v))] = r.choice(["alpha", "beta", "omega"])
            rows.append((None if j % 2 else 100 + 10 * k + j, " ".join(v)))
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def test_simhash_and_components(docs, odd, bridged, empty):
    for df in (docs, odd, bridged):
        data = [(r[0], r[1]) for r in df.select("doc_id", "text").collect()]
        points = [(d, brute_simhash(t)) for d, t in data]
        want = sorted(((d, f, c) for (d, f), c in zip(points, brute_components(points))), key=repr)
        for crowd in (simhash.CROWD, 1):  # subtrees whole, and all cut again
            got = [(r["doc_id"], r["fp"] & (1 << 64) - 1, r["component_id"]) for r in simhash.near_duplicates(df, crowd=crowd).collect()]
            assert sorted(got, key=repr) == want
    assert simhash.near_duplicates(empty).count() == 0


def test_trie_pairs_find_every_link():
    r = np.random.default_rng(3)
    base = r.integers(0, 1 << 63, 20, dtype=np.uint64)
    fps = np.unique(np.concatenate([base, *[b ^ (np.uint64(1) << r.integers(0, 64, 30, dtype=np.uint64)) ^ (np.uint64(1) << r.integers(0, 64, 30, dtype=np.uint64)) for b in base]]))
    pairs = lambda found: {(min(x, y), max(x, y)) for a, b in found for x, y in zip(a.tolist(), b.tolist())}
    for budget in (0, 1, 2, 3):
        want = {(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if (int(fps[i]) ^ int(fps[j])).bit_count() <= budget}
        assert pairs(simhash.trie_pairs(fps, np.array([0]), np.array([len(fps)]), 64, budget)) == want
        for equal in (1, 2):  # every link agrees in some choice of parts, also when these are cut again
            masks = simhash.agreements(64, budget, equal)
            assert set().union(*(pairs(simhash.pairs_of(fps, m, 64, budget)) for m in masks)) == want
            assert set().union(*(pairs(simhash.pairs_of(fps, k, 64, budget)) for m in masks for k in simhash.agreements(64, budget, equal, m))) == want


def test_long_text_is_hashed_in_steps():
    r = random.Random(0)
    text = " ".join(str(r.randrange(10**6)) for _ in range(150_000))
    assert simhash.simhash(text.encode()) == brute_simhash(text)


# 10


def brute_repeats(texts, width):
    count = Counter(t[k : k + width] for t in texts for k in range(len(t) - width + 1))
    for t in texts:
        gone = bytearray(len(t))
        for k in range(len(t) - width + 1):
            if count[t[k : k + width]] > 1:
                gone[k : k + width] = b"\1" * width
        yield len(t), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()


def digest(df):
    return sorted((len_, sum(s["to_byte"] - s["from_byte"] for s in spans), len(spans), hashlib.sha256(kept).hexdigest()) for _, len_, spans, kept in df.collect())


def test_multikey_quicksort():
    a = np.random.default_rng(0).integers(0, 3, (3000, 25)).astype(np.uint64)
    assert [tuple(x) for x in a[substrings.multikey_quicksort(a)]] == sorted(map(tuple, a))


def test_repeats(docs, odd, empty):
    small = odd.where("doc_id is null or doc_id not in (8, 9)")
    for df in (docs, small):
        texts = [(r[0] or "").encode() for r in df.select("text").collect()]
        assert digest(substrings.remove_repeats(df)) == sorted(brute_repeats(texts, 200))
    assert substrings.remove_repeats(empty).count() == 0


def test_repeats_across_many_buckets(spark):
    r = random.Random(5)
    core = "".join(r.choice("abcdefgh ") for _ in range(60))
    near = lambda: "".join(r.choice("xyz") for _ in range(r.randint(0, 6)))
    texts = [near() + core + near() + ("" if r.random() < 0.5 else core[: r.randint(20, 60)]) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = sorted(brute_repeats([t.encode() for t in texts], 40))
    for bucket_rows, tasks in ((50_000, 100), (40, 10_000), (40, 3)):  # groups inside a bucket, over many, and many in a task
        assert digest(substrings.remove_repeats(df, 40, 16, 12, bucket_rows, tasks)) == want


def crc_pair():
    """Two texts of one length and crc32, of which only one holds a passage: four bytes are set so that they agree."""
    one = b"first " + b"0123456789" * 26 + b" end of it"
    base = bytes(b"zyx" * 200)[: len(one) - 4]
    table = {zlib.crc32(b"\0" * len(base) + (1 << k).to_bytes(4, "little")) ^ zlib.crc32(b"\0" * (len(base) + 4)): 1 << k for k in range(32)}
    need, rows, four = zlib.crc32(one) ^ zlib.crc32(base + b"\0" * 4), list(table.items()), 0
    for bit in range(31, -1, -1):  # elimination over the bits
        pivot = next(((c, v) for c, v in rows if c >> bit & 1), None)
        if pivot is None:
            continue
        rows = [(c ^ pivot[0], v ^ pivot[1]) if c >> bit & 1 else (c, v) for c, v in rows if (c, v) != pivot]
        if need >> bit & 1:
            need, four = need ^ pivot[0], four ^ pivot[1]
    two = base + four.to_bytes(4, "little")
    assert zlib.crc32(one) == zlib.crc32(two) and len(one) == len(two)
    return one, two


def test_rows_of_one_id_and_crc_keep_their_own_spans(spark):
    one, two = crc_pair()
    texts = [one, two, b"before " + one[:230]]
    df = spark.createDataFrame([(None, bytearray(t)) for t in texts[:2]] + [(4, bytearray(texts[2]))], "doc_id long, text binary")
    assert digest(substrings.remove_repeats(df)) == sorted(brute_repeats(texts, 200))


def test_a_text_of_many_steps(spark):
    """5 MB with passages over the cuts between steps, and their copies in other documents."""
    r = random.Random(9)
    long = bytearray(r.randbytes(5 << 19).hex().encode())
    places = [(1 << 20) - 100, (2 << 20) - 300, (3 << 20) + 5, len(long) - 400]
    rows = [(0, bytes(long))] + [(k + 1, b"x%d " % k + bytes(long[p : p + 250 + 20 * k]) + b" y%d" % k) for k, p in enumerate(places)]
    got = {x["doc_id"]: x for x in substrings.remove_repeats(spark.createDataFrame([(k, bytearray(t)) for k, t in rows], "doc_id long, text binary")).collect()}
    assert [(s["from_byte"], s["to_byte"]) for s in got[0]["spans"]] == [(p, min(len(long), p + 250 + 20 * k)) for k, p in enumerate(places)]
    assert all([(s["from_byte"], s["to_byte"]) for s in got[k + 1]["spans"]] == [(3, 253 + 20 * k)] for k in range(4))


LONG_STORY = [f"Paragraph number {i} of the story goes on for a while, with enough words to be one, and then it ends." for i in range(12)]
BODY = "".join(f"<p>{x}</p>" for x in LONG_STORY)
REMARK = "<p>I liked this one a lot, thank you for it and so on, it is great.</p>"


@pytest.mark.parametrize("layout", [
    f"<div class='post-content'>{BODY}</div><article class='comment'>{REMARK}</article>",
    f"<div class='post-content'>{BODY}</div><section class='comments'>{f'<article>{REMARK}</article>' * 6}</section>",
    f"<div class='story'>{BODY}</div><article class='card'>A teaser.</article>",
    f"<div class='x1'>{BODY}</div><article class='card'><h3>Other</h3><p>A teaser.</p></article><article class='x2'><p>Another teaser text.</p></article>",
    f"<article>{BODY}</article><article class='card'><h3>Other story</h3><p>A teaser for the other story.</p></article>",
    f"<main><div class='body'>{BODY}</div><article class='comment'>{REMARK}</article></main>",
    f"<article>{BODY}<h3>2 Comments</h3>{REMARK}{REMARK}</article>",
    f"<div class='q'>{BODY}<h3>2 Comments</h3><ul><li>I liked this one a lot.</li><li>So did I, it was really good.</li></ul></div>",
])
def test_articles_that_are_comments_or_cards_do_not_decide(layout):
    assert html_mincut.extract(f"<body><nav>{MENU}</nav>{layout}<footer>us</footer></body>") == "\n\n".join(LONG_STORY)


def test_a_heading_of_comments_ends_at_the_next_heading():
    page = f"<body><article>{BODY}<h3>2 Comments</h3>{REMARK}<h3>What came next</h3>{BODY}</article></body>"
    assert html_mincut.extract(page) == "\n\n".join([*LONG_STORY, "What came next", *LONG_STORY])


@pytest.mark.parametrize("kinds, verdict", [([0], 0), ([1], 1), ([], 0), ([None], 0)])
def test_labels_of_one_class_predict_that_class(spark, docs, odd, kinds, verdict):
    labels = spark.createDataFrame([(i, k) for i in range(60) for k in kinds], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(docs, labels)
    for table in (docs, odd):
        scores = [r["score"] for r in toxicity.score_toxicity(table, model).collect()]
        assert len(scores) == table.count() and all((s >= 0.5) == bool(verdict) for s in scores)


def test_repeated_rows_are_spread_over_their_shard(spark, docs):
    """Whole passes of a table: no two rows of a document are neighbours, and with positions slots follow those."""
    some = docs.select("doc_id", "text", "source")
    out = sharding.shard_documents(some.unionByName(some).unionByName(some.where("doc_id % 2 = 0")), [1.0] * 3).select("doc_id", "shard", "slot").toPandas()
    for _, shard in out.sort_values("slot").groupby("shard"):
        ids = shard.doc_id.tolist()
        assert shard.slot.tolist() == list(range(len(ids))) and not any(a == b for a, b in zip(ids, ids[1:]))
    mixed = mixing.mixed_corpus(some, position="at")
    assert mixed.columns == [*some.columns, "at"]
    placed = sharding.shard_documents(mixed, [1.0] * 5, position="at").toPandas()
    for _, shard in placed.sort_values("slot").groupby("shard"):
        assert shard["at"].is_monotonic_increasing and shard.slot.tolist() == list(range(len(shard)))
