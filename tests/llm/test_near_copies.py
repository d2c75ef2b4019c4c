"""Near copies against the Jaccard similarity of all pairs."""

import random

import pytest

import corpus_pipeline
from binloom.llm import common, near_copies, simhash

SF = "/root/testdata/sf0.01"


def brute(docs, similarity=0.8):
    """Component of every row (by position), from all pairs of distinct sets; and the linked pairs."""
    sets = [frozenset(simhash.shingle_hashes((t or "").encode(), 5).tolist()) for _, t in docs]
    some = sorted(set(sets), key=len)
    label = {s: s for s in some}

    def find(s):
        while label[s] is not s:
            s = label[s]
        return s

    pairs = []
    for i, s in enumerate(some):
        for t in some[i + 1 :]:
            if len(s) < similarity * len(t):
                break
            both = len(s & t)
            if both and both >= similarity * (len(s) + len(t) - both) - 1e-9:
                pairs.append((s, t))
                label[find(s)] = find(t)
    return [find(s) for s in sets], pairs, sets


def same_groups(one, other):
    seen = {}
    return all(seen.setdefault(("a", x), y) == y and seen.setdefault(("b", y), x) == x for x, y in zip(one, other))


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    data = [(r[0], r[1]) for r in docs.select("doc_id", "text").collect()]
    want, _, _ = brute(data)
    got = {r["doc_id"]: r["component"] for r in near_copies.near_copies(docs).collect()}
    assert same_groups([got[d] for d, _ in data], want)
    kept = near_copies.distinct_documents(docs)
    assert kept.columns == docs.columns and kept.exceptAll(docs).count() == 0
    first = {}
    for (d, _), c in zip(data, want):
        first[c] = min(first.get(c, d), d)
    assert sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == sorted(first.values())


@pytest.mark.parametrize("crowd", [simhash.CROWD, 8])
def test_families_of_near_copies(spark, crowd):
    """Many variants of a few texts, at all similarities around the bound: no link is false, and few are lost."""
    r = random.Random(7)
    rows = []
    for _ in range(12):
        base = [f"w{r.randrange(3000)}" for _ in range(r.choice([30, 120, 400]))]
        for _ in range(40):
            v = base.copy()
            for _ in range(r.randrange(1 + len(base) // 25)):
                v[r.randrange(len(v))] = f"n{r.randrange(10**6)}"
            rows.append((len(rows), " ".join(v)))
    want, pairs, sets = brute(rows)
    got = {x["doc_id"]: x["component"] for x in near_copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), crowd=crowd).collect()}
    of = dict(zip(sets, (got[d] for d, _ in rows)))
    assert sum(of[s] == of[t] for s, t in pairs) >= 0.95 * len(pairs)
    label = {}
    assert all(label.setdefault(got[d], c) == c for (d, _), c in zip(rows, want))  # nothing is joined that is not linked


def test_odd_rows(spark):
    text = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(5, text, "x"), (3, text.upper(), "y"), (None, text, "z"), (7, None, "a"), (8, "", "b"), (9, " \n ", "c"), (1, "aa bb cc dd", "d"), (1, "totally other words here now", "e"), (1, "aa bb cc dd", "d"), (None, "no id", "f"), (None, "no id", "f"), (2, "Der " * 900, "g"), (4, "Der " * 70, "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string")
    kept = near_copies.distinct_documents(docs)
    assert kept.columns == docs.columns
    assert sorted(kept.collect(), key=repr) == sorted([rows[1], rows[3], rows[6], rows[7], rows[9], rows[11]], key=repr)
    assert near_copies.distinct_documents(docs.limit(0)).count() == 0


def test_views_reach_the_recall():
    for n in (1, 1000, 10**6, 10**10):
        bits, views = near_copies.plan_views(n)
        assert 16 <= bits <= 64 and views >= 1
    assert near_copies.bit_rate(1.0) == 0 and 0.15 < near_copies.bit_rate(0.8) < 0.152


def brute_kept(rows):
    """The (doc_id, text) that stay of rows (doc_id, text): one a component of pairs with 5-word Jaccard >= 0.8."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    label = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                label = [label[j] if x == label[i] else x for x in label]
    groups = {}
    for k, (d, t) in zip(label, rows):
        groups.setdefault(k, []).append((d is None, d or 0, t or ""))
    return groups.values()


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_stage_against_all_pairs(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    groups = brute_kept([(r["doc_id"], r["text"]) for r in docs.collect()])
    got = sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())
    assert got == sorted(min(g)[1] for g in groups)


def test_edges_of_similarity_and_odd_rows(spark):
    base = [f"w{i}" for i in range(44)]  # 40 shingles
    edit = lambda *at: " ".join("X" if i in at else w for i, w in enumerate(base))
    rows = [(1, " ".join(base)), (2, edit(43)), (3, edit(0, 1, 2, 3)), (4, edit(20)), (5, edit(10, 30)), (6, None), (7, " \n"), (8, "one two"), (9, "ONE  two")]
    rows += [(None, " ".join(base)), (None, "no id here at all"), (None, "no id here at all"), (10, "first text of this id"), (10, "second text, quite another one")]
    docs = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    groups = brute_kept(rows)
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in near_copies.distinct_documents(docs).collect())
    assert got == sorted(min(g)[:2] for g in groups)
    assert (True, 0) in got and got.count((False, 10)) == 2
    assert near_copies.distinct_documents(docs.limit(0)).count() == 0


@pytest.mark.parametrize("meet", [1024, 4])
def test_links_that_no_view_shows_are_found(spark, monkeypatch, meet):
    """Without any candidate of the views the components are still those of all pairs."""
    monkeypatch.setattr(near_copies, "candidates", lambda *_: spark.createDataFrame([], "a long, b long, distance long"))
    monkeypatch.setattr(near_copies.left_between, "__defaults__", (near_copies.SIMILARITY, meet))
    r = random.Random(5)
    rows = []
    for words in (8, 9, 12, 30, 120, 400):
        base = [f"w{r.randrange(3000)}" for _ in range(words)]
        for _ in range(12):
            v = base.copy()
            for _ in range(r.randrange(1 + max(2, words // 25))):
                v[r.choice([0, -1]) if words < 20 else r.randrange(len(v))] = f"n{r.randrange(10**6)}"
            rows.append((len(rows), " ".join(v)))
    want, pairs, _ = brute(rows)
    assert pairs
    got = {x["doc_id"]: x["component"] for x in near_copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert same_groups([got[d] for d, _ in rows], want)


def test_texts_without_a_near_copy_are_not_shuffled(spark, monkeypatch):
    """Of unlike texts only shingles and fingerprints travel, no text: less than half the bytes that the texts have."""
    monkeypatch.setattr(near_copies, "SAMPLE", 1)  # sampled texts are shuffled
    r = random.Random(11)
    rows = [(k, " ".join(f"{r.getrandbits(800):0200x}" for _ in range(500))) for k in range(60)]
    rows += [(200 + k, t) for k, t in rows[:3]]
    store = spark.sparkContext._jsc.sc().statusStore()
    before = store.executorList(True).apply(0).totalShuffleWrite()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    docs = near_copies.durable_table(docs)
    dealt = store.executorList(True).apply(0).totalShuffleWrite()
    assert sorted(x["doc_id"] for x in near_copies.distinct_documents(docs).collect()) == list(range(60))
    assert dealt > before
    assert store.executorList(True).apply(0).totalShuffleWrite() - dealt < sum(len(t) for _, t in rows) / 2


@pytest.mark.parametrize("slots", [1 << 24, 64])
def test_a_filter_loses_no_key(spark, slots):
    keys = spark.createDataFrame([(k, "x") for k in range(500)], "k long, `a.b` string")
    some = spark.createDataFrame([(k * 7,) for k in range(100)], "k long")
    told = common.asked(keys, "k", some, slots)
    assert told.columns == ["k", "a.b", "asked"]
    got = {r["k"]: r["asked"] for r in told.collect()}
    assert len(got) == 500 and all(got[k] for k in range(0, 500, 7))
    assert slots == 64 or sum(got.values()) < 100
    assert not any(r["asked"] for r in common.asked(keys, "k", some.limit(0), slots).collect())


def test_sketches_keep_all_pairs_of_the_similarity():
    r = random.Random(3)
    dropped = 0
    for words in (1, 4, 5, 30, 200, 1000, 4000):
        base = [f"w{r.randrange(10**6)}" for _ in range(words)]
        for share in (0, 0.005, 0.01, 0.02, 0.03, 0.2):
            v = [f"n{r.randrange(10**9)}" if r.random() < share else w for w in base[: r.randrange(words - words // 8, words + 1)]]
            x, y = (" ".join(t).encode() for t in (base, v))
            a, b = (set(simhash.shingle_hashes(t, 5).tolist()) for t in (x, y))
            may = near_copies.may_hold(near_copies.sketch(x), near_copies.sketch(y))
            assert may or len(a & b) < 0.8 * len(a | b)
            dropped += not may
    assert dropped > 5
