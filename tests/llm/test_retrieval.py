"""Ranked search against SQL and plain scores, and the stop of score-at-a-time against reading all."""

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from oracle import compare, connect

from binloom.llm import retrieval

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"word{i % 977}" for i in range(30_000))
TEXTS = [None, "", " .\n", "One", "one two", "same text here", "same text here", "x" * 5000, "é ñ 漢字 🙂 one", LONG, LONG + " tail two", "ONE one oNe 2two two2", "a_b-c`d{e}f", "here", "ÀÉ àé"]
ITEMS = [(1, "one TWO"), (1, "one TWO"), (1, "here"), (2, None), (3, ""), (4, "nowhere"), (5, "word5 word6 tail one one"), (None, "same 漢字"), (6, "a b c d é ÀÉ")]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "x", 1, [2], 3) for i, t in enumerate(TEXTS)]
    rows += [rows[5], rows[9], (3, "one more of that id", None, None, None, None), (None, "one two here", None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, item string, n int, terms array<int>, score long").repartition(3)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(*r, 7) for r in ITEMS], "item_id int, text string, number int")


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def plain(docs, items, k):
    docs = [(i, terms(t)) for i, t in docs]
    docs = [(i, t) for i, t in docs if t]
    n, total, df = len(docs), sum(len(t) for _, t in docs), {}
    for _, t in docs:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    out = []
    for item, text in set(items):
        scored = []
        for i, t in docs:
            m = 10 + 90 * len(t) * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * (10**9 * t.count(x) // (1000 * t.count(x) + 8 * m)) for x in set(terms(text)) if x in t)
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, rank + 1, s[3], -s[0]) for rank, s in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def rows(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


@pytest.mark.parametrize("settings", [{}, {"k": 3, "chunk": 16}, {"k": 2, "shard_postings": 3, "block_bytes": 8}, {"k": 1, "chunk": 1, "shard_postings": 1}])
def test_odd_rows_equal_plain_scores(odd, items, settings):
    docs = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    assert rows(retrieval.search(odd, items, **settings)) == plain(docs, ITEMS, settings.get("k", 10))


def test_empty_tables(odd, items):
    assert rows(retrieval.search(odd.limit(0), items)) == []
    assert rows(retrieval.search(odd, items.limit(0))) == []


def test_query_equals_sql(spark):
    assert compare(retrieval.op13_impact_ordered_search(spark, SF), connect(SF), retrieval.OP13_SQL) == ""


def test_pieces_and_terms_of_bytes():
    r = random.Random(3)
    for _ in range(100):
        texts = ["".join(r.choice("aAbZ09 ._é漢\n") for _ in range(r.randint(0, 40))) for _ in range(5)]
        want = [terms(t) for t in texts]
        vocabulary = sorted({t for w in want for t in w})[::2]
        for limit in (1, 3, 10, 1000):
            for a, b, total, row, term, times in retrieval.count_terms(pa.array([t.encode() for t in texts], pa.binary()), pa.array([t.encode() for t in vocabulary], pa.large_binary()), limit):
                assert total.tolist() == [len(w) for w in want[a:b]]
                got = {(a + i, vocabulary[t]): n for i, t, n in zip(row.tolist(), term.tolist(), times.tolist())}
                assert got == {(i, t): want[i].count(t) for i in range(a, b) for t in set(want[i]) & set(vocabulary)}


def test_the_stop_proves_what_reading_all_gives(monkeypatch):
    """Random shards: the k of the early stop are those of full sums, and some postings are left unread."""
    monkeypatch.setattr(retrieval, "FIRST_STEP", 8)
    rng = np.random.default_rng(5)
    read = held = 0
    for trial in range(300):
        n, v = int(rng.integers(1, 300)), int(rng.integers(1, 12))
        row, term = np.nonzero(rng.random((n, v)) < rng.random(v) ** 2)
        impact = np.ceil(rng.pareto(1.0, len(row)) * 100).astype(np.int64) if trial % 3 else rng.integers(1, 4, len(row))
        shard = retrieval.Shard(np.arange(n), row, term, impact, v)
        for k in (1, 2, 10):
            pick = rng.permutation(v)[: rng.integers(1, v + 1)]
            sums = np.zeros(n, np.int64)
            chosen = np.isin(term, pick)
            np.add.at(sums, row[chosen], impact[chosen])
            want = sorted((-s, i) for i, s in enumerate(sums.tolist()) if s)[:k]
            got = shard.best(pick, k)
            assert list(zip((-got[1]).tolist(), got[0].tolist())) == want
        read, held = read + shard.read, held + shard.held
    assert 0 < read < 0.8 * held
