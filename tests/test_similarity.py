"""Pruned similarity joins against all pairs, on clustered data with odd rows."""

import numpy as np
import pytest

from binloom.operators import cluster, similarity


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(12, 6)) * 3
    x = np.concatenate([c + rng.normal(scale=0.15, size=(25, 6)) for c in centres] + [np.tile(centres[0], (20, 1)), np.zeros((3, 6)), [[1, -1, 2, -2, 0, 0]]])
    x[5] *= 40.0
    return x, spark.createDataFrame([(int(i) * 3 - 50, v.tolist()) for i, v in enumerate(x)], "k long, v array<double>").repartition(5)


def keys(n):
    return np.arange(n) * 3 - 50


@pytest.fixture(autouse=True)
def small_blocks(monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK_ROWS", 16)


@pytest.mark.parametrize("pivots", [1, 2, 9, 30])
@pytest.mark.parametrize("most", [0.0005, 0.01, 0.3])
def test_near_pairs_equal_all_pairs(data, pivots, most):
    x, df = data
    u = similarity.unit(x)
    d = 0.5 - 0.5 * u @ u.T
    i, j = np.nonzero(np.triu(d <= most, 1))
    got = sorted((r["i"], r["j"], round(r["distance"], 9)) for r in similarity.near_pairs(df, "k", "v", most, pivots).collect())
    want = sorted((int(keys(len(x))[a]), int(keys(len(x))[b]), round(float(d[a, b]), 9)) for a, b in zip(i, j))
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert np.allclose([g[2] for g in got], [w[2] for w in want], atol=1e-8)


def test_all_pairs_without_a_bound(data):
    x, df = data
    assert similarity.near_pairs(df, "k", "v").count() == len(x) * (len(x) - 1) // 2


@pytest.mark.parametrize("pivots, k", [(1, 3), (8, 1), (8, 5), (40, 4)])
def test_top_products_equal_all_pairs(data, pivots, k):
    x, df = data
    s = np.round(x @ x.T, 6)
    got = sorted((r["i"], r["rank"], r["j"], round(r["score"], 4)) for r in similarity.top_products(df, "k", "v", k, pivots).collect())
    want = [(int(keys(len(x))[a]), r + 1, int(keys(len(x))[b]), round(float(s[a, b]), 4)) for a in range(len(x)) for r, b in enumerate(np.lexsort((np.arange(len(x)), -s[a]))[:k])]
    assert [g[:2] for g in got] == [w[:2] for w in want] and np.allclose([g[3] for g in got], [w[3] for w in want], atol=1e-3)
    assert sum(g[2] != w[2] for g, w in zip(got, want)) <= 2  # sums of another order may round elsewhere


def test_few_candidates_on_clustered_data(data):
    x, df = data
    every = len(x) * (len(x) - 1) // 2
    assert similarity.candidate_pairs(df, "k", "v", 0.0005, 30) < every / 4
    assert similarity.candidate_pairs(df, "k", "v", 0.0005, 1) == every


def test_means_without_pairs(data, spark):
    x, df = data
    u = similarity.unit(x)
    labelled = spark.createDataFrame([(int(k), v.tolist(), "none" if i % 7 == 0 else f"l{i % 5}") for i, (k, v) in enumerate(zip(keys(len(x)), x))], "k long, v array<double>, label string")
    labels = np.array(["none" if i % 7 == 0 else f"l{i % 5}" for i in range(len(x))])
    c, once = u @ u.T, np.triu(np.ones((len(x), len(x)), bool), 1)
    equal = labels[:, None] == labels[None, :]
    got = {r["same"]: (r["pairs"], r["mean"]) for r in cluster.label_cosines(labelled, "k", "v", "label").collect()}
    for same, pick in ((True, once & equal), (False, once & ~equal)):
        assert got[same] == (int(pick.sum()), pytest.approx(c[pick].mean()))


def test_empty(spark):
    none = spark.createDataFrame([], "k long, v array<double>")
    assert similarity.near_pairs(none, "k", "v", 0.1).isEmpty() and similarity.top_products(none, "k", "v", 3).isEmpty()


def test_rows_near_nothing_are_sent_once_a_block(spark):
    """Guests meet members alone: without structure a row goes to half of the cells, and there to few blocks."""
    x = np.random.default_rng(3).normal(size=(512, 24)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "k long, v array<float>").repartition(3)
    rows = similarity._rows(df, "k", "v")
    centres, reach = similarity.pivots_of(rows, 32), float(np.arccos(0.4))
    sent = similarity._tiles(similarity.homes(rows, centres, reach), similarity._counts(rows, centres, reach))
    assert sent.count() < 512 * 16 * 4  # 17 blocks of guests would meet each other
    assert sent.schema["v"].dataType.simpleString() == "array<float>"
    assert {r["i"] * 512 + r["j"] for r in similarity.near_pairs(df, "k", "v", 0.3, 32).collect()} == {i * 512 + j for i in range(512) for j in range(i + 1, 512) if similarity.unit(x[[i, j]])[0] @ similarity.unit(x[[i, j]])[1] >= 0.4}


def test_visitors_leave_in_small_batches(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(similarity, "BATCH_ROWS", 10)
    one = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array([[1.0, 2.0]] * 7)], ["k", "v"])
    got = list(similarity._visitors(one, np.repeat(np.arange(7), 9), np.tile(np.arange(9), 7), []))
    assert max(b.num_rows for b in got) == 10 and sum(b.num_rows for b in got) == 63


def test_rows_are_sent_a_bounded_number_of_times(spark, monkeypatch):
    """Where cells spare nothing, rows meet in WHOLE blocks instead of one for every BLOCK_ROWS others."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "k long, v array<double>")
    rows = lambda: sorted((r[0], r[1], round(r[2], 9)) for r in similarity.near_pairs(df, "k", "v", 0.3).collect())
    want, sent, tiles = rows(), [], similarity._tiles
    monkeypatch.setattr(similarity, "BLOCK_ROWS", 20)
    monkeypatch.setattr(similarity, "_tiles", lambda *a: sent.append(tiles(*a).count()) or tiles(*a))
    assert rows() == want and want
    assert sent[0] <= (similarity.WHOLE + 1) * len(x)


def test_top_products_where_cells_spare_nothing_meet_in_whole_blocks(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 24))
    x[250:260] = x[3]  # copies tie
    monkeypatch.setattr(similarity, "BLOCK_ROWS", 16)
    seen, tiles = [], similarity._tiles
    monkeypatch.setattr(similarity, "_tiles", lambda rows, sizes, block_rows=None: seen.append(block_rows) or tiles(rows, sizes, block_rows))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(similarity.unit(x))], "k long, v array<double>")
    got = sorted((r["i"], r["rank"], r["j"]) for r in similarity.top_products(df, "k", "v", 4).collect())
    score = np.round(similarity.unit(x) @ similarity.unit(x).T, 6)
    assert got == [(i, r + 1, int(j)) for i in range(300) for r, j in enumerate(np.lexsort((np.arange(300), -score[i]))[:4])]
    assert seen == [None, 38]  # a row goes to 8 blocks, not to all 19 cells and back
