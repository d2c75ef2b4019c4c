"""Medoid turns that compare a seed with the rows near it give what comparing all rows at every try gives."""

from collections import deque

import numpy as np
import pytest

from binloom.operators import cluster, similarity


def plain(x, seed=0, radius=0.05, default=0.06, tries=25, window=200, least=20):
    """The turns by the distances of all rows, and how many distances were made."""
    rng = np.random.default_rng(seed)
    alive, waiting, out, made = np.ones(len(x), bool), deque(rng.permutation(len(x)).tolist()), [], 0
    pdf, ratio, recent = cluster._smoothing(), 0.1, deque(maxlen=window)

    def distances(m):
        nonlocal made
        made += len(x)
        d = 0.5 - np.einsum("nd,d->n", x, x[m])
        d[m] = 0.0
        return d

    while waiting:
        start = waiting.popleft()
        if not alive[start]:
            continue
        medoid, d, futile, seen = start, distances(start), 0, {start}
        while futile < tries:
            inside = np.flatnonzero(alive & (d <= radius))
            fresh = [i for i in inside.tolist() if i not in seen]
            if not fresh:
                break
            other = fresh[int(rng.integers(len(fresh)))]
            seen.add(other)
            e = distances(other)
            if e[alive & (e <= radius)].mean() < d[inside].mean():
                medoid, d, futile = other, e, 0
            else:
                futile += 1
        cut = cluster._valley(d[alive], ratio, pdf)
        if cut is None and ratio > 0.55:
            cut = default
        recent.append(cut is not None)
        if cut is None:
            waiting.append(start)
        else:
            members = np.flatnonzero(alive & (d <= cut))
            alive[members] = False
            out.append((members.tolist(), medoid, cut))
            if alive[start]:
                waiting.append(start)
        if len(recent) == window and sum(recent) < least:
            ratio += 0.1
            recent.clear()
    return out, made


def mixed(seed, d):
    r = np.random.default_rng(seed)
    groups = [r.normal(size=d) * 2 + r.normal(scale=s, size=(n, d)) for n, s in zip(r.integers(1, 160, 10), r.choice([0.05, 0.2, 0.6, 1.0], 10))]
    x = np.concatenate([*groups, r.normal(size=(150, d)), np.repeat(r.normal(size=(1, d)), 30, axis=0)])
    return x[r.permutation(len(x))]


@pytest.mark.parametrize("seed, d", [(0, 3), (1, 8), (2, 32), (3, 64), (4, 3), (5, 8)])
def test_turns_equal_a_plain_version(seed, d):
    x = similarity.unit(mixed(seed, d)) / np.sqrt(2)
    near = 2 * x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    want, made = plain(x, seed)
    for lone in (None, ~near.any(axis=1)):
        left = cluster._Left(x, np.ones(len(x), bool))
        got = [(members.tolist(), medoid, cut) for members, medoid, cut in cluster.medoid_turns(x, lone, seed=seed, left=left)]
        assert got == want
    if d >= 32:
        assert left.compared < made / 4


def test_bins_equal_the_plain_turns(spark):
    x = mixed(6, 16)
    keys = np.random.default_rng(1).permutation(10 * len(x))[: len(x)]
    df = spark.createDataFrame([(int(k), v.tolist()) for k, v in zip(keys, x)], "k long, v array<double>").repartition(5)
    order = np.argsort(keys)
    want, _ = plain(similarity.unit(x[order]) / np.sqrt(2))
    rows = cluster.medoid_bins(df, "k", "v").collect()
    assert [(r["k"], r["bin"], r["medoid"], r["cut"]) for r in rows] == [(keys[order][i], c, keys[order][m], cut) for c, (members, m, cut) in enumerate(want) for i in members]
    assert cluster.medoid_bins(df.limit(0), "k", "v").isEmpty()


@pytest.mark.parametrize("pivots", [1, 4, 12])
def test_rows_that_have_another_near(spark, monkeypatch, pivots):
    monkeypatch.setattr(similarity, "BLOCK_ROWS", 64)
    monkeypatch.setattr(similarity, "STRIPE_ROWS", 16)
    x = mixed(7, 8)
    u = similarity.unit(x)
    near = u @ u.T
    np.fill_diagonal(near, -1.0)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "k long, v array<double>").repartition(3)
    got = [r["k"] for r in similarity.near_rows(df, "k", "v", 0.05, pivots).collect()]
    assert len(got) == len(set(got)) and set(np.flatnonzero(near.max(axis=1) >= 0.9)) <= set(got) <= set(np.flatnonzero(near.max(axis=1) >= 0.9 - 2e-4))


def test_normalised_rows(spark):
    from binloom import functions as G

    x = [[3.0, 4.0], [1.0, -1.0], [-2.0, 0.5]]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x)], "k long, v array<float>")
    got = np.array([r["u"] for r in df.select("k", G.medoid_normalise(df["v"]).alias("u")).orderBy("k").collect()])
    assert np.allclose(got, similarity.unit(np.array(x)) / np.sqrt(2), atol=1e-15)
