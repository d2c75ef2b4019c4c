"""Graph networks: forward passes, losses and gradients against a dense numpy version, and training."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from binloom.operators import gnn
from binloom.sources.store import Scratch

KINDS = [gnn.Net("gcn", 5, 6, 4, 2, dropout=0.0), gnn.Net("sage", 5, 6, 4, 2, dropout=0.0), gnn.Net("gat", 5, 3, 4, 2, heads=2, dropout=0.0), gnn.Net("gat", 5, 3, 4, 1, dropout=0.0), gnn.Net("gcn", 5, 6, 4, 0, dropout=0.0)]


def graph(seed=1, n=20):
    rng = np.random.default_rng(seed)
    a = (rng.random((n, n)) < 0.2) * rng.uniform(0.2, 1.0, (n, n))  # not symmetric: the backward pass must transpose
    a[np.arange(n - 2), np.arange(n - 2)] = 0.7
    a[n - 1] = a[:, n - 1] = 0.0  # a node without edges
    pairs = [(int(i), int(j), float(k % 3 == 0), 0.1 + 0.01 * k) for k, (i, j) in enumerate(rng.integers(0, n, (30, 2))) if i != j]
    return rng.normal(size=(n, 5)), a, pairs


def frames(spark, x, a, pairs):
    nodes = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "node long, x array<double>").repartition(3)
    edges = spark.createDataFrame([(int(i), int(j), float(a[i, j])) for i, j in zip(*np.nonzero(a))], "src long, dst long, value double").repartition(3)
    return nodes, edges, spark.createDataFrame(pairs, "src long, dst long, y double, share double")


def dense(net, s, x, a, stats=None):
    """The embedding, all at once; stats (mean, var) by layer, else of the nodes."""
    for i in range(net.layers):
        w = s[f"{i}.w"]
        if net.kind == "gat":
            h, out = (x @ w).reshape(len(x), net.heads, net.hidden), []
            for k in range(net.heads):
                e = a * ((h[:, k] @ s[f"{i}.l"][k])[:, None] + (h[:, k] @ s[f"{i}.r"][k])[None, :])
                e = np.where(a != 0, np.where(e >= 0, e, 0.2 * e), -np.inf)
                e = np.where(a != 0, np.exp(e - np.where(a.any(axis=1), e.max(axis=1), 0.0)[:, None]), 0.0)
                out.append(e / np.maximum(e.sum(axis=1, keepdims=True), 1e-300) @ h[:, k])
            z = np.hstack(out)
        else:
            z = a @ (x @ w + s.get(f"{i}.b", 0.0))
            if net.kind == "sage":
                z = z + x @ s[f"{i}.v"] + s.get(f"{i}.d", 0.0)
        z = z + s[f"{i}.c"]
        mean, var = (z.mean(axis=0), z.var(axis=0)) if stats is None else stats[i]
        x = np.maximum((z - mean) / np.sqrt(var + 1e-5) * s[f"{i}.scale"] + s[f"{i}.shift"], 0.0)
    return x @ s["out.w"] + s["out.b"]


def loss_of(net, s, x, a, pairs):
    e = dense(net, s, x, a)
    unit = e / np.linalg.norm(e, axis=1, keepdims=True)
    return sum(share * (np.logaddexp(0, c) - y * c) for i, j, y, share in pairs for c in [unit[i] @ unit[j]])


def perturbed(net):
    rng, s = np.random.default_rng(9), gnn.initial_state(net, 3)
    return {k: v if "~" in k else v + rng.normal(scale=0.1, size=v.shape) for k, v in s.items()}


@pytest.mark.parametrize("net", KINDS, ids=lambda n: f"{n.kind}-{n.layers}-{n.heads}")
def test_gradients_equal_differences(spark, net):
    x, a, pairs = graph()
    nodes, edges, rows = frames(spark, x, a, pairs)
    s, scratch = perturbed(net), Scratch(spark)
    start = {k: v.copy() for k, v in s.items()}
    loss, grads = gnn.gradients(net, s, nodes, edges, rows, scratch)
    scratch.clear()
    assert loss == pytest.approx(loss_of(net, start, x, a, pairs), rel=1e-9)
    assert set(grads) == {k for k in start if "~" not in k}
    rng = np.random.default_rng(4)
    for name, g in grads.items():
        assert g.shape == start[name].shape
        for _ in range(6):
            at = tuple(int(rng.integers(d)) for d in g.shape)
            sides = []
            for step in (1e-5, -1e-5):
                moved = {k: v.copy() for k, v in start.items()}
                moved[name][at] += step
                sides.append(loss_of(net, moved, x, a, pairs))
            assert g[at] == pytest.approx((sides[0] - sides[1]) / 2e-5, abs=2e-6)


@pytest.mark.parametrize("net", KINDS[:3], ids=lambda n: n.kind)
def test_embedding_by_running_statistics(spark, net):
    x, a, pairs = graph(2)
    nodes, edges, _ = frames(spark, x, a, pairs)
    s = perturbed(net)
    for i in range(net.layers):
        s[f"{i}.~mean"], s[f"{i}.~var"] = np.full(net.width, 0.1), np.full(net.width, 0.5)
    got = {r["node"]: r["emb"] for r in gnn.embed(net, s, nodes, edges, concat=True).collect()}
    want = np.hstack([x, dense(net, s, x, a, [(s[f"{i}.~mean"], s[f"{i}.~var"]) for i in range(net.layers)])])
    assert np.allclose([got[i] for i in range(len(x))], want)


def groups(spark):
    """Two groups of nodes, linked within, by vectors that do not tell them apart."""
    rng = np.random.default_rng(0)
    n = 24
    links = [(i, j) for i in range(n) for j in range(n) if i != j and i % 2 == j % 2 and rng.random() < 0.4]
    nodes = spark.createDataFrame([(i, rng.normal(size=5).tolist()) for i in range(n)], "node long, x array<double>")
    edges = spark.createDataFrame([(i, j, 0.3) for i, j in links] + [(i, i, 1.0) for i in range(n)], "src long, dst long, value double")
    differ = spark.createDataFrame([(i, i + 1) for i in range(0, n, 2)], "src long, dst long")
    return nodes, edges, spark.createDataFrame(links, "src long, dst long"), differ


def test_training_lowers_the_loss_and_keeps_the_best_epoch(spark):
    nodes, edges, links, differ = groups(spark)
    net = gnn.Net("sage", 5, 8, 4, 1, dropout=0.2)
    seen = []

    def evaluate(epoch, state):
        seen.append((epoch, {k: v.copy() for k, v in state.items()}))
        return -abs(epoch - 3)

    state, history = gnn.train(net, nodes, edges, links, 7, gnn.Losses(step=0.05), differ=differ, evaluate=evaluate, every=3, skip=0)
    assert [e for e, _ in seen] == [0, 3, 6] and history[3]["score"] == 0
    assert all(np.array_equal(state[k], v) for k, v in seen[1][1].items())
    assert np.mean([h["loss"] for h in history[-2:]]) < history[0]["loss"]
    again, _ = gnn.train(net, nodes.repartition(5), edges.repartition(2), links, 4, gnn.Losses(step=0.05), differ=differ)
    assert all(np.allclose(again[k], state[k], atol=1e-9) for k in state)


def test_dropout_keeps_the_mean():
    kept = gnn._kept(np.arange(4000, dtype=np.int64) * 7919, 16, 0.3, 5)
    assert set(np.unique(kept)) == {0.0, 1 / 0.7} and kept.mean() == pytest.approx(1.0, abs=0.02)
    assert not np.array_equal(kept, gnn._kept(np.arange(4000, dtype=np.int64) * 7919, 16, 0.3, 6))


def test_totals_meet_in_a_tree(spark):
    rows = spark.range(0, 1000, 1, 150).select("id", F.array(F.col("id").cast("double")).alias("v"))
    got = gnn.totals(rows, ["id", "v"], lambda ids, v: {"n": np.float64(len(ids)), "s": v.sum(axis=0)})
    assert got["n"] == 1000 and got["s"].tolist() == [499500.0]
