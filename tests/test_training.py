"""The autoencoder: gradients against differences, the loss against the aggregate, training in partitions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from binloom.operators import models
from binloom.operators import training as T


@pytest.mark.parametrize("samples, kind", [(3, "nodes"), (1, "nodes"), (0, "nodes"), (3, "links"), (3, "markers")])
def test_gradients_are_those_of_differences(samples, kind):
    shape = T.Shape(samples, 5, hidden=4, latent=3)
    r = np.random.default_rng(0)
    state = {k: v if "~" in k else v + r.normal(scale=0.1, size=v.shape) for k, v in T.initial_state(shape, 1).items()}
    x = np.abs(r.normal(size=(8, samples + 5)))
    y = None if kind == "nodes" else np.array([1.0, 0, 1, 0]) if kind == "links" else np.zeros(4)

    def run(s):
        return T.losses_and_gradients(dict(s), x, shape, np.random.default_rng(5), y, kind != "markers", kind == "markers", 0.7)

    _, grads = run(state)
    assert ("out.w" in grads) == (kind != "markers")
    for name, g in grads.items():
        for at in [tuple(r.integers(0, n) for n in g.shape) for _ in range(3)]:
            ends = []
            for d in (1e-5, -1e-5):
                moved = dict(state) | {name: state[name].copy()}
                moved[name][at] += d
                ends.append(sum(run(moved)[0].values()))
            assert g[at] == pytest.approx((ends[0] - ends[1]) / 2e-5, abs=1e-6), name


def test_batches_double_while_rows_last():
    assert [T.batch_at(e, 100, 500) for e in (0, 24, 25, 75, 400)] == [100, 100, 200, 400, 400]
    assert T.batch_at(0, 0, 7) == 7


def _groups(spark, n=60):
    r = np.random.default_rng(3)
    rows = []
    for i in range(n):
        a = np.array([0.8, 0.2]) if i % 2 else np.array([0.1, 0.9])
        rows.append((i, np.concatenate([a, r.normal(1.0 if i % 2 else -1.0, 0.3, 6)]).tolist()))
    return spark.createDataFrame([*rows, (1000, None)], "id long, v array<double>")


def test_states_are_averaged_alike_in_any_tree(spark, monkeypatch):
    monkeypatch.setattr(T, "PART_ROWS", 10)
    nodes, shape, out = _groups(spark), T.Shape(2, 6, hidden=8, latent=3), []
    for fan_in in (2, 100):
        monkeypatch.setattr(T, "FAN_IN", fan_in)
        out.append(T.train(nodes, "id", "v", shape, epochs=2, batch=8))
    (deep, a), (flat, b) = out
    assert all(np.allclose(deep[k], flat[k]) for k in flat) and a[-1]["loss"] == pytest.approx(b[-1]["loss"])
    assert not np.allclose(deep["mu.w"], T.initial_state(shape)["mu.w"])


def test_training_parts_the_groups_and_repeats(spark):
    nodes, shape = _groups(spark), T.Shape(2, 6, hidden=16, latent=4)
    state, history = T.train(nodes, "id", "v", shape, epochs=4, batch=8, rates=T.Rates(step=1e-2))
    assert all(np.isfinite(h["loss"]) for h in history) and history[-1]["loss"] < history[0]["loss"]
    again, _ = T.train(nodes, "id", "v", shape, epochs=4, batch=8, rates=T.Rates(step=1e-2))
    assert all(np.allclose(state[k], again[k]) for k in state)
    out = {r["id"]: r["emb"] for r in T.encode(nodes, "id", "v", state, shape).collect()}
    assert out.pop(1000) is None and len(out) == 60
    z = np.array([out[i] for i in range(60)])
    odd, even = z[1::2].mean(axis=0), z[::2].mean(axis=0)
    assert all((np.linalg.norm(v - odd) < np.linalg.norm(v - even)) == bool(i % 2) for i, v in enumerate(z))


def test_links_markers_and_the_best_epoch(spark):
    nodes, shape = _groups(spark, 30), T.Shape(2, 6, hidden=8, latent=3)
    ids = spark.range(28)
    links = ids.select(F.col("id").alias("src"), (F.col("id") + 2).alias("dst"), F.lit(1.0).alias("y"))
    drawn = ids.select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), F.lit(0.0).alias("y"))
    scores = {0: 1.0, 2: 5.0, 3: 5.0}
    seen = {}

    def evaluate(number, state):
        seen[number] = state
        return scores[number]

    state, history = T.train(nodes, "id", "v", shape, 4, batch=8, links=links.union(drawn), differ=drawn.select("src", "dst"), evaluate=evaluate, every=2)
    assert sorted(seen) == [0, 2, 3] and state is seen[2]
    assert set(history[0]) == {"abundance", "kmer", "kld", "links", "markers", "loss", "score"}
    with_input = T.encode(nodes.where("id = 4"), "id", "v", state, shape, concat=True).first()["emb"]
    assert len(with_input) == 8 + 3


def test_no_rows_leave_the_first_state(spark):
    shape = T.Shape(2, 6, hidden=4, latent=2)
    state, history = T.train(_groups(spark).limit(0), "id", "v", shape, 1)
    assert all(np.array_equal(v, state[k]) for k, v in T.initial_state(shape).items()) and history == [{"loss": 0}]


def test_losses_are_those_of_the_aggregate(spark):
    """With log variances of 0 and one noise the step's losses are models.autoencoder_loss of what it reconstructs."""
    shape = T.Shape(2, 4, hidden=4, latent=3, layers=0)
    r = np.random.default_rng(1)
    x = np.abs(r.normal(size=(5, 6)))
    s = T.initial_state(shape, 2)
    found, _ = T.losses_and_gradients(s, x, shape, np.random.default_rng(7))
    mu = x @ s["mu.w"] + s["mu.b"]
    o = (mu + np.random.default_rng(7).standard_normal(mu.shape)) @ s["out.w"] + s["out.b"]
    soft = np.exp(o[:, :2]) / np.exp(o[:, :2]).sum(axis=1, keepdims=True)
    hat = np.concatenate([soft, o[:, 2:]], axis=1)
    df = spark.createDataFrame([(a.tolist(), b.tolist(), m.tolist(), [0.0] * 3) for a, b, m in zip(x, hat, mu)], "x array<double>, h array<double>, m array<double>, l array<double>")
    want = models.autoencoder_loss(df, "x", "h", "m", "l", 2).first()
    assert all(found[k] == pytest.approx(want[k]) for k in ("abundance", "kmer", "kld"))
