"""The density order and its valleys against a queue and nested loops over all pairs."""

import numpy as np
import pytest

from binloom.operators import density_order, similarity


def plain(x, least, radius):
    """place, reachability, core: the cheapest edge (weight, lower, higher) out of what is visited, again and again."""
    u = similarity.unit(x)
    d = np.round(0.5 - 0.5 * u @ u.T, 12)
    np.fill_diagonal(d, 0.0)
    n = len(x)
    core = [sorted(v[v <= radius])[least - 1] if (v <= radius).sum() >= least else None for v in d]
    w = {(i, j): max(d[i, j], core[i], core[j]) for i in range(n) for j in range(i + 1, n) if d[i, j] <= radius and core[i] is not None and core[j] is not None}
    place, reach, left = {}, {}, set(range(n))
    while left:
        start = min(left)
        place[start], reach[start] = len(place), np.inf
        left.discard(start)
        while True:
            out = [(w[e], *e) for e in w if (e[0] in left) != (e[1] in left) and (e[0] in place or e[1] in place)]
            if not out:
                break
            best = min(out)
            new = best[1] if best[1] in left else best[2]
            place[new], reach[new] = len(place), best[0]
            left.discard(new)
    return place, reach, core


def blobs(seed, sizes, scale=0.25, d=4):
    rng = np.random.default_rng(seed)
    return np.concatenate([rng.normal(size=d) * 3 + rng.normal(scale=scale, size=(n, d)) for n in sizes])


@pytest.mark.parametrize("seed, sizes, least, radius", [(1, (40, 25, 20, 1, 1), 4, 0.02), (2, (150, 100, 50), 5, 0.5)])
def test_order_equals_a_queue(spark, seed, sizes, least, radius):
    x = blobs(seed, sizes)
    place, reach, core = plain(x, least, radius)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "k long, v array<double>").repartition(3)
    rows = {r["k"]: r for r in density_order.density_order(df, "k", "v", least, radius).collect()}
    assert {k: r["place"] for k, r in rows.items()} == place
    for k, r in rows.items():
        assert r["reachability"] == pytest.approx(reach[k], abs=1e-9)
        assert (r["core"] is None and core[k] is None) or r["core"] == pytest.approx(core[k], abs=1e-9)
    by_place = sorted(rows.values(), key=lambda r: r["place"])
    for r in by_place:  # a block runs while edges are no dearer than the one that leads in, and ends before one that is no cheaper
        inside, after = by_place[r["place"] + 1 : r["place"] + r["size"]], by_place[r["place"] + r["size"] :][:1]
        assert all(q["reachability"] <= r["reachability"] for q in inside) and all(q["reachability"] >= r["reachability"] for q in after)


def test_valleys_equal_nested_loops(spark):
    x = blobs(4, (30, 30, 20))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "k long, v array<double>").repartition(3)
    order = density_order.density_order(df, "k", "v", 4, 0.5)
    rows = sorted(order.collect(), key=lambda r: r["place"])
    good = []
    for r in rows:
        inside = [q["reachability"] for q in rows[r["place"] + 1 : r["place"] + r["size"]]]
        if r["size"] >= 15 and max(inside, default=0.0) <= 0.7 * r["reachability"]:
            good.append((r["place"], r["place"] + r["size"], r["k"]))
    inner = [g for g in good if not any(g[0] <= h[0] and h[1] <= g[1] and h != g for h in good)]
    want = {r["k"]: next((k for a, b, k in inner if a <= r["place"] < b), -1) for r in rows}
    got = {r["k"]: r["bin"] for r in density_order.valleys(order, "k", 15, 0.3).collect()}
    assert got == want and len(set(want.values()) - {-1}) >= 2
    for c, part in enumerate((range(30), range(30, 60), range(60, 80))):  # groups are apart
        assert len({got[i] for i in part} & {got[i] for i in range(80) if i not in part} - {-1}) == 0


def test_odd_tables(spark):
    none = spark.createDataFrame([], "k long, v array<double>")
    assert density_order.density_order(none, "k", "v").isEmpty()
    one = density_order.density_order(spark.createDataFrame([(5, [1.0, 2.0]), (9, [-1.0, 2.0])], "k long, v array<double>"), "k", "v", 2, 0.01).collect()
    assert sorted((r["k"], r["place"], r["reachability"], r["core"], r["size"]) for r in one) == [(5, 0, np.inf, None, 1), (9, 1, np.inf, None, 1)]
    assert {r["bin"] for r in density_order.valleys(density_order.density_order(spark.createDataFrame([(5, [1.0, 2.0])], "k long, v array<double>"), "k", "v", 2, 0.01), "k", 2).collect()} == {-1}
