"""Marker scores and links over all line items and parts against plain counts."""

import random
from collections import Counter, defaultdict

import pytest

from binloom.plans import queries as plans

SF = "/root/testdata/sf0.001"


def test_scores_of_all_line_items(spark):
    read = lambda t, *c: [tuple(r) for r in spark.read.parquet(f"{SF}/{t}.parquet").select(*c).collect()]
    nation = dict(read("supplier", "s_suppkey", "s_nationkey"))
    brand = dict(read("part", "p_partkey", "p_brand"))
    size = Counter(brand.values())
    copies = defaultdict(Counter)
    for s, p in read("lineitem", "l_suppkey", "l_partkey"):
        copies[nation[s]][p] += 1
    got = {r["bin"]: (r["comp"], r["cont"]) for r in plans.QUERIES["marker_completeness"](spark, SF).collect()}
    assert set(got) == set(copies)
    for b, c in copies.items():
        want = [100 / len(size) * sum(f(n) / size[brand[p]] for p, n in c.items()) for f in (lambda n: 1, lambda n: n - 1)]
        assert got[b] == pytest.approx(tuple(want), abs=1e-5)


def test_links_of_all_line_items(spark):
    items = spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_suppkey").collect()
    orders, suppliers = defaultdict(set), defaultdict(set)
    for o, p, s in items:
        orders[o].add(p)
        suppliers[p].add(s)
    want = {(a, b): len(suppliers[a] & suppliers[b]) for ps in orders.values() for a in ps for b in ps if a != b and suppliers[a] & suppliers[b]}
    got = {(r["src"], r["dst"]): r["overlap"] for r in plans.QUERIES["same_marker_edges"](spark, SF).collect()}
    assert got == want
    cleaned = {(r["src"], r["dst"]) for r in plans.QUERIES["edges_cleaned"](spark, SF).collect()}
    assert cleaned == {(a, b) for ps in orders.values() for a in ps for b in ps if a != b} - set(want)


def test_lists_of_markers_travel_once_a_member(spark, monkeypatch):
    """The graph's edges with their overlaps take a row a member through an exchange, not a row an edge and marker; nodes of
    many markers, null markers and nodes without any count alike."""
    from binloom.operators import graph

    r = random.Random(4)
    pairs = spark.createDataFrame([(r.randrange(30), r.randrange(40)) for _ in range(150)] + [(99, 1)], "n long, k long")
    marks = [(r.randrange(30), r.randrange(12)) for _ in range(200)] + [(3, None), (None, 4)] + [(5, g) for g in range(20)]
    markers = spark.createDataFrame(marks, "c long, g long")
    of = {}
    for c, g in marks:
        of.setdefault(c, set()).add(g)
    members = {}
    for n, k in map(tuple, pairs.collect()):
        members.setdefault(k, set()).add(n)
    want = {}
    for group in members.values():
        for a in group:
            for b in group:
                if a < b:
                    want[a, b] = want.get((a, b), 0) + 1
    shared = {e: len((of.get(e[0], set()) & of.get(e[1], set())) - {None}) for e in want}
    for most in (1024, 8):
        monkeypatch.setattr(graph, "LIST_MARKERS", most)
        got = graph.marked_member_edges(pairs, "n", "k", markers, "c", "g").collect()
        assert {(x["src"], x["dst"]): (x["weight"], x["overlap"]) for x in got} == {e: (w, shared[e]) for e, w in want.items()}
        assert len(got) == len(want)
        edges = graph.shared_member_edges(pairs, "n", "k")
        both = {(x["src"], x["dst"]): x["overlap"] for x in graph.same_marker_edges(edges, markers, "c", "g").collect()}
        assert both == {d: n for (a, b), n in shared.items() if n for d in ((a, b), (b, a))}
