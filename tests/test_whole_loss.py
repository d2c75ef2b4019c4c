"""The edge loss draws its negative ends over all parts."""

import math

import pytest

from binloom.operators import graph
from binloom.plans import queries as plans

SF = "/root/testdata/sf0.001"


def test_negatives_reach_all_parts(spark):
    t = plans.Tables(spark, SF)
    vector = {r["p_partkey"]: (float(r["p_size"]), r["p_retailprice"] / 50, 10.0) for r in t.part.collect()}
    pos = [(r["src"], r["dst"]) for r in plans._edges(t).collect()]
    neg = [(r["src"], r["dst"]) for r in graph.negative_edges(plans._edges(t), t.part, "p_partkey", 1, 7).collect()]
    assert len(neg) == len(pos) and {d for _, d in neg} == set(vector)
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / math.hypot(*a) / math.hypot(*b)
    p, n = ([cos(vector[a], vector[b]) for a, b in pairs] for pairs in (pos, neg))
    want = (sum(p) / len(p), sum(n) / len(n), (sum(math.log1p(math.exp(c)) - c for c in p) + sum(math.log1p(math.exp(c)) for c in n)) / (len(p) + len(n)))
    assert tuple(plans.QUERIES["edge_loss"](spark, SF).first()) == pytest.approx(want, abs=2e-6)
