"""Pairs over all of lineitem against plain sets."""

from collections import defaultdict
from itertools import combinations

from binloom.plans import queries as plans

SF = "/root/testdata/sf0.001"


def test_pairs_of_all_line_items(spark):
    carriers = defaultdict(set)
    for r in spark.read.parquet(f"{SF}/lineitem.parquet").select("l_suppkey", "l_partkey").collect():
        carriers[r[1]].add(r[0])
    want = {p for s in carriers.values() for p in combinations(sorted(s), 2)}
    got = [tuple(r) for r in plans.QUERIES["must_differ_pairs"](spark, SF).collect()]
    assert len(got) == len(want) and set(got) == want
