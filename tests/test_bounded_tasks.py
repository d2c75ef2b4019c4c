"""Joins that multiply rows run in tasks by the rows, and give what plain loops give."""

import random
from collections import Counter

import pytest

from binloom.operators import gnn, graph, metrics


@pytest.fixture(scope="module")
def members(spark):
    r = random.Random(9)
    rows = [(r.randrange(40), r.randrange(25)) for _ in range(300)] + [(7, None), (None, 3), (5, 1), (5, 1)]
    return rows, spark.createDataFrame(rows, "n long, k long")


def pairs_of(rows):
    groups = {}
    for n, k in rows:
        if n is not None and k is not None:
            groups.setdefault(k, set()).add(n)
    return {(a, b): sum({a, b} <= g for g in groups.values()) for a in range(40) for b in range(a + 1, 40) if any({a, b} <= g for g in groups.values())}


def test_edges_are_made_once_in_tasks_by_rows(members, monkeypatch):
    rows, df = members
    monkeypatch.setattr(graph, "TASK_ROWS", 16)
    half = graph.shared_member_edges(df, "n", "k", once=True)
    assert half.rdd.getNumPartitions() == -(-len(rows) // 16)
    want = pairs_of(rows)
    assert {(x[0], x[1]): x[2] for x in half.collect()} == want and half.count() == len(want)
    both = graph.shared_member_edges(df, "n", "k").collect()
    assert sorted(map(tuple, both)) == sorted((*d, w) for (a, b), w in want.items() for d in ((a, b), (b, a)))


@pytest.mark.parametrize("size", [1024, 4])
def test_pairs_without_a_row_a_pair_and_group(members, monkeypatch, size):
    rows, df = members
    monkeypatch.setattr(graph, "LIST_MARKERS", size)
    monkeypatch.setattr(metrics, "PAIR_BLOCK", size)
    want = sorted(pairs_of(rows))
    differ, same = graph.must_differ_pairs(df, "n", "k"), metrics.positive_pairs(df.withColumnRenamed("k", "bin"), "n")
    assert sorted(map(tuple, differ.collect())) == want and sorted(map(tuple, same.collect())) == want
    assert differ.schema["i"].dataType.simpleString() == differ.schema["j"].dataType.simpleString() == "bigint"
    plan = same._jdf.queryExecution().optimizedPlan().toString()
    assert not plan.lstrip().startswith(("Aggregate", "Distinct", "Deduplicate"))  # no pair needs removing


def test_adjacency_of_edges_that_are_there_once(members):
    _, df = members
    half, both = graph.shared_member_edges(df, "n", "k", once=True), graph.shared_member_edges(df, "n", "k")
    near = lambda df, c: {(x["src"], x["dst"]): round(x[c], 9) for x in df.collect()}
    assert near(graph.normalised_adjacency(half, once=True), "norm") == near(graph.normalised_adjacency(both), "norm")
    assert near(graph.normalised_adjacency(half, once=True, dealt=True), "norm") == near(graph.normalised_adjacency(both), "norm")
    assert near(graph.weighted_adjacency(half, once=True), "value") == near(graph.weighted_adjacency(both), "value")


def test_small_vectors_are_added_up_as_columns(spark):
    df = spark.createDataFrame([(k % 3, [float(k), 2.0 * k]) for k in range(30)], "k long, v array<double>")
    plain, wide = (sorted(map(tuple, gnn.summed(df, "k", "v", "s", width).collect())) for width in (2, None))
    assert plain == wide
    assert "ObjectHashAggregate" not in gnn.summed(df, "k", "v", "s", 2)._jdf.queryExecution().toString()


def test_segment_edges_are_counted_in_tasks_by_rows(spark, members, monkeypatch):
    rows, df = members
    links = [(k, k + 1) for k in range(24)] + [(5, 4), (6, 6), (2, 9), (None, 3)]
    m = df.withColumnsRenamed({"n": "contig", "k": "segment"})
    edges = spark.createDataFrame(links, "a long, b long")
    want = Counter(map(tuple, graph.contig_segment_edges(m, edges).collect()))
    monkeypatch.setattr(graph, "TASK_ROWS", 16)
    counted = graph.contig_segment_counts(m, edges)
    assert counted.rdd.getNumPartitions() == 3 * -(-len(rows) // 16)
    assert {(x[0], x[1]): x[2] for x in counted.collect()} == want and counted.count() == len(want)
    assert any(a == b for a, b in want)


def test_negatives_of_edges_by_source_and_once(spark, members, monkeypatch):
    _, df = members
    monkeypatch.setattr(graph, "TASK_ROWS", 64)
    by_source = graph.shared_member_edges(df, "n", "k", by_source=True)
    both, half = graph.shared_member_edges(df, "n", "k"), graph.shared_member_edges(df, "n", "k", once=True)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(by_source.select("src", "dst", "weight")) == rows(both)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # a source's edges go over batches
    try:
        near = graph.inverse_weight_negatives(by_source, 2, 7, by_source=True)
        assert near._jdf.queryExecution().optimizedPlan().toString().count("Repartition") == 3  # members twice, edges once
        assert rows(near) == rows(graph.inverse_weight_negatives(both, 2, 7))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert near.count() == 2 * both.count() and near.join(both, ["src", "dst"], "left_anti").isEmpty()
    assert rows(graph.weighted_negatives(half, 2, 7, once=True)) == rows(graph.weighted_negatives(both, 2, 7))
