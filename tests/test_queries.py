"""Every query with SQL gives the SQL's rows; the others give rows and agree with themselves."""

import oracle
import pytest

from binloom.plans import queries as plans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_query_matches_sql(spark, con, name):
    assert oracle.compare(plans.QUERIES[name](spark, SF), con, plans.ORACLE_SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLE_SQL)))
def test_query_without_sql_is_repeatable(spark, name):
    first, again = (sorted(map(tuple, plans.QUERIES[name](spark, SF).collect())) for _ in range(2))
    assert first and first == again


def test_medoid_bins_are_a_partition_within_the_cut(spark):
    rows = plans.QUERIES["medoid_bins"](spark, SF).collect()
    assert len({r["vec_id"] for r in rows}) == len(rows) == spark.read.parquet(f"{SF}/embeddings.parquet").count()
    assert all(0 < r["cut"] <= 0.3 for r in rows)
    assert len({(r["bin"], r["medoid"]) for r in rows}) == len({r["bin"] for r in rows})


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(plans.QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
