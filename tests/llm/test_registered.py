"""Registered queries of the subpackage against SQL, and the pipeline against its stages run by hand."""

import pytest

import __spark_entry__ as entry_points

duckdb = pytest.importorskip("duckdb")
queries = pytest.importorskip("segtide.llm.queries")
oracles = pytest.importorskip("segtide.llm.oracles")

TABLES = ("documents", "embeddings", "pages", "labels", "benchmark", "conversations")


def test_one_query_for_each_operator():
    names = sorted(queries.REGISTRY, key=lambda n: int(n[2:].split("_")[0]))
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 14))
    assert queries.REGISTRY.items() <= entry_points.queries().items()
    assert "pipeline" in entry_points.queries()


@pytest.mark.parametrize("name", oracles.ORACLES)
def test_same_as_sql(spark, sf, name):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    cursor = con.execute(oracles.ORACLES[name])
    columns = [d[0] for d in cursor.description]
    df = queries.REGISTRY[name](spark, sf)
    assert sorted(df.columns) == sorted(columns)
    expected = sorted(cursor.fetchall(), key=repr)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    assert got == expected
