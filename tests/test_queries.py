"""Every registered query against its SQL counterpart, and the shape of its plan."""

import math
import os

import pytest

import __spark_entry__ as entry_points
from segtide.plans import oracles, queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
TABLES = ("lineitem", "orders")
QUERIES = queries.REGISTRY
ORACLES = oracles.ORACLES
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "date": "DATE"}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not available")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return con


def plain(value):
    return None if isinstance(value, float) and math.isnan(value) else value


def test_every_query_is_registered_with_a_counterpart():
    assert QUERIES.keys() == ORACLES.keys()
    assert QUERIES.items() <= entry_points.queries().items()
    assert ORACLES.items() <= entry_points.oracle_sql().items()


@pytest.mark.parametrize("name", QUERIES)
def test_same_result(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cursor = duck.execute(ORACLES[name])
    types = {d[0]: str(d[1]) for d in cursor.description}
    assert {n: TYPES[t] for n, t in df.dtypes} == types
    order = sorted(types)
    spots = [list(types).index(n) for n in order]
    expected = sorted((tuple(plain(r[i]) for i in spots) for r in cursor.fetchall()), key=repr)
    rows = df.collect()
    got = sorted((tuple(plain(r[n]) for n in order) for r in rows), key=repr)
    assert got == expected
    assert got

    plan = df._jdf.queryExecution().toString()
    for unwanted in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "ArrowEvalPython", "SortAggregate"):
        assert unwanted not in plan


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0


def executed(spark, name):
    df = QUERIES[name](spark, SF)
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().rsplit("== Initial Plan ==", 1)[0]


def test_period_filter_reaches_the_scan(spark):
    plan = QUERIES["login_spend_segments"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(l_shipdate,1997-01-01T00:00)" in plan
    assert "l_partkey" not in plan and "l_comment" not in plan


def test_one_shuffle_per_user_and_period(spark):
    plan = executed(spark, "login_spend_segments")
    assert plan.count("Exchange hashpartitioning(user_id") == 1


def line_item_reads(spark, name):
    """Scans of the log: those of the final plan, and one if a part was written before."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = executed(spark, name)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    return plan.count("lineitem.parquet"), "app-usage" in plan or "scores" in plan


@pytest.mark.parametrize("name", ["segment_app_tfidf", "combined_rank", "target_segment_tfidf"])
def test_weights_read_the_log_twice(spark, name):
    assert line_item_reads(spark, name) == (1, True)


def test_sample_and_gaps_read_the_log_once(spark):
    assert line_item_reads(spark, "rfm_training_sample") == (0, True)
    assert line_item_reads(spark, "user_gap_arrays") == (1, False)
    assert "lineitem" not in executed(spark, "user_feature_row")


@pytest.mark.parametrize(("name", "sides"), [("visit_gaps", 1), ("user_gap_arrays", 2), ("user_feature_row", 2)])
def test_days_are_unfolded_once_a_side(spark, name, sides):
    """Each unfolding looks up eight bytes a word."""
    plan = executed(spark, name)
    assert plan.count("shiftrightunsigned") == plan.count(">>>") + 8 * sides if ">>>" not in plan else plan.count(">>>") == 8 * sides


@pytest.mark.parametrize("name", ["user_gap_arrays", "user_active_days", "visit_gaps"])
def test_days_are_not_collected_as_objects(spark, name):
    assert "ObjectHashAggregate" not in executed(spark, name)
