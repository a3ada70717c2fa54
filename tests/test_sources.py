"""Log readers, list files and result tables."""

from datetime import date

import pytest
from conftest import tuples
from pyspark.sql import functions as F

from segtide.operators.ranking import combined_rank
from segtide.sources import logs, staging, tables
from segtide.sources.ranked_lists import read_ranked_lists

# Ten ranked lists whose combined scores are worked out by hand below.
LISTS = """[1242,2522,58737,98,2676,112,1,57528,58727,58703]
[2522,58737,1242,98,58703,57528,1,112,2676,99]
[58737,2522,57528,58703,98,1,96,95,2676,112]
[58737,58703,57528,98,1,96,57737,95,1494,1236]
[96,58703,98,58737,95,1236,1,57528,1604,2676]
[1242,2522,98,58737,112,58703,58727,1,57528,99]
[2522,58737,1242,58703,98,1,99,112,57528,2676]
[2522,58737,58703,98,96,1,95,112,2676,1242]
[58737,58703,2522,98,1,96,57528,57737,1494,58443]
[58703,96,98,58737,95,1,1236,57528,57737,1604]
"""

SCORES = [
    ("58737", 67 / 12), ("2522", 29 / 6), ("58703", 19 / 5), ("1242", 83 / 30), ("98", 53 / 20), ("96", 457 / 210),
    ("1", 1361 / 840), ("57528", 793 / 504), ("112", 101 / 120), ("95", 111 / 140), ("2676", 11 / 15),
    ("1236", 43 / 105), ("57737", 191 / 504), ("99", 12 / 35), ("58727", 16 / 63), ("1494", 2 / 9),
    ("1604", 19 / 90), ("58443", 1 / 10),
]


def scanned(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def play_path(spark, tmp_path):
    rows = [
        (1, ("JP",), 2, (96,), "20130101"), (1, ("JP",), 2, (96,), "20130331"), (1, ("JP",), 2, (7,), "20130401"),
        (2, ("US",), 2, (96,), "20130201"), (3, ("JP",), 1, (96,), "20130201"), (4, None, 2, (96,), "20130201"),
        (5, ("JP",), 2, None, "20130201"),
    ]
    path = str(tmp_path / "play")
    spark.createDataFrame(rows, logs.PLAY_SCHEMA).write.partitionBy("dt").parquet(path)
    return path


@pytest.fixture
def spend_path(spark, tmp_path):
    rows = [
        (1, -2010, 96, -30, "2013-01-01"), (1, -2010, 96, 30, "2013-01-02"), (1, 5, 96, -30, "2013-01-03"),
        (2, -2010, 7, -5, "2013-03-31"), (2, -2010, 7, -5, "2013-04-01"),
    ]
    path = str(tmp_path / "spend")
    spark.createDataFrame(rows, logs.SPEND_SCHEMA).write.partitionBy("dt").parquet(path)
    return path


def test_play_log(spark, play_path):
    plays = logs.read_play_log(spark, play_path, date(2013, 1, 1), date(2013, 3, 31))
    assert tuples(plays, "user_id", "dt", "app") == [
        (1, date(2013, 1, 1), 96), (1, date(2013, 3, 31), 96), (5, date(2013, 2, 1), None),
    ]
    plan = scanned(plays)
    assert "PartitionFilters: [isnotnull(dt" in plan and "20130331" in plan
    assert "user_info:struct<region:string>" in plan and "details:struct<application_id" in plan


def test_rows_without_a_user_and_extreme_coins(spark, spend_path, play_path):
    plays = logs.read_play_log(spark, play_path).unionByName(spark.createDataFrame([(None, date(2013, 1, 1), 3)], "user_id bigint, dt date, app bigint"))
    both = logs.activity(plays, logs.read_spend_log(spark, spend_path))
    assert both.where("user_id IS NULL").count() == 0 and both.where("played").count() == 4


def test_smallest_coin_does_not_overflow(spark, tmp_path):
    path = str(tmp_path / "least")
    spark.createDataFrame([(1, -2010, 96, -(2**31), "2013-01-01")], logs.SPEND_SCHEMA).write.partitionBy("dt").parquet(path)
    assert logs.read_spend_log(spark, path).first().coin == 2**31


def test_play_log_over_all_days(spark, play_path):
    assert logs.read_play_log(spark, play_path).count() == 4


def test_spend_log(spark, spend_path):
    spends = logs.read_spend_log(spark, spend_path, date(2013, 1, 1), date(2013, 3, 31))
    assert tuples(spends, "user_id", "dt", "app", "coin") == [(1, date(2013, 1, 1), 96, 30), (2, date(2013, 3, 31), 7, 5)]


def test_activity_of_both_logs(spark, play_path, spend_path):
    both = logs.activity(logs.read_play_log(spark, play_path), logs.read_spend_log(spark, spend_path))
    assert both.columns == ["user_id", "dt", "app", "played", "spent", "coin"]
    assert both.where("played").count() == 4 and both.where("spent").count() == 3


def test_monthly_shards(spark):
    schema = "user_id bigint, date string, category int"
    shards = [
        spark.createDataFrame([(1, "2013-07-01", 2), (2, "2013-07-02", 1)], schema),
        spark.createDataFrame([(1, "2013-08-01", 2)], schema),
    ]
    union = logs.union_shards(shards)
    assert tuples(logs.login_rows(union), "user_id", "dt") == [(1, date(2013, 7, 1)), (1, date(2013, 8, 1))]
    assert logs.login_rows(union, None).count() == 3
    spends = spark.createDataFrame(
        [(1, "2013-07-01", "JP", -2010, 10), (1, "2013-07-01", "US", -2010, 10), (1, "2013-07-01", "JP", 3, 10)],
        "user_id bigint, date string, region string, type int, coin_nondeveloper int",
    )
    assert tuples(logs.purchase_rows(spends), "user_id", "dt", "coin") == [(1, date(2013, 7, 1), 10)]


def test_combined_rank_of_list_file(spark, tmp_path):
    path = tmp_path / "lists.txt"
    path.write_text(LISTS)
    ranking = combined_rank(read_ranked_lists(spark, str(path)))
    got = [(r["item"], r.score) for r in ranking.collect()]
    assert [item for item, _ in got] == [item for item, _ in SCORES]
    assert [score for _, score in got] == pytest.approx([score for _, score in SCORES])


def test_list_lines_are_cut_and_not_trimmed(spark, tmp_path):
    path = tmp_path / "lists.txt"
    path.write_text("items\n[1, 2,3] \t\n[2]\n")
    rows = [(0, "1"), (0, "2"), (1, " 2"), (2, "3")]
    assert tuples(read_ranked_lists(spark, str(path), header=True), "pos", "item") == rows
    assert (0, "items") in tuples(read_ranked_lists(spark, str(path)), "pos", "item")


def test_period_table_reload_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "periods")
    both = spark.createDataFrame([(1, "007"), (2, "008")], "user_id bigint, period string")
    tables.write_periods(both, path)
    tables.write_periods(spark.createDataFrame([(3, "008")], both.schema), path)
    tables.write_periods(spark.createDataFrame([(3, "008")], both.schema), path)
    assert tuples(tables.read_periods(spark, path, both.schema), "user_id", "period") == [(1, "007"), (3, "008")]
    one = tables.read_periods(spark, path, both.schema, ["007"])
    assert tuples(one, "user_id", "period") == [(1, "007")]
    assert "PartitionFilters: [period" in scanned(one) or "PartitionFilters: [isnotnull(period" in scanned(one)


def test_staged_tables_go_with_their_block(spark):
    def there(df):
        return spark.sparkContext._jvm.java.io.File(df.inputFiles()[0].removeprefix("file://")).exists()

    with staging.staging(spark):
        outer = staging.written(spark.range(3), "outer")
        with staging.staging(spark):
            inner = staging.written(spark.range(5), "inner")
            kept = staging.written(inner.groupBy().count(), "kept", outlives=True)
            files = inner.inputFiles()
            assert there(inner)
        assert kept.first()[0] == 5 and there(outer) and there(kept)
        assert not spark.sparkContext._jvm.java.io.File(files[0].removeprefix("file://")).exists()
    assert staging.written(spark.range(2), "free").count() == 2


def test_write_table_replaces(spark, tmp_path):
    path = str(tmp_path / "t")
    for n in (3, 2):
        tables.write_table(spark.range(n), path)
    assert spark.read.parquet(path).count() == 2


def test_saved_table(spark, tmp_path):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS sinks LOCATION '{tmp_path}/sinks.db'")
    tables.save_table(spark.range(4).withColumn("period", F.lit("a")), "sinks.result", ["period"])
    tables.save_table(spark.range(5).withColumn("period", F.lit("a")), "sinks.result", ["period"])
    assert spark.table("sinks.result").count() == 5
    spark.sql("DROP DATABASE sinks CASCADE")
