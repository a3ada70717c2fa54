"""Stored results: what is written is what is read, whatever the order and number of loads, and only what is asked for is read."""

import glob
import os
import random
from datetime import date, timedelta

import pytest
from conftest import tuples
from pyspark.sql import functions as F

from segtide.operators import activity, affinity, ranking, scoring, state
from segtide.operators.skew import number_rows
from segtide.periods import Period
from segtide.plans import queries, stored
from segtide.sources import logs, ranked_lists, staging, tables

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
JAN, FEB, MAR = (Period(n, date(2013, m, 1), date(2013, m + 1, 1) - timedelta(days=1)) for m, n in ((1, "jan"), (2, "feb"), (3, "mar")))
SPRING = Period("spring", date(2013, 2, 1), date(2013, 4, 30))
USER_PERIODS = ["user_id", "period", "play_days", "last_play", "spend_days", "spend_coin", "spend_time", "last_spend"]


def random_log(seed, n=300, days=120):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        kind = rng.choice(["play", "play", "spend"])
        day = date(2013, 1, 1) + timedelta(days=rng.randrange(days))
        rows.append((rng.randrange(9), day.isoformat(), rng.choice([None, *range(6)]), kind, rng.randrange(1, 99) if kind == "spend" else None))
    return rows + [(50, "2013-01-31", 1, "play", None), (50, "2013-02-28", 1, "spend", 3), (51, "2013-03-01", 1, "spend", 3)]


def executed(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().rsplit("== Initial Plan ==", 1)[0]


def break_files(pattern):
    """Make files unreadable, to show that they aren't opened."""
    found = glob.glob(pattern)
    assert found
    for name in found:
        with open(name, "wb") as f:
            f.write(b"broken")


def test_logs_come_back_as_written(spark, tmp_path):
    plays = [(1, date(2013, 1, 5), "JP", 2, 7), (1, date(2013, 1, 5), "JP", 2, 7), (2, date(2013, 1, 6), "US", 2, 7), (3, date(2013, 1, 6), "JP", 1, 7), (4, date(2013, 2, 1), None, 2, None), (None, date(2013, 1, 7), "JP", 2, None)]
    spends = [(1, date(2013, 1, 5), -2010, 7, -30), (1, date(2013, 1, 5), -2010, 7, 30), (1, date(2013, 1, 6), 5, 7, -30), (2, date(2013, 2, 1), -2010, None, -(2**31))]
    play, coin = str(tmp_path / "play"), str(tmp_path / "coin")
    logs.write_play_log(spark.createDataFrame(plays, "user_id int, dt date, region string, device_id int, app int"), play)
    logs.write_spend_log(spark.createDataFrame(spends, "user_id int, dt date, type int, app int, movement int"), coin)
    assert {os.path.basename(p) for p in glob.glob(f"{play}/dt=*")} == {"dt=20130105", "dt=20130106", "dt=20130107", "dt=20130201"}
    assert {os.path.basename(p) for p in glob.glob(f"{coin}/dt=*")} == {"dt=2013-01-05", "dt=2013-01-06", "dt=2013-02-01"}
    got = logs.read_play_log(spark, play, date(2013, 1, 1), date(2013, 1, 31))
    assert tuples(got, "user_id", "dt", "app") == sorted([(1, date(2013, 1, 5), 7)] * 2 + [(None, date(2013, 1, 7), None)], key=repr)
    assert tuples(logs.read_spend_log(spark, coin), "user_id", "dt", "app", "coin") == [(1, date(2013, 1, 5), 7, 30), (2, date(2013, 2, 1), None, 2**31)]
    plan = executed(got)
    assert "PartitionFilters: [isnotnull(dt" in plan and "(dt#" in plan
    assert "user_info:struct<region:string>" in plan
    break_files(f"{play}/dt=20130201/*.parquet")
    assert got.count() == 3
    # A day loaded again replaces that day only.
    logs.write_play_log(spark.createDataFrame(plays[:1], "user_id int, dt date, region string, device_id int, app int"), play)
    assert logs.read_play_log(spark, play, None, date(2013, 1, 31)).count() == 2


@pytest.mark.parametrize("seed", [1, 2])
def test_months_add_up_to_periods(spark, log, seed, tmp_path):
    """Any union of months, months in several loads that share days, and a late reload."""
    rows = random_log(seed)
    table, path = log(rows), str(tmp_path / "state")
    read = lambda: spark.read.schema(state.MONTH_SCHEMA).parquet(path)
    half = (F.dayofmonth("dt") <= 15) | (F.month("dt") != 2)
    tables.write_parts(state.monthly_state(table.where(half)), path, ["month", "part"])
    late = table.where(~half)
    tables.write_parts(state.monthly_state(late, "late"), path, ["month", "part"])
    for periods in ([JAN, SPRING], [FEB], [Period("all", date(2013, 1, 1), date(2013, 4, 30))], [MAR, JAN]):
        assert tuples(state.user_periods_of(read(), periods), *USER_PERIODS) == tuples(activity.user_periods(table, periods), *USER_PERIODS)

    # One load more of rows on days that are there already: days count once, coin adds up.
    again = table.where("spent AND month(dt) = 3")
    tables.write_parts(state.monthly_state(again, "again"), path, ["month", "part"])
    expected = activity.user_periods(table.unionByName(again), [SPRING])
    assert tuples(state.user_periods_of(read(), [SPRING]), *USER_PERIODS) == tuples(expected, *USER_PERIODS)
    break_files(f"{path}/month=2013-01-01/*/*.parquet")
    assert state.user_periods_of(read(), [SPRING]).count() == expected.count()

    three = [JAN, FEB, MAR]
    labels = scoring.user_rfm_labels(state.user_periods_of(state.monthly_state(table), three), three)
    assert tuples(labels, *labels.columns) == tuples(scoring.user_rfm_labels(activity.user_periods(table, three), three), *labels.columns)
    with pytest.raises(ValueError, match="whole months"):
        state.user_periods_of(read(), [Period("x", date(2013, 1, 2), date(2013, 1, 31))])


def test_state_has_a_row_for_each_user_and_month(spark, log):
    """One shuffle of the log, and one of the much smaller state."""
    table = log(random_log(3, n=3000))
    months = state.monthly_state(table)
    assert months.count() == months.select("user_id", "month").distinct().count() <= 9 * 4 + 3
    assert executed(months).count("Exchange hashpartitioning") == 1
    assert "ObjectHashAggregate" not in executed(state.user_periods_of(months, [SPRING]))


def test_first_pairs_grow_with_the_log(spark, log, tmp_path):
    rows, path = random_log(4), str(tmp_path / "pairs")
    table, known = log([*rows, (None, "2013-01-09", 3, "play", None)]), None
    for p in (JAN, FEB, MAR, Period("rest", date(2013, 4, 1), date(2013, 12, 31))):
        new = state.first_pairs(table.where(p.holds("dt")), known, p.name)
        for _ in range(2):  # a load may be repeated
            tables.write_parts(new, path, ["load"])
        known = spark.read.schema(state.PAIR_SCHEMA).parquet(path)
        known = known.where(F.col("load").isin(*[x for x in ("jan", "feb", "mar", "rest")][: ("jan", "feb", "mar", "rest").index(p.name) + 1]))
    pairs = spark.read.schema(state.PAIR_SCHEMA).parquet(path)
    usage = affinity.app_usage(log(rows))
    assert pairs.count() == pairs.select("app", "user_id").distinct().count()
    assert tuples(state.frequency_of_pairs(pairs), "app", "df") == tuples(affinity.document_frequency(affinity.app_users(usage)), "app", "df")
    one = spark.range(1)
    assert one.select(state.users_of_pairs(pairs)).first()[0] == one.select(affinity.corpus_size(usage)).first()[0]


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not available")
def test_only_new_days_are_read(spark):
    """Each load's pairs come from its own days; the scan has them as row-group filters."""
    days = Period("one", date(1998, 1, 1), date(1998, 1, 31))
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    try:
        plan = executed(state.first_pairs(queries.read_activity(spark, SF, [days]), None, "one"))
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "GreaterThanOrEqual(l_shipdate,1998-01-01T00:00)" in plan and "LessThan(l_shipdate,1998-02-01T00:00)" in plan


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not available")
def test_bucketed_join_has_no_shuffle(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = executed(stored.bucketed_feature_row(spark, SF))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and "Exchange" not in plan


def test_partitions_of_several_levels(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "v int, pp string, info string"
    load = lambda *rows: tables.write_parts(spark.createDataFrame(rows, schema), path, ["pp", "info"])
    load((1, "p2", "b"), (2, "p2", "b"))
    load((3, "p1", "a"))
    load((4, "p2", "a"))
    load((9, "p2", "b"))
    load((3, "p1", "a"))
    assert tuples(spark.read.schema(schema).parquet(path), "v", "pp", "info") == [(3, "p1", "a"), (4, "p2", "a"), (9, "p2", "b")]


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not available")
def test_other_periods_are_not_opened(spark):
    path = stored._period_store(spark, SF)
    chosen = tables.read_periods(spark, path, stored.PERIOD_ACTIVITY, ["1998"])
    n = chosen.count()
    break_files(f"{path.removeprefix('file://').removeprefix('file:')}/period=1997/*.parquet")
    assert chosen.count() == n > 0


def test_lines_in_order_of_file_names(spark, tmp_path):
    path = str(tmp_path / "lines")
    rows = [(k * 7919 % 1000, f"i{k % 13}") for k in range(1000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, "n int, item string").repartition(5)
        ranked_lists.write_lines_in_order(df, path, F.concat_ws(",", "n", "item"), [F.desc("item"), F.asc("n")])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = sorted(glob.glob(f"{path}/part-*"))
    lines = [line for name in files for line in open(name).read().splitlines()]
    assert len(files) > 1
    assert lines == [f"{n},{i}" for i in sorted({i for _, i in rows}, reverse=True) for n in sorted(n for n, x in rows if x == i)]


@pytest.mark.parametrize("n", [0, 1, 2000])
def test_numbers_of_rows(spark, n):
    rows = [(k * 7919 % 10007, k % 3) for k in range(n)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = number_rows(spark.createDataFrame(rows, "v int, g int").repartition(7), [F.desc("g"), F.asc("v")])
        got = {(r.v, r.g): r.place for r in found.collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == {r: k for k, r in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])), 1)}


def test_list_files_and_ranking(spark, tmp_path):
    path = str(tmp_path / "lists")
    lists = [["5", "3", "9"], ["3", "5"], [], ["9"]]
    ranked_lists.write_ranked_lists(spark.createDataFrame([(x,) for x in lists], "l array<string>"), path, "l")
    got = ranking.numbered_rank(ranked_lists.read_ranked_lists(spark, path).where("item <> ''"))
    assert [tuple(r) for r in got.orderBy("place").collect()] == [(1, "3", 1.5), (2, "5", 1.5), (3, "9", 1 + 1 / 3)]


def test_checks_are_taken_while_writing(spark, log, tmp_path):
    path = str(tmp_path / "out")
    rows = activity.period_activity(activity.user_periods(log(random_log(5)), [JAN, FEB]))
    seen = tables.write_observed(rows, path, {"n": F.count("*"), "zero": F.count_if(F.col("play_days") == 0), "coin": F.sum("spend_coin")})
    back = spark.read.parquet(path)
    assert seen == {"n": back.count(), "zero": 0, "coin": back.agg(F.sum("spend_coin")).first()[0]}


def test_blocks_of_two_threads_are_apart(spark):
    """A block drops what its own thread wrote, and nothing else."""
    from threading import Thread

    there = lambda df: spark.sparkContext._jvm.java.io.File(df.inputFiles()[0].removeprefix("file://")).exists()
    with staging.staging(spark):
        kept = staging.written(spark.range(3), "kept")

        def other():
            with staging.staging(spark):
                staging.written(spark.range(4), "other").count()

        thread = Thread(target=other)
        thread.start()
        thread.join()
        assert there(kept)
    loose = staging.written(spark.range(2), "loose")
    files = loose.inputFiles()
    assert there(loose)
    staging.drop_staged(spark)
    assert not spark.sparkContext._jvm.java.io.File(files[0].removeprefix("file://")).exists()


@pytest.mark.parametrize("master", ["yarn", "spark://h:7077", "local-cluster[3,2,3000]"])
def test_no_local_folder_on_a_cluster(master):
    """Executors would each write to a disk of their own."""
    from types import SimpleNamespace

    session = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        staging.shared_dir(session)
