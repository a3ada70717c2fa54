"""Registered queries over stored results: each writes the tables that the reports are kept in, loads parts of them anew, and reports from what is stored.

Writing starts jobs while a query is built. The tables lie in the session's
shared folder, until ``staging.drop_staged`` or whoever owns the folder removes them.
"""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from segtide.operators import activity, affinity, features, ranking, scoring, state
from segtide.periods import Period
from segtide.plans.queries import MONTHS, P1, P2, P3, PERIODS, TAGS, _labels_and_details, _rows, _tfidf_inputs, _weights, query
from segtide.sources import logs, ranked_lists, tables
from segtide.sources.order_logs import read_activity
from segtide.sources.staging import place, written

#: Days that the logs are written for, and the two periods that are read back.
LOGGED = Period("logged", date(1997, 12, 25), date(1998, 7, 7))
LOG_PERIODS = (Period("1998Q1", date(1998, 1, 1), date(1998, 3, 31)), Period("1998Q2", date(1998, 4, 1), date(1998, 6, 30)))
#: A month that is loaded late, and the days that its first load had.
LATE = Period("late", date(1998, 3, 1), date(1998, 3, 31))
EARLY_DAYS = 15
BUCKETS = 8

PERIOD_ACTIVITY = "user_id bigint, play_days bigint, last_play date, spend_days bigint, spend_coin bigint, last_spend date, period string"
WEIGHTS = "seg string, app bigint, stf double, df bigint, tfidf double, info string, pp string"


def _logs(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """Both logs in their own layout: an app is in the region or not, a category is a device, and unspent rows are movements the other way."""
    rows = read_activity(spark, sf_dir, [LOGGED])
    plays = rows.select("user_id", "dt", "app", F.when(F.col("app") % 4 == 0, "US").otherwise(logs.REGION).alias("region"), F.when(F.col("category") == "F", 1).otherwise(logs.DEVICE).alias("device_id"))
    kind = F.when(F.col("app") % 5 == 0, 0).otherwise(logs.SPEND_TYPES[0])
    spends = rows.select("user_id", "dt", "app", kind.alias("type"), F.when(F.col("spent"), -F.col("coin")).otherwise(F.col("coin")).alias("movement"))
    paths = place(spark, "play-log"), place(spark, "coin-log")
    logs.write_play_log(plays, paths[0])
    logs.write_spend_log(spends, paths[1])
    return paths


@query
def stored_log_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Period activity from both logs as they are stored: day partitions in two formats, nested fields, negative movements."""
    first, last = LOG_PERIODS[0].start, LOG_PERIODS[-1].end
    play, coin = _logs(spark, sf_dir)
    log = logs.activity(logs.read_play_log(spark, play, first, last), logs.read_spend_log(spark, coin, first, last))
    return activity.period_activity(activity.user_periods(log, LOG_PERIODS))


def _period_store(spark: SparkSession, sf_dir: str) -> str:
    """Periods loaded one by one; the second comes twice, first without its last months."""
    path = place(spark, "period-store")
    for period in PERIODS:
        tables.write_periods(activity.period_activity(_rows(spark, sf_dir, (period,))), path)
        if period is P2:
            early = Period(P2.name, P2.start, date(P2.start.year, 8, 31))
            tables.write_periods(activity.period_activity(_rows(spark, sf_dir, (early,))), path)
            tables.write_periods(activity.period_activity(_rows(spark, sf_dir, (P2,))), path)
    return path


@query
def stored_period_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two chosen periods of the store."""
    return tables.read_periods(spark, _period_store(spark, sf_dir), PERIOD_ACTIVITY, [P2.name, P3.name])


@query
def stored_period_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without a play day in what was stored, which a bad load would show."""
    return activity.zero_activity(tables.read_periods(spark, _period_store(spark, sf_dir), PERIOD_ACTIVITY))


def _state(spark: SparkSession, sf_dir: str, months) -> DataFrame:
    """The months' state: all of it loaded but for the end of one month, which comes late with the whole month."""
    path = place(spark, "monthly-state")
    rows = read_activity(spark, sf_dir, months)
    there = ~F.expr(LATE.holds("dt")) | (F.dayofmonth("dt") <= EARLY_DAYS)
    tables.write_parts(state.monthly_state(rows.where(there)), path, ["month", "part"])
    tables.write_parts(state.monthly_state(read_activity(spark, sf_dir, [LATE])), path, ["month", "part"])
    return spark.read.schema(state.MONTH_SCHEMA).parquet(path)


@query
def state_rfm_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-period labels from the months' state."""
    return scoring.user_rfm_labels(state.user_periods_of(_state(spark, sf_dir, PERIODS), PERIODS), PERIODS)


@query
def state_spend_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six-period table of spenders from the months' state."""
    rows = state.user_periods_of(_state(spark, sf_dir, MONTHS), MONTHS)
    return scoring.monthly_spend_wide(rows, [m.name for m in MONTHS])


def _pair_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First pairs of app and user, load after load; each reads its own days of the log and the pairs before."""
    path = place(spark, "first-pairs")
    bounds = [date(1900, 1, 1), *[p.start for p in PERIODS], date(P3.end.year + 1, 1, 1), date(2200, 1, 1)]
    for k, (first, upto) in enumerate(zip(bounds, bounds[1:])):
        days = Period(f"load{k}", first, date.fromordinal(upto.toordinal() - 1))
        known = spark.read.schema(state.PAIR_SCHEMA).parquet(path).where(F.col("load") < days.name) if k else None
        tables.write_parts(state.first_pairs(read_activity(spark, sf_dir, [days]), known, days.name), path, ["load"])
    return spark.read.schema(state.PAIR_SCHEMA).parquet(path)


@query
def stored_document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document frequency of every app, and the number of users, from the stored pairs."""
    pairs = _pair_store(spark, sf_dir)
    return state.frequency_of_pairs(pairs).withColumn("n_users", state.users_of_pairs(pairs))


@query
def bucketed_feature_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature row from two tables in buckets of users, joined without a shuffle."""
    mark = uuid.uuid4().hex
    labels, details = (
        tables.save_bucketed(df, f"{name}_{mark}", ["user_id"], BUCKETS, place(spark, name))
        for df, name in zip(_labels_and_details(spark, sf_dir), ("user_labels", "user_details"), strict=True)
    )
    found = features.user_feature_row(labels, details)
    return found.withColumns({c: F.array_join(F.col(c).cast("array<string>"), ",") for c in ("play_gaps", "spend_gaps")})


@query
def stored_segment_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights by period and source, loaded one after the other into their own partitions, one of them twice."""
    path = place(spark, "segment-weights")
    weights = written(affinity.segment_app_tfidf(*_tfidf_inputs(spark, sf_dir, (P1, P2)), tags=TAGS), "weights")
    loads = [(pp, info) for info in (affinity.SPEND, affinity.PLAY) for pp in TAGS.values()]
    for pp, info in [*loads, loads[1]]:
        tables.write_parts(weights.where((F.col("pp") == pp) & (F.col("info") == info)), path, ["pp", "info"])
    found = spark.read.schema(WEIGHTS).parquet(path)
    return found.withColumns({c: F.round(c, 6) for c in ("stf", "tfidf")}).select("seg", "app", "stf", "df", "tfidf", "info", "pp")


@query
def ranking_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The combined ranking as text: lists go through list files, the ranking into ordered lines, which are read back."""
    lists, report = place(spark, "list-files"), place(spark, "ranking")
    tops = affinity.segment_top_lists(affinity.segment_top_apps(_weights(spark, sf_dir, (P1,)).where(F.col("info") == affinity.PLAY)))
    ranked_lists.write_ranked_lists(tops, lists, "top10")
    ranked = ranking.numbered_rank(ranked_lists.read_ranked_lists(spark, lists).select("pos", F.col("item").cast("bigint").alias("item")))
    line = F.concat_ws(",", "place", "item", F.round("score", 6))
    ranked_lists.write_lines_in_order(ranked, report, line, [F.col("place")])
    return spark.read.schema("place bigint, item bigint, score double").csv(report)


def _observed(spark: SparkSession, df: DataFrame, name: str, checks: dict[str, Column]) -> dict[str, int]:
    return tables.write_observed(df, place(spark, name), checks)


@query
def observed_engagement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sanity counts of the two-period table, taken while it is written; a row is a user, so rows count users."""
    wide = activity.engagement_wide(_rows(spark, sf_dir, (P1, P2)), P1.name, P2.name)
    seen = _observed(spark, wide, "engagement", {"n_rows": F.count("*"), "n_users": F.count("user_id"), "churn": F.count_if(F.col("loginday2") == 0), "spend_flag": F.count_if(F.col("spendcoin") > 0)})
    return spark.createDataFrame([tuple(seen.values())], ", ".join(f"{c} bigint" for c in seen))


@query
def observed_period_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without a play day and users of each period, taken while the periods are written."""
    checks = {}
    for p in PERIODS:
        own = F.col("period") == p.name
        checks |= {f"zero {p.name}": F.count_if(own & (F.col("play_days") == 0)), f"users {p.name}": F.count_if(own)}
    seen = _observed(spark, activity.period_activity(_rows(spark, sf_dir)), "period-activity", checks)
    return spark.createDataFrame([(p.name, seen[f"zero {p.name}"], seen[f"users {p.name}"]) for p in PERIODS], "period string, n_zero bigint, uu bigint")
