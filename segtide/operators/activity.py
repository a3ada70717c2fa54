"""One row per user and period, and the reports read straight from it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segtide.functions import days
from segtide.periods import Period, check_disjoint, in_any, period_index, period_name, period_start, quoted

# Fixed value: the id shared by users who are not logged in. Their play rows
# count, but spend rows are never credited to it.
SHARED_USER = 0


def user_periods(activity: DataFrame, periods: Sequence[Period]) -> DataFrame:
    """Play and spend totals per user and period, in one shuffle.

    Every aggregate merges on the map side, so a user with a third of all log
    rows costs one row per map task and period. ``spend_coin`` is NULL without a
    spend row.
    """
    check_disjoint(periods)
    n_days = max(p.n_days for p in periods)
    rows = activity.where(in_any("dt", periods)).select(
        "user_id",
        period_index("dt", periods).alias("period_no"),
        F.datediff("dt", period_start("dt", periods)).alias("day_no"),
        "dt",
        "played",
        "spent",
        "coin",
    )
    totals = rows.groupBy("user_id", "period_no").agg(
        days.distinct_days("played", "day_no", n_days).alias("play_days"),
        F.expr("max(dt) FILTER (WHERE played)").alias("last_play"),
        days.distinct_days("spent", "day_no", n_days).alias("spend_days"),
        F.expr("sum(coin) FILTER (WHERE spent)").alias("spend_coin"),
        F.expr("count_if(spent)").alias("spend_time"),
        F.expr("max(dt) FILTER (WHERE spent)").alias("last_spend"),
    )
    return totals.withColumn("period", period_name("period_no", periods)).drop("period_no")


def spread_periods(
    rows: DataFrame, names: Sequence[str], columns: Sequence[str], total: Sequence[Column] = ()
) -> DataFrame:
    """One row per user from one row per user and period.

    ``col_1`` is the value in the first named period, NULL where the user has no
    row there. Users absent in all named periods do not appear.
    """
    cells = [
        F.expr(f"max(CASE WHEN period = {quoted(name)} THEN {c} END)").alias(f"{c}_{i}")
        for i, name in enumerate(names, 1)
        for c in columns
    ]
    return rows.where(F.col("period").isin(*names)).groupBy("user_id").agg(*total, *cells)


def players(rows: DataFrame) -> DataFrame:
    """Rows of users who played in the period, the shared id stripped of spending."""
    own = F.col("user_id") != SHARED_USER
    return (
        rows.where(F.col("play_days") > 0)
        .withColumn("spend_days", F.when(own, F.col("spend_days")).otherwise(0))
        .withColumn("spend_coin", F.coalesce(F.when(own, F.col("spend_coin")), F.lit(0)))
        .withColumn("last_spend", F.when(own, F.col("last_spend")))
    )


def period_activity(rows: DataFrame) -> DataFrame:
    """Play and spend activity of every player and period."""
    return players(rows).select(
        "user_id", "play_days", "last_play", "spend_days", "spend_coin", "last_spend", "period"
    )


def zero_activity(rows: DataFrame) -> DataFrame:
    """Rows without a play day, counted per period; anything but zero is a fault.

    Operators here only write players, so run it on a table read back with
    ``read_periods``, where a bad load would show.
    """
    return rows.groupBy("period").agg(F.count_if(F.col("play_days") == 0).alias("n_zero"))


def user_count(rows: DataFrame) -> DataFrame:
    """Distinct users per period."""
    return rows.groupBy("period").agg(F.count_distinct("user_id").alias("uu"))


def period_map(rows: DataFrame) -> DataFrame:
    """Per user a map from period to ``(play, coin)``; one entry per period, so it stays small."""
    entry = F.struct("period", F.struct(F.col("play_days").alias("play"), F.col("spend_coin").alias("coin")))
    return rows.groupBy("user_id").agg(F.map_from_entries(F.collect_list(entry)).alias("info"))


def period_map_rows(maps: DataFrame) -> DataFrame:
    """The period maps as rows ``user_id, period, play, coin``."""
    return maps.select("user_id", F.explode("info").alias("period", "seen")).select(
        "user_id", "period", "seen.play", "seen.coin"
    )


def period_cell(maps: DataFrame, period: str) -> DataFrame:
    """Play and coin of one period, looked up in the maps; NULL where absent."""
    seen = F.col("info")[period]
    return maps.select("user_id", seen["play"].alias("play"), seen["coin"].alias("coin"))


def distinct_categories(logins: DataFrame) -> DataFrame:
    return logins.select("category").distinct()


def login_days(logins: DataFrame) -> DataFrame:
    """Distinct login days per user over all given rows."""
    return logins.groupBy("user_id").agg(F.count_distinct("dt").alias("login_day"))


def spend_totals(activity: DataFrame) -> DataFrame:
    """Number of spenders and their coin, in one row."""
    return activity.where("spent").agg(
        F.count_distinct("user_id").alias("suu"), F.sum("coin").alias("spend_coin")
    )


def engagement_wide(rows: DataFrame, first: str, second: str) -> DataFrame:
    """Users who logged in during the first period, with login days and coin of both."""
    wide = spread_periods(rows, (first, second), ("play_days", "spend_coin"))
    return wide.where(F.col("play_days_1") > 0).select(
        "user_id",
        F.col("play_days_1").alias("loginday"),
        F.coalesce("spend_coin_1", F.lit(0)).alias("spendcoin"),
        F.coalesce("play_days_2", F.lit(0)).alias("loginday2"),
        F.coalesce("spend_coin_2", F.lit(0)).alias("spendcoin2"),
    )


def payer_engagement_wide(rows: DataFrame, first: str, second: str) -> DataFrame:
    """Users who spent in the first period; ``login_day`` is NULL for payers without a login in it."""
    columns = ("play_days", "spend_coin", "spend_days", "spend_time")
    wide = spread_periods(rows, (first, second), columns)
    return wide.where(F.col("spend_time_1") > 0).select(
        "user_id",
        F.col("spend_coin_1").alias("spend_coin"),
        F.col("spend_days_1").alias("spend_day"),
        F.when(F.col("play_days_1") > 0, F.col("play_days_1")).alias("login_day"),
        F.coalesce("play_days_2", F.lit(0)).alias("loginday2"),
        F.coalesce("spend_coin_2", F.lit(0)).alias("spend_all2"),
        F.coalesce("spend_days_2", F.lit(0)).alias("spend_day2"),
    )


def engagement_sanity(wide: DataFrame) -> DataFrame:
    """Row, user, churn and payer counts of the login-driven wide table.

    A user churned without a login day in the second period and is a payer with
    coin in the first.
    """
    return wide.agg(
        F.count("*").alias("n_rows"),
        F.count_distinct("user_id").alias("n_users"),
        F.count_if(F.col("loginday2") == 0).alias("churn"),
        F.count_if(F.col("spendcoin") > 0).alias("spend_flag"),
    )
