"""Login and spend segments, and how users move between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segtide.functions import bands
from segtide.operators.activity import spread_periods

METRICS = ("move_uu", "delta_login", "delta_coin", "l_c_per_user", "l_logc_per_user")


def _per_part(value: str, divisor: int) -> Column:
    return F.ceil(F.col(value) / divisor)


def _logins(rows: DataFrame, divisor: int) -> DataFrame:
    """Rows of users who logged in, both measures averaged over ``divisor`` parts and rounded up."""
    return rows.where(F.col("play_days") > 0).select(
        "user_id",
        "period",
        _per_part("play_days", divisor).alias("login_day"),
        _per_part("spend_coin", divisor).alias("spend_coin"),
    )


def login_spend_segments(rows: DataFrame, period: str, divisor: int = 3) -> DataFrame:
    """Login class and spend class of every user who logged in during the period.

    The divisor turns a period's totals into monthly averages. The spend class
    looks at the coin before missing spending becomes 0.
    """
    return (
        _logins(rows, divisor)
        .where(F.col("period") == period)
        .select(
            "user_id",
            bands.login_class(F.col("login_day")).alias("L"),
            bands.spend_class(F.col("spend_coin")).alias("C"),
            "login_day",
            F.coalesce("spend_coin", F.lit(0)).alias("spend_coin"),
            F.lit(1).alias("uu"),
        )
    )


def segment_migration(rows: DataFrame, first: str, second: str, divisor: int = 3) -> DataFrame:
    """Segment pair and deltas of every user seen in either period.

    Both periods are put side by side by one grouping, in place of a distinct
    user list joined to each period.
    """
    wide = spread_periods(_logins(rows, divisor), (first, second), ("login_day", "spend_coin"))

    def segment(i: int) -> Column:
        days, coin = F.col(f"login_day_{i}"), F.col(f"spend_coin_{i}")
        spend = F.when(days.isNotNull(), bands.spend_class(coin))
        return bands.class_pair(bands.login_class(days), spend)

    def delta(name: str) -> Column:
        after, before = (F.coalesce(F.col(f"{name}_{i}"), F.lit(0)) for i in (2, 1))
        return after - before

    return wide.select(
        "user_id",
        segment(1).alias("p1"),
        segment(2).alias("p2"),
        delta("login_day").alias("delta_login_day"),
        delta("spend_coin").alias("delta_spend_coin"),
        F.lit(1).alias("uu"),
    )


def migration_summary(moves: DataFrame) -> DataFrame:
    """Users and summed deltas per segment pair, with two per-user movement metrics.

    Products are taken in double precision, so that long sums cannot overflow.
    The logarithm has no value where the coin delta is exactly -1.
    """
    sums = moves.groupBy("p1", "p2").agg(
        F.count("*").alias("move_uu"),
        F.sum("delta_login_day").alias("delta_login"),
        F.sum("delta_spend_coin").alias("delta_coin"),
    )
    users, login, coin = (F.col(c).cast("double") for c in ("move_uu", "delta_login", "delta_coin"))
    size = F.abs(coin + 1)
    return sums.select(
        F.when(F.col("p1") == bands.ABSENT_CLASS, F.lit("New->")).otherwise(F.col("p1")).alias("p1"),
        F.when(F.col("p2") == bands.ABSENT_CLASS, F.lit("->Churn")).otherwise(F.col("p2")).alias("p2"),
        "move_uu",
        "delta_login",
        "delta_coin",
        (coin * login / (users * users)).alias("l_c_per_user"),
        (F.when(size > 0, F.ln(size)) * login / users).alias("l_logc_per_user"),
    )


def _ranked(summary: DataFrame, metric: str, n: int, order) -> DataFrame:
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    return summary.orderBy(order(F.col(metric)), "p1", "p2").limit(n)


def top_moves(summary: DataFrame, metric: str = "l_logc_per_user", n: int = 5) -> DataFrame:
    """The ``n`` segment pairs with the highest metric."""
    return _ranked(summary, metric, n, Column.desc_nulls_last)


def bottom_moves(summary: DataFrame, metric: str = "l_logc_per_user", n: int = 5) -> DataFrame:
    """The ``n`` segment pairs with the lowest metric; pairs without a value come last."""
    return _ranked(summary, metric, n, Column.asc_nulls_last)


def moved_users(moves: DataFrame, p1: str, p2: str) -> DataFrame:
    """The users of one segment pair."""
    return moves.where((F.col("p1") == p1) & (F.col("p2") == p2))
