"""Stored state of users that is kept up to date: totals by month, and the first pairs of app and user.

A new month costs one month of log. Reports over any union of months come from
the state, which has a row per user and month in place of the log's rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segtide.periods import Period, check_disjoint, in_any, period_index, period_name

MONTH_SCHEMA = "user_id bigint, play_word bigint, spend_word bigint, spend_coin bigint, spend_time bigint, month date, part string"
PAIR_SCHEMA = "app bigint, user_id bigint, load string"


def months_of(periods: Sequence[Period]) -> list[date]:
    """First days of the months of the periods, which must begin and end with a month."""
    found = []
    for p in check_disjoint(periods):
        if p.start.day != 1 or (p.end + timedelta(days=1)).day != 1:
            raise ValueError(f"period {p.name!r} is not made of whole months")
        day = p.start
        while day <= p.end:
            found.append(day)
            day = (day + timedelta(days=31)).replace(day=1)
    return found


def monthly_state(activity: DataFrame, part: str = "") -> DataFrame:
    """One row per user and month of the given log rows: days as the bits of a word, coin and purchases.

    ``part`` names the load, for months that come in several; a load with the same name replaces the earlier one
    where the state is stored by ``month`` and ``part``.
    """
    bit = F.expr("shiftleft(1L, dayofmonth(dt) - 1)")
    rows = activity.select("user_id", F.trunc("dt", "MM").alias("month"), bit.alias("bit"), "played", "spent", "coin")
    return rows.groupBy("user_id", "month").agg(
        F.expr("coalesce(bit_or(CASE WHEN played THEN bit END), 0L)").alias("play_word"),
        F.expr("coalesce(bit_or(CASE WHEN spent THEN bit END), 0L)").alias("spend_word"),
        F.expr("sum(coin) FILTER (WHERE spent)").alias("spend_coin"),
        F.expr("count_if(spent)").alias("spend_time"),
    ).select("user_id", "play_word", "spend_word", "spend_coin", "spend_time", "month", F.lit(part).alias("part"))


def user_periods_of(state: DataFrame, periods: Sequence[Period]) -> DataFrame:
    """What ``activity.user_periods`` gives, from the months' state; one shuffle of rows per user and month.

    Words of one month merge with ``bit_or``, so a day that two loads have counts
    once, and bits of different months add up; coin and purchases are sums.
    """
    months = months_of(periods)
    places = {day: k for p in periods for k, day in enumerate(d for d in months if p.start <= d <= p.end)}
    most = max(places.values()) + 1
    place = F.expr("CASE " + " ".join(f"WHEN month = DATE'{d}' THEN {k}" for d, k in places.items()) + " END")
    rows = state.where(in_any("month", periods)).select("*", place.alias("place"), period_index("month", periods).alias("period_no"))

    def words(side: str) -> list[Column]:
        return [F.expr(f"coalesce(bit_or({side}_word) FILTER (WHERE place = {k}), 0L)").alias(f"{side}_{k}") for k in range(most)]

    # The last day of a month's word is that of its highest bit.
    last = {s: F.expr(f"max(date_add(month, length(bin({s}_word)) - 1)) FILTER (WHERE {s}_word <> 0)").alias(f"last_{s}") for s in ("play", "spend")}
    merged = rows.groupBy("user_id", "period_no").agg(
        *words("play"), *words("spend"), *last.values(), F.sum("spend_coin").alias("spend_coin"), F.sum("spend_time").alias("spend_time")
    )

    def days(side: str) -> Column:
        return F.expr(" + ".join(f"bit_count({side}_{k})" for k in range(most))).cast("bigint").alias(f"{side}_days")

    return merged.select(
        "user_id", days("play"), "last_play", days("spend"), "spend_coin", "spend_time", "last_spend", period_name("period_no", periods).alias("period")
    )


def first_pairs(activity: DataFrame, known: DataFrame | None, load: str) -> DataFrame:
    """Pairs of app and user with a play row in the given log rows that ``known`` hasn't got, to be stored under the name of the load.

    ``known`` are the pairs of earlier loads. A user's rows without an app make a pair without one, which counts for the number of users only.
    """
    pairs = activity.where(F.col("played") & F.col("user_id").isNotNull()).select("app", "user_id").distinct()
    if known is not None:
        seen = known.select(F.col("app").alias("a"), F.col("user_id").alias("u"))
        pairs = pairs.join(seen, pairs["app"].eqNullSafe(seen["a"]) & (pairs["user_id"] == seen["u"]), "left_anti")
    return pairs.withColumn("load", F.lit(load))


def frequency_of_pairs(pairs: DataFrame) -> DataFrame:
    """Distinct users per app from the stored pairs, each of which is there once."""
    return pairs.where("app IS NOT NULL").groupBy("app").agg(F.count("user_id").alias("df"))


def users_of_pairs(pairs: DataFrame) -> Column:
    """Number of users with a play row, as a scalar subquery."""
    return pairs.agg(F.count_distinct("user_id")).scalar()
