"""Purchase count by coin quadrants, month by month."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segtide.functions import bands
from segtide.operators.activity import spread_periods


def monthly_spend(rows: DataFrame) -> DataFrame:
    """Coin, spend days and purchases of every spender and month."""
    return rows.where(F.col("spend_time") > 0).select(
        "user_id",
        F.col("period").alias("month"),
        "spend_coin",
        F.col("spend_days").alias("spend_day"),
        "spend_time",
    )


def spend_stats(months: DataFrame, month: str) -> DataFrame:
    """Extremes and truncated means of one month, in one row."""

    def stats(name: str) -> list[Column]:
        mean = F.expr(f"sum({name}) div count({name})")
        return [
            F.max(name).alias(f"max_{name}"),
            F.min(name).alias(f"min_{name}"),
            mean.alias(f"mean_{name}"),
        ]

    return months.where(F.col("month") == month).agg(*stats("spend_coin"), *stats("spend_time"))


def quadrant_distribution(
    months: DataFrame, month: str, x: float = bands.QUADRANT_COUNT, y: float = bands.QUADRANT_COIN
) -> DataFrame:
    """Users and coin per quadrant in one month."""
    return (
        months.where(F.col("month") == month)
        .groupBy(bands.quadrant(F.col("spend_time"), F.col("spend_coin"), x, y).alias("class"))
        .agg(F.count("*").alias("uu"), F.sum("spend_coin").alias("coin"))
    )


def _months_wide(months: DataFrame, names: Sequence[str], x: float, y: float, absent: str) -> DataFrame:
    """Spenders of the first month, with coin and quadrant of every month side by side."""
    wide = spread_periods(months.withColumnRenamed("month", "period"), names, ("spend_time", "spend_coin"))
    wide = wide.where(F.col("spend_time_1").isNotNull())
    for i in range(1, len(names) + 1):
        count, coin = F.col(f"spend_time_{i}"), F.col(f"spend_coin_{i}")
        wide = wide.withColumn(f"class_{i}", F.coalesce(bands.quadrant(count, coin, x, y), F.lit(absent)))
    return wide


def quadrant_migration(
    months: DataFrame,
    first: str,
    second: str,
    x: float = bands.QUADRANT_COUNT,
    y: float = bands.QUADRANT_COIN,
) -> DataFrame:
    """Users and coin change from quadrant to quadrant; leavers go to ``notplay`` with no coin."""
    wide = _months_wide(months, (first, second), x, y, "notplay")
    change = F.coalesce("spend_coin_2", F.lit(0)) - F.col("spend_coin_1")
    return (
        wide.groupBy(F.col("class_1").alias("class_from"), F.col("class_2").alias("class_to"))
        .agg(F.count("*").alias("delta_uu"), F.sum(change).alias("delta_coin"))
        .orderBy("class_to", "class_from")
    )


def quadrant_stability(
    months: DataFrame,
    names: Sequence[str],
    x: float = bands.QUADRANT_COUNT,
    y: float = bands.QUADRANT_COIN,
) -> DataFrame:
    """First-month spenders by quadrant and whether they stayed, left or moved over three months."""
    wide = _months_wide(months, names, x, y, "no")
    flag = bands.stability(*[F.col(f"class_{i}") for i in (1, 2, 3)])
    return wide.groupBy(flag.alias("flag"), F.col("class_1").alias("class1")).agg(F.count("*").alias("uu"))
