"""The activity shape over an order book: line items stand for log rows.

A user is the ordering customer, an app the supplier, a day the ship date.
Every line item is a play row; the returned ones are also spend rows, worth a
hundredth of their price in whole coins.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from segtide.periods import Period


def _shipped_in(periods: Sequence[Period]) -> Column:
    """Day filter on the stored timestamp itself, so that it reaches the file scan."""
    ranges = [
        f"(l_shipdate >= TIMESTAMP_NTZ'{p.start} 00:00:00' AND "
        f"l_shipdate < TIMESTAMP_NTZ'{p.end + timedelta(days=1)} 00:00:00')"
        for p in periods
    ]
    return F.expr(" OR ".join(ranges))


def _line_items(spark: SparkSession, sf_dir: str, periods: Sequence[Period] | None) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return lines if periods is None else lines.where(_shipped_in(periods))


def read_activity(
    spark: SparkSession,
    sf_dir: str,
    periods: Sequence[Period] | None = None,
    spends_only: bool = False,
) -> DataFrame:
    """Activity rows of the given periods, or of all days. Orders without a customer count for nobody.

    No side of the join is hinted: orders grow with the data, so the size check
    of the optimiser decides, and adaptive execution splits skewed orders.
    """
    spent = F.col("l_returnflag") == "R"
    lines = _line_items(spark, sf_dir, periods)
    if spends_only:
        lines = lines.where(spent)
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").where(F.col("o_custkey").isNotNull())
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        F.col("o_custkey").alias("user_id"),
        F.col("l_shipdate").cast("date").alias("dt"),
        F.col("l_suppkey").alias("app"),
        F.col("l_linestatus").alias("category"),
        F.lit(True).alias("played"),
        F.coalesce(spent, F.lit(False)).alias("spent"),
        F.floor(F.col("l_extendedprice") / 100).alias("coin"),
    )


def read_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The category of every log row; needs no user, hence no join."""
    return _line_items(spark, sf_dir, None).select(F.col("l_linestatus").alias("category"))
