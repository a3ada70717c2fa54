"""Readers for the daily logs, and the one activity shape every operator reads.

An activity row is one log row: ``user_id, dt, app, played, spent, coin``. Dates
are typed and coins positive from here on, whatever the log's own format.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from segtide.sources.tables import write_parts

# The filters that select the platform's rows.
REGION = "JP"
DEVICE = 2
CATEGORY = 2
SPEND_TYPES = (-2010,)

PLAY_SCHEMA = (
    "user_id bigint, user_info struct<region: string>, device_id int, "
    "details struct<application_id: bigint>, dt string"
)
SPEND_SCHEMA = "user_id bigint, type int, subtype bigint, nondeveloper_coin int, dt string"


def _days(start: date | None, end: date | None, pattern: str) -> Column:
    """Range filter on the string partition column, in the log's own date format."""
    keep = F.col("dt").isNotNull()
    if start is not None:
        keep &= F.col("dt") >= start.strftime(pattern)
    if end is not None:
        keep &= F.col("dt") <= end.strftime(pattern)
    return keep


def read_play_log(
    spark: SparkSession,
    path: str,
    start: date | None = None,
    end: date | None = None,
    region: str = REGION,
    device: int = DEVICE,
) -> DataFrame:
    """Play rows of a day range from a log partitioned by ``dt=yyyyMMdd``."""
    return (
        spark.read.schema(PLAY_SCHEMA)
        .parquet(path)
        .where(_days(start, end, "%Y%m%d"))
        .where((F.col("user_info.region") == region) & (F.col("device_id") == device))
        .select(
            "user_id",
            F.to_date("dt", "yyyyMMdd").alias("dt"),
            F.col("details.application_id").alias("app"),
        )
    )


def read_spend_log(
    spark: SparkSession,
    path: str,
    start: date | None = None,
    end: date | None = None,
    kinds: Sequence[int] = SPEND_TYPES,
) -> DataFrame:
    """Spend rows of a day range from a coin log partitioned by ``dt=yyyy-MM-dd``.

    The log books spending as negative movements; ``coin`` is their positive size.
    """
    return (
        spark.read.schema(SPEND_SCHEMA)
        .parquet(path)
        .where(_days(start, end, "%Y-%m-%d"))
        .where(F.col("type").isin(*kinds) & (F.col("nondeveloper_coin") < 0))
        .select(
            "user_id",
            F.to_date("dt", "yyyy-MM-dd").alias("dt"),
            F.col("subtype").alias("app"),
            (-F.col("nondeveloper_coin").cast("bigint")).alias("coin"),
        )
    )


def _write_days(rows: DataFrame, path: str, pattern: str) -> None:
    """Load the days contained in the rows as ``dt`` partitions named in the log's own format; other days stay."""
    write_parts(rows.withColumn("dt", F.date_format("dt", pattern)), path, ["dt"])


def write_play_log(rows: DataFrame, path: str) -> None:
    """Load days of a play log from rows ``user_id, dt, region, device_id, app``, with region and app nested as the log keeps them."""
    nested = rows.select(
        F.col("user_id").cast("bigint").alias("user_id"),
        F.struct(F.col("region").cast("string").alias("region")).alias("user_info"),
        F.col("device_id").cast("int").alias("device_id"),
        F.struct(F.col("app").cast("bigint").alias("application_id")).alias("details"),
        "dt",
    )
    _write_days(nested, path, "yyyyMMdd")


def write_spend_log(rows: DataFrame, path: str) -> None:
    """Load days of a coin log from rows ``user_id, dt, type, app, movement``; spending is a negative movement."""
    shaped = rows.select(
        F.col("user_id").cast("bigint").alias("user_id"),
        F.col("type").cast("int").alias("type"),
        F.col("app").cast("bigint").alias("subtype"),
        F.col("movement").cast("int").alias("nondeveloper_coin"),
        "dt",
    )
    _write_days(shaped, path, "yyyy-MM-dd")


def union_shards(shards: Sequence[DataFrame]) -> DataFrame:
    """All rows of tables kept one per month."""
    return reduce(lambda a, b: a.unionByName(b), shards)


def login_rows(logins: DataFrame, category: int | str | None = CATEGORY) -> DataFrame:
    """Login rows of one category (all with None) from a log of ``user_id, date, category``."""
    rows = logins if category is None else logins.where(F.col("category") == category)
    return rows.select("user_id", F.col("date").cast("date").alias("dt"))


def purchase_rows(
    purchases: DataFrame,
    region: str = REGION,
    kinds: Sequence[int] = SPEND_TYPES,
) -> DataFrame:
    """Purchases of one region from a log of ``user_id, date, region, type, coin_nondeveloper``."""
    return purchases.where((F.col("region") == region) & F.col("type").isin(*kinds)).select(
        "user_id",
        F.col("date").cast("date").alias("dt"),
        F.col("coin_nondeveloper").cast("bigint").alias("coin"),
    )


def activity(plays: DataFrame, spends: DataFrame) -> DataFrame:
    """Both logs as one activity table; columns a log lacks are NULL.

    Rows without a user id count for nobody in any operator and are dropped here;
    in real logs they are the largest key of all.

    The union replaces the join of the two logs: one grouping by user then
    yields the play and the spend side together.
    """

    def shaped(rows: DataFrame, played: bool) -> DataFrame:
        def column(name: str) -> Column:
            value = F.col(name) if name in rows.columns else F.lit(None)
            return value.cast("bigint").alias(name)

        known = rows.where(F.col("user_id").isNotNull())
        return known.select(
            column("user_id"),
            "dt",
            column("app"),
            F.lit(played).alias("played"),
            F.lit(not played).alias("spent"),
            column("coin"),
        )

    return shaped(plays, True).unionByName(shaped(spends, False))
