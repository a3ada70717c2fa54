"""Result tables, most of them partitioned by period."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_table(df: DataFrame, path: str) -> None:
    """Write a whole result, replacing what is there."""
    df.write.mode("overwrite").parquet(path)


def save_table(df: DataFrame, name: str, partition_by: Sequence[str] = ()) -> None:
    """Create or replace a catalog table from a result."""
    df.write.mode("overwrite").partitionBy(*partition_by).saveAsTable(name)


def write_parts(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    """Load the partitions contained in ``df``, of one or several levels; others of the table stay.

    Loading a partition again replaces it, so a repeated load leaves no duplicates and loads may come in any order.
    The rebalance hint sizes the output files, also where one partition is far
    larger than the others.
    """
    (
        df.hint("rebalance", *columns)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*columns)
        .parquet(path)
    )


def write_periods(df: DataFrame, path: str, column: str = "period") -> None:
    """Load the periods contained in ``df``, replacing what the table has of them."""
    write_parts(df, path, [column])


def save_bucketed(df: DataFrame, name: str, by: Sequence[str], buckets: int, path: str) -> DataFrame:
    """Create or replace a catalog table whose rows lie in buckets by the hash of some columns, sorted by them.

    Tables of as many buckets by the same columns are joined and grouped on them without a shuffle. Rows are dealt to the
    buckets first, so each bucket is one file. Buckets should hold what a task can sort; a
    column with a value that fills a bucket by itself is no good to bucket by.
    """
    dealt = df.repartition(buckets, *by)
    dealt.write.mode("overwrite").bucketBy(buckets, *by).sortBy(*by).option("path", path).format("parquet").saveAsTable(name)
    return df.sparkSession.table(name)


def write_observed(df: DataFrame, path: str, checks: dict[str, Column]) -> dict[str, int]:
    """Write a whole result and return aggregates over its rows, taken in the pass that writes them.

    Aggregates are of the kind that merges from task to task: counts, sums, extremes. They are taken in the last
    stage, whose tasks count once even if one is repeated.
    """
    seen = Observation()
    df.observe(seen, *[check.alias(name) for name, check in checks.items()]).write.mode("overwrite").parquet(path)
    return seen.get


def read_periods(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str,
    periods: Sequence[str] | None = None,
    column: str = "period",
) -> DataFrame:
    """Read the chosen periods only; the files of the others are not opened.

    ``schema`` declares the table's columns, so no file is opened to infer them. The
    period is text in it, because names may look like numbers and must come back as written.
    """
    table = spark.read.schema(schema).parquet(path)
    return table if periods is None else table.where(F.col(column).isin(*periods))
