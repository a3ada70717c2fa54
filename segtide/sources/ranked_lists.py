"""Ranked lists kept as text, one ``[id,id,...]`` per line."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_ranked_lists(spark: SparkSession, path: str, header: bool = False) -> DataFrame:
    """Rows ``pos, item`` (position from 0) of every list in the file.

    Items are not trimmed; only white space at the end of a line goes. With
    ``header`` the first line of each file is skipped, and so are blank lines.
    """
    if header:
        # A control character as separator keeps each line whole.
        lines = spark.read.schema("value string").csv(path, header=True, sep="\x01", quote="", enforceSchema=True)
    else:
        lines = spark.read.text(path)
    bare = F.regexp_replace(F.regexp_replace("value", r"\s+$", ""), r"[\[\]]", "")
    return lines.select(F.posexplode(F.split(bare, ",")).alias("pos", "item"))


def write_ranked_lists(lists: DataFrame, path: str, items: str) -> None:
    """Write an array of items a row as a line ``[id,id,...]`` each; lists come in no order."""
    line = F.concat(F.lit("["), F.array_join(F.col(items).cast("array<string>"), ","), F.lit("]"))
    lists.select(line.alias("value")).write.mode("overwrite").text(path)


def write_lines_in_order(df: DataFrame, path: str, line: Column, order: Sequence[Column]) -> None:
    """Write a line of text a row so that the files, read in order of their names, have all lines in order.

    Rows go to ranges of the order and are sorted inside each, so no task sorts
    more than its range. ``order`` should tell rows apart: equal ones can't be dealt to several ranges.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed.select(line.alias("value")).write.mode("overwrite").text(path)
