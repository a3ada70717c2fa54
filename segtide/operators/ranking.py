"""Combining ranked lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segtide.operators.skew import number_rows


def best_first() -> list[Column]:
    """The order of the report: by score, ties by item."""
    return [F.desc("score"), F.asc("item")]


def list_rows(top: DataFrame) -> DataFrame:
    """Ranked apps (ranks from 1) as list rows ``pos, item`` (positions from 0)."""
    return top.select((F.col("rank") - 1).alias("pos"), F.col("app").alias("item"))


def combined_rank(lists: DataFrame) -> DataFrame:
    """Sum of reciprocal ranks per item, all items, best first; ties go by item.

    The ordered rows are the report; ``ranked_lists.write_lines_in_order`` puts them into files.
    """
    return combined_scores(lists).orderBy(*best_first())


def combined_scores(lists: DataFrame) -> DataFrame:
    """Sum of reciprocal ranks per item, in no order."""
    return lists.groupBy("item").agg(F.sum(1 / (F.col("pos") + 1)).alias("score"))


def numbered_rank(lists: DataFrame) -> DataFrame:
    """The combined ranking as rows ``place, item, score``, places from 1."""
    return number_rows(combined_scores(lists), best_first()).select("place", "item", "score")
