"""Recency, frequency and monetary scores, their tables, and three-period labels."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segtide.functions import bands
from segtide.operators.activity import players, spread_periods
from segtide.operators.skew import sample_rows
from segtide.periods import Period, check_disjoint, in_any

NOT_PLAYED = "notplay"


def monthly_spend_wide(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """Last spend day and every month's coin, days and purchases of each spender."""
    measures = {"spend_coin": "spend_coin", "spend_days": "spend_day", "spend_time": "spend_time"}
    wide = spread_periods(
        rows.where(F.col("spend_time") > 0), names, tuple(measures), [F.max("last_spend").alias("recency")]
    )
    months = [
        F.coalesce(f"{source}_{i}", F.lit(0)).alias(f"{target}_{i}")
        for i in range(1, len(names) + 1)
        for source, target in measures.items()
    ]
    return wide.select("user_id", "recency", *months)


def totals_of_months(wide: DataFrame, n_months: int) -> DataFrame:
    """Recency, frequency and monetary value from the wide monthly table."""

    def over_months(name: str) -> Column:
        return sum((F.col(f"{name}_{i}") for i in range(2, n_months + 1)), F.col(f"{name}_1"))

    return wide.select(
        "user_id",
        "recency",
        over_months("spend_time").alias("frequency"),
        over_months("spend_coin").alias("monetary"),
    )


def spender_totals(activity: DataFrame, periods: Sequence[Period]) -> DataFrame:
    """The same totals straight from the log, without the months in between."""
    spends = activity.where(in_any("dt", check_disjoint(periods)) & F.col("spent"))
    return spends.groupBy("user_id").agg(
        F.max("dt").alias("recency"), F.count("*").alias("frequency"), F.sum("coin").alias("monetary")
    )


def rfm_profile_stats(totals: DataFrame) -> DataFrame:
    """Extremes and truncated means of frequency and monetary value over all spenders, in one row."""
    return totals.agg(
        *[
            F.expr(how).alias(f"{name}_{c}")
            for c in ("frequency", "monetary")
            for name, how in (("max", f"max({c})"), ("min", f"min({c})"), ("mean", f"sum({c}) div count({c})"))
        ]
    )


def user_rfm_scores(
    totals: DataFrame,
    recency_cuts: Sequence[date] = bands.RECENCY_CUTS,
    frequency_cuts: Sequence[int] = bands.FREQUENCY_CUTS,
    monetary_cuts: Sequence[int] = bands.MONETARY_CUTS,
) -> DataFrame:
    """R, F and M from 1 to 5 for every spender."""
    return totals.select(
        "user_id",
        bands.score(F.col("recency"), recency_cuts).alias("R"),
        bands.score(F.col("frequency"), frequency_cuts).alias("F"),
        bands.score(F.col("monetary"), monetary_cuts).alias("M"),
        "recency",
        "frequency",
        "monetary",
    )


def recency_distribution(scores: DataFrame) -> DataFrame:
    """Users per last spend day."""
    return scores.groupBy("recency").agg(F.count("*").alias("uu")).orderBy("recency")


def score_distribution(scores: DataFrame) -> DataFrame:
    """Users per value of each of the three scores.

    Counting the score triples first leaves at most 125 rows to unfold.
    """
    triples = scores.groupBy("R", "F", "M").agg(F.count("*").alias("users"))
    single = F.explode(
        F.array(*[F.struct(F.lit(c).alias("score_name"), F.col(c).alias("score")) for c in ("R", "F", "M")])
    )
    return (
        triples.select(single.alias("s"), "users")
        .groupBy("s.score_name", "s.score")
        .agg(F.sum("users").alias("uu"))
        .orderBy("score_name", "score")
    )


def rfm_cells(scores: DataFrame) -> DataFrame:
    """Users, coin, truncated coin per user and overall rank of every score triple."""
    cells = scores.groupBy("R", "F", "M").agg(F.count("*").alias("uu"), F.sum("monetary").alias("coin"))
    return cells.select(
        "R",
        "F",
        "M",
        "uu",
        "coin",
        F.expr("cast(coin div uu as int)").alias("arppu"),
        bands.final_rank(F.col("R"), F.col("F"), F.col("M")).alias("final_rank"),
    ).orderBy(F.desc("R"), F.desc("F"), F.desc("M"))


def _roll_up(cells: DataFrame, *keys: str) -> DataFrame:
    sums = cells.groupBy(*keys).agg(F.sum("uu").alias("uu"), F.sum("coin").alias("coin"))
    return sums.withColumn("arppu", F.col("coin") / F.col("uu"))


def final_rank_table(cells: DataFrame) -> DataFrame:
    """Cells rolled up to the overall rank."""
    return _roll_up(cells, "final_rank").orderBy("final_rank")


def rf_matrix(cells: DataFrame) -> DataFrame:
    """Cells rolled up to recency by frequency."""
    return _roll_up(cells, "R", "F").orderBy(F.desc("F"), F.desc("R"))


def mf_matrix(cells: DataFrame) -> DataFrame:
    """Cells rolled up to monetary value by frequency."""
    return _roll_up(cells, "M", "F").orderBy(F.desc("F"), F.desc("M"))


def _label(end: Column, last_play: Column, play_days: Column, coin: Column) -> Column:
    """Label at the end of a period; absent users have no play days and get the absent label."""
    return F.coalesce(bands.rfm_label(F.datediff(end, last_play), play_days, coin), F.lit(bands.ABSENT_LABEL))


def training_sample(scores: DataFrame, origin: date, n: int = 500_000, seed: str = "") -> DataFrame:
    """``n`` scored users without their ids: days from ``origin`` to the last spend, totals, ``R_F_M``."""
    return sample_rows(scores, F.col("user_id"), n, seed).select(
        F.datediff("recency", F.lit(origin)).alias("recency_days"),
        "frequency",
        "monetary",
        bands.score_label(F.col("R"), F.col("F"), F.col("M")).alias("rfm"),
    )


def labelled(rows: DataFrame, periods: Sequence[Period]) -> DataFrame:
    """``RxFxMx`` label (``seg``) of every player and period."""
    end = F
    for p in periods:
        end = end.when(F.col("period") == p.name, F.lit(p.end))
    return players(rows).select(
        "user_id", "period", _label(end, F.col("last_play"), F.col("play_days"), F.col("spend_coin")).alias("seg")
    )


def user_rfm_labels(rows: DataFrame, periods: Sequence[Period]) -> DataFrame:
    """Labels, raw values and period-to-period changes of every player of any period.

    The periods are put side by side once and labelled afterwards, in place of a
    join per period. Days stay dates until the last projection renders them.
    """
    names = [p.name for p in periods]
    numbers = range(1, len(periods) + 1)
    wide = spread_periods(players(rows), names, ("last_play", "play_days", "spend_coin"))

    def value(name: str, i: int) -> Column:
        return F.coalesce(F.col(f"{name}_{i}"), F.lit(0))

    def label(i: int, period: Period) -> Column:
        return _label(F.lit(period.end), *[F.col(f"{c}_{i}") for c in ("last_play", "play_days", "spend_coin")])

    labels = [label(i, p).alias(f"p{i}") for i, p in enumerate(periods, 1)]
    raw = []
    for i in numbers:
        shown = F.date_format(f"last_play_{i}", "yyyyMMdd")
        raw += [
            F.coalesce(shown, F.lit(NOT_PLAYED)).alias(f"p{i}_recency"),
            value("play_days", i).alias(f"p{i}_play_days"),
            value("spend_coin", i).alias(f"p{i}_spend_coin"),
        ]
    changes = [
        (value(name, i + 1) - value(name, i)).alias(f"p{i}p{i + 1}_{name}")
        for i in numbers[:-1]
        for name in ("play_days", "spend_coin")
    ]
    return wide.select("user_id", *labels, *raw, *changes)
