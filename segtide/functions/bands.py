"""Score and label bands.

Two conventions live side by side and are kept apart on purpose: login and
spend classes and scores close their bands below, ``[lo, hi)``; the
recency-frequency-monetary labels close them above, ``(lo, hi]``. 500 coins is
therefore C3 as a spend class and M2 as a label.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

# The band edges that results must agree on.
LOGIN_CUTS = (4, 8, 15, 25)
SPEND_CUTS = (500, 2000, 10000)
RECENCY_CUTS = (date(2013, 3, 1), date(2013, 4, 1), date(2013, 5, 1), date(2013, 6, 1))
FREQUENCY_CUTS = (10, 30, 80, 150)
MONETARY_CUTS = (500, 2500, 10000, 50000)
QUADRANT_COUNT = 13
QUADRANT_COIN = 7900
DAYS_SINCE_TOPS = (7, 14, 21, 30, 90)
PLAY_DAY_TOPS = (3, 7, 14, 25)
COIN_TOPS = (500, 2000, 10000)

ABSENT_LABEL = "R0F0M0"
ABSENT_CLASS = "L0-C0"


def closed_below(value: Column, cuts: Sequence, labels: Sequence) -> Column:
    """First label below the first cut, last label from the last cut on; NULL stays NULL."""
    chain = F
    for cut, label in zip(cuts, labels):
        chain = chain.when(value < cut, label)
    return chain.when(value >= cuts[-1], labels[-1])


def closed_above(value: Column, tops: Sequence, labels: Sequence) -> Column:
    """Each top belongs to its own band, the last label is open-ended; NULL stays NULL."""
    chain = F
    for top, label in zip(tops, labels):
        chain = chain.when(value <= top, label)
    return chain.when(value > tops[-1], labels[-1])


def login_class(days: Column) -> Column:
    """L1..L5 by login days; no class without a login day."""
    return F.when(days > 0, closed_below(days, LOGIN_CUTS, ("L1", "L2", "L3", "L4", "L5")))


def spend_class(coin: Column) -> Column:
    """C1 without any spend row, C2..C5 by coin; a sum of zero or less has no class."""
    return F.when(coin.isNull(), "C1").when(
        coin > 0, closed_below(coin, SPEND_CUTS, ("C2", "C3", "C4", "C5"))
    )


def class_pair(login: Column, spend: Column) -> Column:
    """``L-C`` label; each missing part becomes its zero class."""
    return F.concat_ws("-", F.coalesce(login, F.lit("L0")), F.coalesce(spend, F.lit("C0")))


def score(value: Column, cuts: Sequence) -> Column:
    """1 below the first cut up to 5 from the fourth cut on."""
    return closed_below(value, cuts, range(1, len(cuts) + 2))


def recency_label(days_since: Column) -> Column:
    """R5 (last week) .. R0 (over 90 days); R999 for unknown or negative distances."""
    labels = ("R5", "R4", "R3", "R2", "R1", "R0")
    return F.when(days_since >= 0, closed_above(days_since, DAYS_SINCE_TOPS, labels)).otherwise("R999")


def frequency_label(days: Column) -> Column:
    """F0 for zero days, then F1..F5; NULL below zero."""
    labels = ("F1", "F2", "F3", "F4", "F5")
    return F.when(days == 0, "F0").when(days > 0, closed_above(days, PLAY_DAY_TOPS, labels))


def monetary_label(coin: Column) -> Column:
    """M1 for no coin, then M2..M5; NULL below zero."""
    labels = ("M2", "M3", "M4", "M5")
    return F.when(coin == 0, "M1").when(coin > 0, closed_above(coin, COIN_TOPS, labels))


def rfm_label(days_since: Column, play_days: Column, coin: Column) -> Column:
    """``RxFxMx``; NULL as soon as a part has no label."""
    return F.concat(recency_label(days_since), frequency_label(play_days), monetary_label(coin))


def quadrant(count: Column, coin: Column, x: float = QUADRANT_COUNT, y: float = QUADRANT_COIN) -> Column:
    """C1 high count and coin, C2 coin only, C3 count only, C4 neither; only above the threshold is high."""
    often, much = count > x, coin > y
    return (
        F.when(often & much, "C1")
        .when(~often & much, "C2")
        .when(often & ~much, "C3")
        .when(~often & ~much, "C4")
    )


def stability(first: Column, second: Column, third: Column, absent: str = "no") -> Column:
    """``kotei`` for three equal classes, ``churn`` if gone after the first, else ``move``."""
    return (
        F.when((first == second) & (first == third), F.lit("kotei"))
        .when((second == absent) & (third == absent), F.lit("churn"))
        .otherwise("move")
    )


def score_label(r: Column, f: Column, m: Column) -> Column:
    """``R_F_M`` from the three scores; NULL if a score is missing."""
    sep = F.lit("_")
    return F.concat(r.cast("string"), sep, f.cast("string"), sep, m.cast("string"))


def final_rank(r: Column, f: Column, m: Column) -> Column:
    """1 for the best users (5, 5, 5) down to 13 for (1, 1, 1)."""
    return F.lit(16) - (r + f + m)
