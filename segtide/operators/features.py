"""Per-user features: labels, app breadth and volume, and gaps between active days."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segtide.functions.days import WORD, any_day, dates_of_words, day_words, gaps_of_words, word_array
from segtide.operators.activity import SHARED_USER
from segtide.operators.affinity import PLAY, SPEND
from segtide.periods import Period, check_disjoint, in_any, period_index, period_name, period_start


CREDITED = f"spent AND user_id <> {SHARED_USER}"


def active_words(activity: DataFrame, period: Period, periods: Sequence[Period] = ()) -> DataFrame:
    """Play and spend days in one period, as bit words, of everyone who played in any of ``periods``, that one by default.

    ``play_words`` is NULL for users who did not play in the period, ``spend_words`` also
    without a credited spend row. Words merge on the map side, and are unfolded only where days are asked for.
    """
    rows = activity.where(in_any("dt", [period, *periods])).select(
        "user_id", "played", F.expr(CREDITED).alias("paid"), F.datediff("dt", F.lit(period.start)).alias("day_no")
    )
    words = [*day_words("played", "day_no", period.n_days, "play_"), *day_words("paid", "day_no", period.n_days, "spend_")]
    users = rows.groupBy("user_id").agg(F.bool_or("played").alias("played"), *words).where("played")
    named = users.select("user_id", *_sides(period.n_days))
    return named if periods else named.where("play_words IS NOT NULL")


def _sides(n_days: int, paid: Column | bool = True) -> list[Column]:
    """The words of both sides as arrays; NULL for a side without days, and for spending without play."""
    there = any_day("play_", n_days)
    paying = there & any_day("spend_", n_days) & paid
    return [F.when(there, word_array("play_", n_days)).alias("play_words"), F.when(paying, word_array("spend_", n_days)).alias("spend_words")]


def active_days(words: DataFrame, period: Period) -> DataFrame:
    """Ascending play and spend dates from ``active_words``; arrays are bounded by the length of the period."""
    return words.select("user_id", *[dates_of_words(F.col(f"{side}_words"), period.start).alias(f"{side}_dates") for side in ("play", "spend")])


def period_details(activity: DataFrame, periods: Sequence[Period]) -> DataFrame:
    """One row per user and period as ``user_periods`` gives, with breadth, volume and day words of the first period, from one grouping of the log.

    Rows are grouped by user, period and, in the first period, app; users with
    their totals follow from that much smaller table.
    """
    n_days = max(p.n_days for p in check_disjoint(periods))
    number = period_index("dt", periods)
    rows = activity.where(in_any("dt", periods)).select(
        "user_id", number.alias("period_no"), F.when(number == 0, F.col("app")).alias("app"), "dt", "played", "spent", "coin",
        F.datediff("dt", period_start("dt", periods)).alias("day_no"),
    )
    words = [*day_words("played", "day_no", n_days, "play_"), *day_words("spent", "day_no", n_days, "spend_")]
    latest = {"last_play": "played", "last_spend": "spent"}
    partial = rows.groupBy("user_id", "period_no", "app").agg(
        *words,
        *[F.expr(f"max(dt) FILTER (WHERE {flag})").alias(name) for name, flag in latest.items()],
        F.expr("sum(coin) FILTER (WHERE spent)").alias("spend_coin"),
        F.expr("count_if(spent)").alias("spend_time"),
        F.expr("count_if(played)").alias("plays"),
        F.expr(f"count_if({CREDITED})").alias("spends"),
    )
    names = [f"{side}_{i}" for side in ("play", "spend") for i in range(-(-n_days // WORD))]
    totals = partial.groupBy("user_id", "period_no").agg(
        *[F.expr(f"bit_or({w})").alias(w) for w in names],
        *[F.max(name).alias(name) for name in latest],
        F.sum("spend_coin").alias("spend_coin"),
        F.sum("spend_time").alias("spend_time"),
        *[F.expr(f"count_if(app IS NOT NULL AND {n}s > 0)").alias(f"{n}_apps") for n in ("play", "spend")],
        *[F.expr(f"coalesce(sum({n}s) FILTER (WHERE app IS NOT NULL), 0)").alias(f"{n}_total") for n in ("play", "spend")],
    )
    days = {side: F.expr(" + ".join(f"bit_count({w})" for w in names if w.startswith(side))).cast("bigint") for side in ("play", "spend")}
    return totals.withColumns({"play_days": days["play"], "spend_days": days["spend"], "period": period_name("period_no", periods)}).drop("period_no")


def details_of_period(details: DataFrame, period: Period, n_days: int) -> DataFrame:
    """Breadth, volume and day words of one period's players; spending is not credited to the shared id. ``n_days`` is what the words were made for."""
    own = F.col("user_id") != SHARED_USER
    return details.where((F.col("period") == period.name) & (F.col("play_days") > 0)).select(
        "user_id", "play_apps", "play_total", "spend_apps", "spend_total", *_sides(n_days, own)
    )


def day_rows(activity: DataFrame, period: Period) -> DataFrame:
    """Rows ``user_id, source, dt``: the distinct active days of the period's players.

    Days of spending count for users with a play row in the period, which every spend row of the platform implies; a
    semi join drops the others.
    """
    rows = activity.where(in_any("dt", [period])).select("user_id", "dt", "played", F.expr(CREDITED).alias("paid"))
    sides = [F.when(F.col(c), F.lit(label)) for c, label in (("played", PLAY), ("paid", SPEND))]
    days = rows.select("user_id", F.explode(F.array_compact(F.array(*sides))).alias("source"), "dt").distinct()
    players = days.where(F.col("source") == PLAY).select("user_id").distinct()
    return days.join(players, "user_id", "left_semi")


def visit_gaps(words: DataFrame) -> DataFrame:
    """Rows ``user_id, source, gap_no, gap_days``: days between neighbouring active days.

    A row per user and source comes first, so days are unfolded in one place for both.
    """
    sides = [F.struct(F.lit(label).alias("source"), F.col(name).alias("words")) for label, name in ((PLAY, "play_words"), (SPEND, "spend_words"))]
    rows = words.select("user_id", F.inline(F.array(*sides))).where("words IS NOT NULL")
    return rows.select("user_id", "source", F.posexplode(gaps_of_words(F.col("words"))).alias("gap_no", "gap_days")).withColumn("gap_no", F.col("gap_no") + 1)


def _gap_array(words: str) -> Column:
    """Gaps as an array; ``[0]`` for users without active days, empty for a single day."""
    return F.coalesce(gaps_of_words(F.col(words)), F.array(F.lit(0).cast("bigint")))


def gap_arrays(words: DataFrame) -> DataFrame:
    """Play and spend gaps of each user as arrays."""
    return words.select("user_id", _gap_array("play_words").alias("play_gaps"), _gap_array("spend_words").alias("spend_gaps"))


def user_features(labels: DataFrame, details: DataFrame, *more: Column) -> DataFrame:
    """Labels and raw values of all users with the app breadth and volume of one period, the first.

    ``details`` has one row per user of that period; users who did not play in it
    get zeros, even if they spent. ``more`` are columns made of both.
    """
    played = F.col("p1_play_days") > 0

    def filled(name: str) -> Column:
        return F.coalesce(F.when(played, F.col(name)), F.lit(0)).alias(name)

    raw = [f"p{i}_{c}" for c in ("recency", "play_days", "spend_coin") for i in (1, 2)]
    volume = [filled(c) for c in ("play_apps", "play_total", "spend_apps", "spend_total")]
    return labels.join(details, "user_id", "left").select("user_id", "p1", "p2", "p3", *raw, *volume, *more)


def user_feature_row(labels: DataFrame, details: DataFrame) -> DataFrame:
    """The whole feature row of a user: labels, raw values, breadth and volume, and both gap arrays, by one join.

    ``details`` comes from ``details_of_period``. Counts per app are not part of the row, as a user may have any number of apps: they
    are the rows of ``affinity.user_app_profile`` or the maps of ``affinity.user_app_maps``.
    """
    return user_features(labels, details, _gap_array("play_words").alias("play_gaps"), _gap_array("spend_words").alias("spend_gaps"))
