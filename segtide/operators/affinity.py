"""Which apps characterise a segment: TF-IDF over per-user normalised app counts.

Everything stays in long form, one row per user, app and period. No step
gathers a user's apps or an app's users in one place, so neither a user with
very many apps nor an app everybody plays needs an executor of its own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segtide.operators.activity import SHARED_USER
from segtide.operators.skew import HOT_ROWS, PIECES, join_per_key
from segtide.periods import Period, check_disjoint, in_any, period_index, period_name

# Names of the two kinds of counts.
PLAY = "playdays"
SPEND = "spendtimes"

USER_KEYS = ("period", "user_id")

# A share of 1 in the whole numbers that shares are summed in.
ONE = 10**18


def app_usage(activity: DataFrame, periods: Sequence[Period] = ()) -> DataFrame:
    """One row per user and app: play rows in all, and play and spend rows of each period side by side.

    One grouping, counted on the map side first, from which the counts per
    period, the document frequency and the corpus size all follow. Rows without
    an app keep a row of their own, as their users belong to the corpus. Rows without a user count for
    nobody; the shared user id is never credited with spending.
    """
    number = period_index("dt", check_disjoint(periods)) if periods else F.lit(-1)
    sides = {"plays": "played", "spends": f"spent AND user_id <> {SHARED_USER}"}
    counted = [
        F.expr(f"count_if({condition} AND period_no = {i})").alias(f"{name}_{i}")
        for i in range(len(periods))
        for name, condition in sides.items()
    ]
    return (
        activity.where(F.col("user_id").isNotNull())
        .withColumn("period_no", number)
        .groupBy("user_id", "app")
        .agg(F.expr("count_if(played)").alias("plays_all"), *counted)
    )


def period_counts(usage: DataFrame, periods: Sequence[Period]) -> DataFrame:
    """Play and spend rows per period, user and app from their usage; periods without rows drop out."""
    cells = [
        F.struct(F.lit(p.name).alias("period"), F.col(f"plays_{i}").alias("plays"), F.col(f"spends_{i}").alias("spends"))
        for i, p in enumerate(periods)
    ]
    rows = usage.where(F.col("app").isNotNull()).select("user_id", "app", F.inline(F.array(*cells)))
    return rows.where("plays + spends > 0").select("period", "user_id", "app", "plays", "spends")


def app_counts(activity: DataFrame, periods: Sequence[Period]) -> DataFrame:
    """Play and spend rows per period, user and app straight from the log."""
    return period_counts(app_usage(activity.where(in_any("dt", periods)), periods), periods)


def user_volumes(counts: DataFrame) -> DataFrame:
    """Breadth (apps) and volume (log rows) per period and user, for plays and spends and, as ``n_rows``, in all."""
    return (
        counts.groupBy(*USER_KEYS)
        .agg(
            F.expr("count_if(plays > 0)").alias("play_apps"),
            F.expr("sum(plays)").alias("play_total"),
            F.expr("count_if(spends > 0)").alias("spend_apps"),
            F.expr("sum(spends)").alias("spend_total"),
        )
        .withColumn("n_rows", F.expr("play_total + spend_total"))
    )


def _by_source(rows: DataFrame, *carried: str, volume: str | None = None) -> DataFrame:
    """Unfold play and spend columns into a row each, dropping empty counts.

    ``volume`` names a per-user column to take along, ``total`` or ``apps``.
    """

    def side(label: str, name: str) -> str:
        more = f", '{volume}', {name}_{volume}" if volume else ""
        return f"named_struct('source', '{label}', 'n', {name}s{more})"

    sides = F.expr(f"inline(array({side(PLAY, 'play')}, {side(SPEND, 'spend')}))")
    return rows.select(*carried, sides).where(F.col("n") > 0)


def _with_users(counts: DataFrame, users: DataFrame, hot_rows: int, pieces: int) -> DataFrame:
    """Counts joined to the volumes of their users and to ``users``, one row ``period, user_id`` per player."""
    sizes = user_volumes(counts)
    return join_per_key(
        counts, sizes.join(users, list(USER_KEYS)), USER_KEYS, "app", sizes, hot_rows=hot_rows, pieces=pieces
    )


def user_app_profile(
    counts: DataFrame, players: DataFrame, hot_rows: int = HOT_ROWS, pieces: int = PIECES
) -> DataFrame:
    """Rows ``period, user_id, source, app, n`` of every player: how often which app was played or paid for.

    ``players`` has one row ``period, user_id`` per player; spenders who never
    played in the period drop out.
    """
    rows = _with_users(counts, players.select(*USER_KEYS), hot_rows, pieces)
    return _by_source(rows, *USER_KEYS, "app").select(*USER_KEYS, "source", "app", "n")


def user_app_maps(
    counts: DataFrame, players: DataFrame, hot_rows: int = HOT_ROWS, pieces: int = PIECES
) -> DataFrame:
    """The same profile as maps from app to count, one for each period, source and group of apps.

    ``app_group`` is the first byte of the app's hash, for users of any size: a
    map holds one in 256 of a user's apps on average.
    """
    rows = _with_users(counts, players.select(*USER_KEYS), hot_rows, pieces)
    group = F.expr("CAST(conv(substring(md5(CAST(app AS STRING)), 1, 2), 16, 10) AS INT)")
    dealt = _by_source(rows, *USER_KEYS, "app").withColumn("app_group", group)
    pairs = F.collect_list(F.struct("app", "n"))
    return dealt.groupBy(*USER_KEYS, "source", "app_group").agg(F.map_from_entries(pairs).alias("counts"))


def app_users(usage: DataFrame) -> DataFrame:
    """Pairs of app and user with a play row; apps that no known user played don't occur."""
    return usage.where((F.col("plays_all") > 0) & F.col("app").isNotNull()).select("app", "user_id")


def document_frequency(pairs: DataFrame) -> DataFrame:
    """Distinct users per app. The pairs are spread over app and user, so popular apps are, too."""
    return pairs.groupBy("app").agg(F.count("user_id").alias("df"))


def corpus_size(usage: DataFrame) -> Column:
    """Number of users with a play row, as a scalar subquery."""
    return usage.where("plays_all > 0").agg(F.count_distinct("user_id")).scalar()


def segment_terms(
    counts: DataFrame, segments: DataFrame, hot_rows: int = HOT_ROWS, pieces: int = PIECES
) -> DataFrame:
    """Standardised term frequency ``stf`` per period, source, segment and app.

    Each user spreads a weight of 1 over their apps, whatever their volume.
    ``segments`` has one row ``period, user_id, seg`` per player. Shares are
    summed as whole numbers of 10^-18, so the sum does not depend on the order
    of the rows and small shares are not lost in large sums.
    """
    rows = _with_users(counts, segments, hot_rows, pieces)
    weights = _by_source(rows, "period", "seg", "app", volume="total")
    share = F.expr(f"CAST(n AS DECIMAL(19, 0)) * CAST({ONE} AS DECIMAL(19, 0)) div total").alias("share")
    shares = weights.select("period", "source", "seg", "app", share)
    total = F.sum(F.col("share").cast("decimal(28, 0)")).cast("double") / float(ONE)
    return shares.groupBy("period", "source", "seg", "app").agg(total.alias("stf"))


def weigh_terms(terms: DataFrame, frequencies: DataFrame, size: Column | int) -> DataFrame:
    """TF-IDF of terms; apps without a document frequency drop out, one of 0 gives no weight.

    No side is hinted as small: the app catalogue is not bounded, and the
    optimiser broadcasts it whenever its measured size allows.
    """
    size = size if isinstance(size, Column) else F.lit(size)
    idf = F.log2(F.try_divide(size.cast("double"), F.col("df")))
    return terms.join(frequencies, "app").withColumn("tfidf", F.col("stf") * idf)


def segment_app_tfidf(
    counts: DataFrame,
    segments: DataFrame,
    frequencies: DataFrame,
    size: Column | int,
    tags: dict[str, str] | None = None,
) -> DataFrame:
    """Weight of every app for every segment, tagged with source (``info``) and period (``pp``)."""
    weighed = weigh_terms(segment_terms(counts, segments), frequencies, size)
    pp = F.col("period")
    for name, tag in (tags or {}).items():
        pp = F.when(F.col("period") == name, F.lit(tag)).otherwise(pp)
    return weighed.select("seg", "app", "stf", "df", "tfidf", F.col("source").alias("info"), pp.alias("pp"))


def target_segment_tfidf(
    counts: DataFrame,
    segments: DataFrame,
    frequencies: DataFrame,
    size: Column | int,
    period: str,
    target: str,
    source: str = PLAY,
) -> DataFrame:
    """App weights of one segment; users outside it are dropped before any app row is weighed."""
    members = segments.where((F.col("period") == period) & (F.col("seg") == target))
    terms = segment_terms(counts.where(F.col("period") == period), members).where(F.col("source") == source)
    return weigh_terms(terms, frequencies, size).select("seg", "app", "stf", "df", "tfidf")


def segment_top_apps(tfidf: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` apps of highest weight per period, source and segment, ranked from 1.

    Spark cuts each task's share at ``n`` before the shuffle, so segments of any
    size are ranked from a few rows per task.
    """
    best = Window.partitionBy("pp", "info", "seg").orderBy(F.desc("tfidf"), "app")
    return (
        tfidf.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= n)
        .select("pp", "info", "seg", "rank", "app")
    )


def segment_top_lists(top: DataFrame) -> DataFrame:
    """The ranked apps of each segment as one array, best first; built from at most ``n`` rows each."""
    ranked = F.array_sort(F.collect_list(F.struct("rank", "app")))
    return top.groupBy("pp", "info", "seg").agg(F.transform(ranked, lambda r: r["app"]).alias("top10"))
