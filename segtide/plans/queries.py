"""Every registered query, wired to the order book.

Calendar years stand for the periods and months of the logs. The thresholds are
chosen for that data; the operators keep their own defaults.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segtide.operators import activity, affinity, features, migration, quadrants, ranking, scoring
from segtide.periods import Period
from segtide.sources.order_logs import read_activity, read_categories
from segtide.sources.staging import written

P1, P2, P3 = (Period.year(y) for y in (1997, 1998, 1999))
PERIODS = (P1, P2, P3)
MONTHS = tuple(Period.year(y) for y in range(1996, 2002))

CATEGORY = "F"
DIVISOR = 1
MOVED = ("L0-C0", "L2-C3")
QUADRANT = {"x": 2, "y": 1250}
RECENCY_CUTS = tuple(date(y, 1, 1) for y in range(1998, 2002))
FREQUENCY_CUTS = (5, 10, 15, 20)
MONETARY_CUTS = (1000, 3000, 6000, 10000)
SAMPLE_ORIGIN = date(1996, 1, 1)
SAMPLE_SIZE = 500
SAMPLE_SEED = "knn"
TARGET = "R1F2M3"
TAGS = {P1.name: "p1", P2.name: "p2"}

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(run: Query) -> Query:
    REGISTRY[run.__name__] = run
    return run


def _rows(spark: SparkSession, sf_dir: str, periods=PERIODS, spends_only: bool = False) -> DataFrame:
    return activity.user_periods(read_activity(spark, sf_dir, periods, spends_only), periods)


@query
def distinct_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity.distinct_categories(read_categories(spark, sf_dir))


@query
def login_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity.login_days(read_activity(spark, sf_dir).where(F.col("category") == CATEGORY))


@query
def spend_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity.spend_totals(read_activity(spark, sf_dir, spends_only=True))


@query
def login_spend_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return migration.login_spend_segments(_rows(spark, sf_dir, (P1,)), P1.name, DIVISOR)


@query
def segment_migration_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return migration.segment_migration(_rows(spark, sf_dir, (P1, P2)), P1.name, P2.name, DIVISOR)


def _shown(rows: DataFrame, *columns: str) -> DataFrame:
    """Round what is shown, after all ordering and ranking."""
    return rows.withColumns({c: F.round(c, 6) for c in columns})


def _moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return migration.migration_summary(segment_migration_users(spark, sf_dir))


@query
def segment_migration_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_moves(spark, sf_dir), "l_c_per_user", "l_logc_per_user")


@query
def segment_migration_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(migration.top_moves(_moves(spark, sf_dir)), "l_c_per_user", "l_logc_per_user")


@query
def segment_migration_bottom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(migration.bottom_moves(_moves(spark, sf_dir)), "l_c_per_user", "l_logc_per_user")


@query
def segment_migration_drilldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return migration.moved_users(segment_migration_users(spark, sf_dir), *MOVED)


@query
def monthly_spend_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quadrants.monthly_spend(_rows(spark, sf_dir, PERIODS, spends_only=True))


@query
def spend_profile_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quadrants.spend_stats(quadrants.monthly_spend(_rows(spark, sf_dir, (P1,), spends_only=True)), P1.name)


@query
def quadrant_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    months = quadrants.monthly_spend(_rows(spark, sf_dir, (P3,), spends_only=True))
    return quadrants.quadrant_distribution(months, P3.name, **QUADRANT)


@query
def quadrant_migration(spark: SparkSession, sf_dir: str) -> DataFrame:
    months = quadrants.monthly_spend(_rows(spark, sf_dir, (P2, P3), spends_only=True))
    return quadrants.quadrant_migration(months, P2.name, P3.name, **QUADRANT)


@query
def quadrant_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quadrants.quadrant_stability(
        monthly_spend_profile(spark, sf_dir), [p.name for p in PERIODS], **QUADRANT
    )


@query
def monthly_spend_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.monthly_spend_wide(
        _rows(spark, sf_dir, MONTHS, spends_only=True), [m.name for m in MONTHS]
    )


@query
def rfm_profile_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.rfm_profile_stats(scoring.totals_of_months(monthly_spend_wide(spark, sf_dir), len(MONTHS)))


@query
def user_rfm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = scoring.spender_totals(read_activity(spark, sf_dir, MONTHS, spends_only=True), MONTHS)
    return scoring.user_rfm_scores(totals, RECENCY_CUTS, FREQUENCY_CUTS, MONETARY_CUTS)


@query
def recency_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.recency_distribution(user_rfm_scores(spark, sf_dir))


@query
def score_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score_distribution(user_rfm_scores(spark, sf_dir))


@query
def rfm_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.rfm_cells(user_rfm_scores(spark, sf_dir))


@query
def rfm_final_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(scoring.final_rank_table(rfm_cells(spark, sf_dir)), "arppu")


@query
def rf_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(scoring.rf_matrix(rfm_cells(spark, sf_dir)), "arppu")


@query
def mf_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(scoring.mf_matrix(rfm_cells(spark, sf_dir)), "arppu")


@query
def rfm_training_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scores are written once: the draw looks at them twice, the log is read once."""
    scores = written(user_rfm_scores(spark, sf_dir), "scores")
    return scoring.training_sample(scores, SAMPLE_ORIGIN, SAMPLE_SIZE, SAMPLE_SEED)


@query
def user_engagement_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity.engagement_wide(_rows(spark, sf_dir, (P1, P2)), P1.name, P2.name)


@query
def payer_engagement_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity.payer_engagement_wide(_rows(spark, sf_dir, (P1, P2)), P1.name, P2.name)


@query
def engagement_sanity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity.engagement_sanity(user_engagement_wide(spark, sf_dir))


@query
def period_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity.period_activity(_rows(spark, sf_dir))


@query
def period_zero_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity.zero_activity(period_activity(spark, sf_dir))


@query
def period_user_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity.user_count(period_activity(spark, sf_dir))


@query
def user_period_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity.period_map_rows(activity.period_map(period_activity(spark, sf_dir)))


@query
def user_period_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity.period_cell(activity.period_map(period_activity(spark, sf_dir)), P1.name)


@query
def user_rfm_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.user_rfm_labels(_rows(spark, sf_dir), PERIODS)


def _app_counts_and_players(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    log = read_activity(spark, sf_dir, PERIODS)
    return affinity.app_counts(log, PERIODS), activity.players(activity.user_periods(log, PERIODS))


@query
def user_app_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return affinity.user_app_profile(*_app_counts_and_players(spark, sf_dir))


@query
def user_app_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    maps = affinity.user_app_maps(*_app_counts_and_players(spark, sf_dir))
    entries = F.expr("transform(array_sort(map_entries(counts)), e -> concat(e.key, ':', e.value))")
    return maps.select("period", "user_id", "source", "app_group", F.array_join(entries, ",").alias("counts"))


@query
def app_document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return affinity.document_frequency(affinity.app_users(affinity.app_usage(read_activity(spark, sf_dir))))


def _tfidf_inputs(spark: SparkSession, sf_dir: str, periods) -> tuple:
    """Two reads of the log: all of it for the usage, which is written once, and the periods for the labels."""
    usage = written(affinity.app_usage(read_activity(spark, sf_dir), periods), "app-usage")
    return (
        affinity.period_counts(usage, periods),
        scoring.labelled(_rows(spark, sf_dir, periods), periods),
        affinity.document_frequency(affinity.app_users(usage)),
        affinity.corpus_size(usage),
    )


def _weights(spark: SparkSession, sf_dir: str, periods=(P1, P2)) -> DataFrame:
    return affinity.segment_app_tfidf(*_tfidf_inputs(spark, sf_dir, periods), tags=TAGS)


@query
def segment_app_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_weights(spark, sf_dir), "stf", "tfidf")


@query
def target_segment_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = affinity.target_segment_tfidf(*_tfidf_inputs(spark, sf_dir, (P1,)), P1.name, TARGET)
    return _shown(weights, "stf", "tfidf")


@query
def segment_top_apps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return affinity.segment_top_apps(_weights(spark, sf_dir))


@query
def segment_top_apps_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = affinity.segment_top_lists(segment_top_apps(spark, sf_dir))
    return lists.withColumn("top10", F.array_join(F.col("top10").cast("array<string>"), ","))


@query
def user_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels, details = _labels_and_details(spark, sf_dir)
    return features.user_features(labels, details)


def _labels_and_details(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Labels and first-period details from one reading of the log, written once as both need it."""
    rows = written(features.period_details(read_activity(spark, sf_dir, PERIODS), PERIODS), "user-periods")
    return scoring.user_rfm_labels(rows, PERIODS), features.details_of_period(rows, P1, max(p.n_days for p in PERIODS))


@query
def user_feature_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = features.user_feature_row(*_labels_and_details(spark, sf_dir))
    return found.withColumns({c: F.array_join(F.col(c).cast("array<string>"), ",") for c in ("play_gaps", "spend_gaps")})


@query
def user_gap_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    gaps = features.gap_arrays(features.active_words(read_activity(spark, sf_dir, PERIODS), P1, PERIODS))
    return gaps.withColumns(
        {c: F.array_join(F.col(c).cast("array<string>"), ",") for c in ("play_gaps", "spend_gaps")}
    )


@query
def user_active_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.day_rows(read_activity(spark, sf_dir, (P1,)), P1)


@query
def visit_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.visit_gaps(features.active_words(read_activity(spark, sf_dir, (P1,)), P1))


@query
def combined_rank(spark: SparkSession, sf_dir: str, period: Period = P1, source: str = affinity.PLAY) -> DataFrame:
    """The top lists of one period and source; labels and counts of other periods are not computed."""
    lists = affinity.segment_top_apps(_weights(spark, sf_dir, (period,)).where(F.col("info") == source))
    return _shown(ranking.combined_rank(ranking.list_rows(lists)), "score")
