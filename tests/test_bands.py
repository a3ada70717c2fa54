"""Band edges of both conventions."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from segtide.functions import bands


def apply(spark, build, schema, rows):
    df = spark.createDataFrame(rows, schema)
    return [r[0] for r in df.select(build(*[F.col(c) for c in df.columns])).collect()]


CASES = {
    "login": (
        bands.login_class,
        {0: None, 1: "L1", 3: "L1", 4: "L2", 7: "L2", 8: "L3", 14: "L3", 15: "L4", 24: "L4", 25: "L5", None: None},
    ),
    "spend": (
        bands.spend_class,
        {None: "C1", -1: None, 0: None, 1: "C2", 499: "C2", 500: "C3", 1999: "C3", 2000: "C4", 9999: "C4", 10000: "C5"},
    ),
    "frequency score": (
        lambda c: bands.score(c, bands.FREQUENCY_CUTS),
        {9: 1, 10: 2, 30: 3, 80: 4, 149: 4, 150: 5, None: None},
    ),
    "monetary score": (
        lambda c: bands.score(c, bands.MONETARY_CUTS),
        {499: 1, 500: 2, 2500: 3, 10000: 4, 49999: 4, 50000: 5},
    ),
    "recency label": (
        bands.recency_label,
        {
            None: "R999", -1: "R999", 0: "R5", 7: "R5", 8: "R4", 14: "R4", 15: "R3", 21: "R3", 22: "R2",
            30: "R2", 31: "R1", 90: "R1", 91: "R0",
        },
    ),
    "frequency label": (
        bands.frequency_label,
        {0: "F0", 1: "F1", 3: "F1", 4: "F2", 7: "F2", 8: "F3", 14: "F3", 15: "F4", 25: "F4", 26: "F5", -1: None},
    ),
    "monetary label": (
        bands.monetary_label,
        {-1: None, 0: "M1", 1: "M2", 500: "M2", 501: "M3", 2000: "M3", 2001: "M4", 10000: "M4", 10001: "M5"},
    ),
}


@pytest.mark.parametrize("name", CASES)
def test_bands(spark, name):
    build, expected = CASES[name]
    assert apply(spark, build, "x bigint", [(k,) for k in expected]) == list(expected.values())


def test_recency_score(spark):
    days = ["2013-02-28", "2013-03-01", "2013-04-01", "2013-05-01", "2013-05-31", "2013-06-01"]
    rows = [(date.fromisoformat(d),) for d in days]
    got = apply(spark, lambda c: bands.score(c, bands.RECENCY_CUTS), "x date", rows)
    assert got == [1, 2, 3, 4, 4, 5]


def test_conventions_differ_at_the_same_edge(spark):
    assert apply(spark, bands.spend_class, "x bigint", [(500,)]) == ["C3"]
    assert apply(spark, bands.monetary_label, "x bigint", [(500,)]) == ["M2"]


def test_quadrant(spark):
    got = apply(spark, bands.quadrant, "n bigint, c bigint", [(14, 7901), (13, 7901), (14, 7900), (13, 7900)])
    assert got == ["C1", "C2", "C3", "C4"]


def test_stability(spark):
    rows = [("C1", "C1", "C1"), ("C1", "no", "no"), ("C1", "no", "C1"), ("C1", "C2", "C1")]
    assert apply(spark, bands.stability, "a string, b string, c string", rows) == ["kotei", "churn", "move", "move"]


def test_labels_of_known_users(spark):
    rows = [
        (45, 1, 0), (83, 1, 0), (8, 1, 0), (59, 1, 0), (9, 49, 0), (66, 2, 0), (0, 88, 5500), (5, 9, 0),
    ]
    expected = ["R1F1M1", "R1F1M1", "R4F1M1", "R1F1M1", "R4F5M1", "R1F1M1", "R5F5M4", "R5F3M1"]
    assert apply(spark, bands.rfm_label, "d bigint, f bigint, m bigint", rows) == expected
    assert apply(spark, bands.rfm_label, "d bigint, f bigint, m bigint", [(3, 1, -5)]) == [None]


def test_scores_as_text_and_rank(spark):
    rows = [(5, 5, 5), (1, 1, 1), (None, 2, 3)]
    assert apply(spark, bands.score_label, "r int, f int, m int", rows) == ["5_5_5", "1_1_1", None]
    assert apply(spark, bands.final_rank, "r int, f int, m int", rows) == [1, 13, None]
