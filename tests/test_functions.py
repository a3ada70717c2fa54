"""Days, gaps and periods."""

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from segtide.functions import days
from segtide.periods import Period, check_disjoint, period_index, period_name


def dates(*texts):
    return [date.fromisoformat(t) for t in texts]


def test_date_gaps(spark):
    # The dates of user 1 and their gaps.
    rows = [
        (1, dates("2013-03-30", "2013-04-01", "2013-04-20")),
        (2, dates("2013-03-30")),
        (3, []),
        (4, None),
    ]
    df = spark.createDataFrame(rows, "id int, d array<date>")
    got = {r.id: r.g for r in df.select("id", days.date_gaps(F.col("d")).alias("g")).collect()}
    assert got == {1: [2, 19], 2: [], 3: [], 4: None}


@pytest.mark.parametrize("n_days", [1, 31, 64, 65, 92, 366])
def test_distinct_days_equals_count_distinct(spark, n_days):
    offsets = sorted({0, n_days - 1, n_days // 2, *range(0, n_days, 7)})
    rows = [(g, o, (g + o) % 3 > 0) for g in (1, 2) for o in offsets for _ in range(2)]
    df = spark.createDataFrame([*rows, (3, 0, False)], "g int, o int, f boolean")
    got = df.groupBy("g").agg(
        days.distinct_days("f", "o", n_days).alias("bits"), F.expr("count(DISTINCT o) FILTER (WHERE f)").alias("exact")
    )
    assert all(r.bits == r.exact for r in got.collect())


def test_dates_of_words(spark):
    rows = [(1, 0, True), (1, 63, True), (1, 64, True), (1, 89, True), (1, 5, False), (2, 7, False), (1, 90, True), (1, -1, True), (1, 64, True)]
    df = spark.createDataFrame(rows, "g int, o int, f boolean")
    words = df.groupBy("g").agg(*days.day_words("f", "o", 90, "w"))
    found = words.select("g", days.word_array("w", 90).alias("w"), days.any_day("w", 90).alias("any"))
    rows = found.select("g", "any", days.dates_of_words(F.col("w"), date(2013, 1, 1)).alias("d"), days.gaps_of_words(F.col("w")).alias("gaps")).collect()
    assert {r.g: (r.any, r.gaps) for r in rows} == {1: (True, [63, 1, 25]), 2: (False, [])}
    got = {r.g: r.d for r in rows}
    assert got == {1: [date(2013, 1, 1) + timedelta(days=k) for k in (0, 63, 64, 89)], 2: []}


def test_day_numbers(spark):
    """All bits, the sign bit too, words without days in between, and no words at all."""
    sets = [[], [0], [63], [127, 128], list(range(192)), [5, 64, 190], [*range(0, 192, 9)], None]
    as_word = lambda w: w - 2**64 if w >= 2**63 else w
    rows = [(i, None if s is None else [as_word(sum(1 << d % 64 for d in s if d // 64 == k)) for k in range(3)]) for i, s in enumerate(sets)]
    df = spark.createDataFrame(rows, "i int, w array<bigint>").select("i", days.day_numbers(F.col("w")).alias("d"), days.gaps_of_words(F.col("w")).alias("g"))
    for r in df.collect():
        expected = sets[r.i]
        assert r.d == expected
        assert r.g == (None if expected is None else [b - a for a, b in zip(expected, expected[1:])])


def test_periods(spark):
    a, b = Period("it's", date(2013, 1, 1), date(2013, 3, 31)), Period("b", date(2013, 7, 1), date(2013, 8, 31))
    rows = [(d,) for d in dates("2012-12-31", "2013-01-01", "2013-03-31", "2013-04-01", "2013-08-31")]
    df = spark.createDataFrame(rows, "dt date").withColumn("i", period_index("dt", [a, b]))
    assert [r.i for r in df.collect()] == [-1, 0, 0, -1, 1]
    named = df.select(period_name("i", [a, b]).alias("n"))
    assert [r.n for r in named.collect()] == ["", "it's", "it's", "", "b"]
    assert a.n_days == 90


def test_overlaps_are_refused():
    a = Period.year(1997)
    with pytest.raises(ValueError):
        check_disjoint([a, Period("x", a.end, a.end + timedelta(days=3))])
    with pytest.raises(ValueError):
        check_disjoint([a, Period.year(1998, a.name)])
    with pytest.raises(ValueError):
        check_disjoint([])
    with pytest.raises(ValueError):
        Period("x", date(2013, 1, 2), date(2013, 1, 1))
