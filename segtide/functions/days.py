"""Distinct days of a bounded period, and gaps between days."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = 64


def distinct_days(flag: str, offset: str, n_days: int) -> Column:
    """Aggregate: number of distinct values of ``offset`` in rows where ``flag`` is true.

    ``offset`` counts days from the period's start, so the days seen fit a few
    64-bit words that merge with ``bit_or``. Unlike ``count(distinct day)`` this
    merges on the map side and needs one shuffle: every map task sends one row
    per group, however many log rows the group has.
    """
    words = _words(flag, offset, n_days)
    return F.expr("CAST(" + " + ".join(f"coalesce(bit_count({w}), 0)" for w in words) + " AS BIGINT)")


def _words(flag: str, offset: str, n_days: int) -> list[str]:
    return [
        f"bit_or(CASE WHEN {flag} AND {offset} >= {low} AND {offset} < {min(low + WORD, n_days)} "
        f"THEN shiftleft(1L, {offset} - {low}) END)"
        for low in range(0, n_days, WORD)
    ]


def day_words(flag: str, offset: str, n_days: int, prefix: str) -> list[Column]:
    """Aggregates: the days seen as 64-bit words named by the prefix and their number; 0 for none."""
    return [F.expr(f"coalesce({w}, 0L)").alias(f"{prefix}{i}") for i, w in enumerate(_words(flag, offset, n_days))]


def _positions() -> Column:
    """For each byte the positions of its set bits; a constant, folded when the query is planned."""
    rows = (", ".join(str(k) for k in range(8) if byte >> k & 1) for byte in range(256))
    return F.expr("array(" + ", ".join(f"array({row})" if row else "CAST(array() AS ARRAY<INT>)" for row in rows) + ")")


def day_numbers(words: Column) -> Column:
    """The ascending numbers of the days whose bits are set in an array of words; NULL for no array.

    Bits are looked up byte by byte, so the cost is that of the active days and
    eight look-ups for each word that has any, however long the period is.
    """
    table = _positions()

    def of_word(word: Column, number: Column) -> Column:
        def of_byte(k: int) -> Column:
            byte = F.shiftrightunsigned(word, 8 * k).bitwiseAND(F.lit(255)).cast("int")
            return F.transform(F.get(table, byte), lambda bit: number * WORD + 8 * k + bit)

        return F.when(word == 0, F.lit(None)).otherwise(F.flatten(F.array(*[of_byte(k) for k in range(WORD // 8)])))

    return F.flatten(F.array_compact(F.transform(words, of_word)))


def word_array(prefix: str, n_days: int) -> Column:
    """The words named by the prefix and their number as one array."""
    return F.array(*[F.col(f"{prefix}{i}") for i in range(-(-n_days // WORD))])


def any_day(prefix: str, n_days: int) -> Column:
    """Whether any day is set in the words named by the prefix and their number."""
    return F.expr(" | ".join(f"{prefix}{i}" for i in range(-(-n_days // WORD))) + " <> 0")


def dates_of_words(words: Column, start: date) -> Column:
    """The ascending dates whose bits are set in an array of words; number 0 is ``start``."""
    return F.transform(day_numbers(words), lambda day: F.date_add(F.lit(start), day))


def _neighbours(days: Column, between) -> Column:
    """What lies between neighbours of an ascending array; empty for fewer than two entries."""
    n = F.greatest(F.size(days) - 1, F.lit(0))
    return F.zip_with(F.slice(days, 2, n), F.slice(days, 1, n), lambda day, before: between(day, before).cast("bigint"))


def gaps_of_words(words: Column) -> Column:
    """Days between neighbouring set days of an array of words; the days are unfolded once.

    The array of day numbers is bound to a name by a transform over a single
    entry, as it is needed several times.
    """
    named = F.transform(F.array(day_numbers(words)), lambda days: _neighbours(days, lambda day, before: day - before))
    return F.get(named, F.lit(0))


def date_gaps(days: Column) -> Column:
    """Days between neighbours of an ascending array of dates; empty for fewer than two."""
    return _neighbours(days, F.datediff)
