"""Quality rules whose thresholds come from quantile sketches of each language and source. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from segtide.llm.common import words, written

#: Symbols, and the base rules.
SYMBOLS, MIN_WORDS, MAX_REPEATED_PERCENT, WINDOW = r"[#*$%&|<>]", 10, 20, 5
#: Sketches sort values into whole bins, ``BINS`` and one more at most, so they merge by adding counts; rates are per mille, word length in tenths.
RATES, BINS = ("symbol_rate", "dup_line_rate", "repeat_rate", "word_length"), 1000
#: Rates whose sketch has all texts; repeated lines and words are judged among the texts that have any.
OF_ALL = ("symbol_rate", "word_length")
#: A fence stands so many interquartile ranges from the quartile; the length of words spreads widely in short texts.
SPREAD = {"symbol_rate": 3, "dup_line_rate": 3, "repeat_rate": 3, "word_length": 6}
#: Texts that a sketch needs for fences that are wholly its own.
ENOUGH = 50


def base_counts(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Counts of each whole text: words, their characters, symbols, repeated lines, words in repeated windows."""
    keep = [] if keep is None else keep
    names = [f"_k{i}" for i in range(len(keep))]
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(whole, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    parts = df.select(
        *[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)],
        F.transform(words(text), lambda w: F.xxhash64(w)).alias("_words"),
        F.length(F.regexp_replace(whole, r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        (F.length(whole) - F.length(F.regexp_replace(whole, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("_lines"),
    )
    windowed = parts.select(
        *names,
        F.size("_words").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.transform(
            F.slice("_words", 1, F.greatest(F.size("_words") - (WINDOW - 1), F.lit(0))),
            lambda w, i: F.xxhash64(w, *[F.get("_words", i + k) for k in range(1, WINDOW)]),
        ).alias("_windows"),
    )
    # Few texts repeat a window; only theirs are sorted.
    repeats = F.size(F.array_distinct("_windows")) < F.size("_windows")
    placed = F.when(repeats, F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("at")))))
    sorted_ = windowed.withColumn("_sorted", placed).drop("_windows")
    starts = sorted_.withColumn("_starts", F.sort_array(F.transform(_twice(), lambda x: x["at"]))).drop("_sorted")
    covered = F.aggregate(
        F.transform("_starts", lambda at, i: F.least(F.coalesce(F.get("_starts", i + 1), at + WINDOW) - at, F.lit(WINDOW))),
        F.lit(0),
        lambda total, x: total + x,
    )
    return starts.select(
        *[F.col(n).alias(c) for c, n in zip(keep, names, strict=True)],
        "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines",
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def _twice() -> Column:
    """Of the sorted windows, those that equal a neighbour."""

    def same(x: Column, i: Column) -> Column:
        return F.get("_sorted", i)["h"].eqNullSafe(x["h"])

    return F.filter("_sorted", lambda x, i: ((i > 0) & same(x, i - 1)) | same(x, i + 1))


def _rates() -> dict[str, Column]:
    share = lambda a, b: F.expr(f"CASE WHEN {b} > 0 THEN (1000 * {a}) div {b} ELSE 0 END")
    return {
        "symbol_rate": share("n_symbols", "word_chars"),
        "dup_line_rate": share("n_dup_lines", "n_lines"),
        "repeat_rate": share("n_repeat_words", "n_words"),
        "word_length": F.expr(f"CASE WHEN n_words > 0 THEN least((10 * word_chars) div n_words, {BINS}) ELSE 0 END"),
    }


def sketches(counts: DataFrame, lang: str, source: str) -> DataFrame:
    """A quantile sketch of each rate for each language and source: texts by bin. Sketches of parts merge by adding."""
    rates = counts.select(F.col(lang).alias("lang"), F.col(source).alias("source"), F.explode(F.array(*[F.struct(F.lit(n).alias("rate"), c.alias("bin")) for n, c in _rates().items()])).alias("r"))
    some = rates.filter((F.col("r.bin") > 0) | F.col("r.rate").isin(*OF_ALL))
    return some.groupBy("lang", "source", "r.rate", "r.bin").agg(F.count("*").alias("n"))


def own_fences(sketch: DataFrame, *by: str) -> DataFrame:
    """For each group and rate the texts in its merged sketch, its quartiles and the fences that follow from it alone.

    Fences stand ``SPREAD`` interquartile ranges beyond the quartiles; a range is one bin and a twentieth of the quartile at least, for groups of texts all alike. For a rate that three
    quarters of the texts don't have at all, the fence stands halfway to the lower quartile of those that have it.
    """
    merged = sketch.groupBy(*by, "rate", "bin").agg(F.sum("n").alias("n"))
    group = W.partitionBy(*by, "rate")
    running = merged.select(*by, "rate", "bin", "n", F.sum("n").over(group.orderBy("bin")).alias("upto"), F.sum("n").over(group).alias("total"))

    def first(reached: Column, value: str) -> Column:
        return F.min(F.when(reached, F.col(value))).over(group)

    lower, upper = F.col("upto") * 4 >= F.col("total"), F.col("upto") * 4 >= F.col("total") * 3
    placed = running.withColumns({"q1": first(lower, "bin"), "q3": first(upper, "bin"), "after": first(upper, "upto")})
    found = placed.groupBy(*by, "rate").agg(
        *[F.max(c).alias(c) for c in ("total", "q1", "q3")],
        F.min(F.when((F.col("bin") > F.col("q3")) & ((F.col("upto") - F.col("after")) * 4 >= F.col("total") - F.col("after")), F.col("bin"))).alias("above"),
    )
    spread = F.create_map(*[F.lit(x) for pair in SPREAD.items() for x in pair])[F.col("rate")] * F.expr("greatest(q3 - q1, q3 div 20, 1)")
    high = F.when(F.expr("q3 > 0"), F.col("q3") + spread).otherwise(F.expr("coalesce(above, 0) div 2"))
    low = F.col("q1") - spread
    return found.select(*by, "rate", "total", "q1", "q3", high.alias("high"), low.alias("low"))


def _shrunk(own: str, wider: str) -> Column:
    """A group's own fence if its sketch has enough texts, else between that and the wider group's, by how many it has."""
    return F.expr(f"(least(total, {ENOUGH}) * {own} + ({ENOUGH} - least(total, {ENOUGH})) * {wider}) div {ENOUGH}")


def fences(sketch: DataFrame) -> DataFrame:
    """The upper and lower fence of each rate for each language and source, one row each.

    Fences of a source with fewer than ``ENOUGH`` texts in its sketch are drawn towards those of its language, and a language's towards those of all, the more
    so the fewer there are. One row for each language, source and bin at most.
    """
    renamed = lambda q, p: q.select(*[F.col(c).alias(f"{p}_{c}") for c in q.columns])
    every = own_fences(sketch).select(F.col("rate").alias("e_rate"), F.col("high").alias("e_high"), F.col("low").alias("e_low"))
    langs = own_fences(sketch, "lang").join(every, F.col("rate") == F.col("e_rate"))
    langs = renamed(langs.select("lang", "rate", _shrunk("high", "e_high").alias("high"), _shrunk("low", "e_low").alias("low")), "l")
    own = own_fences(sketch, "lang", "source")
    joined = own.join(langs, (own["rate"] == langs["l_rate"]) & own["lang"].eqNullSafe(langs["l_lang"]))
    ends = joined.select("lang", "source", "rate", _shrunk("high", "l_high").alias("high"), _shrunk("low", "l_low").alias("low"))
    columns = [F.max(F.when(F.col("rate") == r, F.col("high"))).alias(f"{r}_high") for r in RATES]
    columns.append(F.max(F.when(F.col("rate") == "word_length", F.col("low"))).alias("word_length_low"))
    return ends.groupBy("lang", "source").agg(*columns)


def judge_quality(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", keep: list[str] | None = None) -> DataFrame:
    """Counts of each text, whether a base rule fails, and whether it is kept.

    A text is kept if no base rule fails and each of its rates lies within the fences of its language and
    source. Fences are learnt from the sketches of all texts that pass the base rules, and from nothing else: no rate has a cutoff of its own. Null languages and sources
    are groups like others; null and empty texts have no words and fail; repeated rows are judged alike; an empty
    table gives an empty result. Columns in ``keep`` are carried along.

    Counts are made in one pass without a shuffle and written once, as fences and verdicts both need them. Hot
    sources are counted on the map side; only bins are shuffled. Fences have a row for each language and source, and
    Spark's own size check picks the join.
    """
    keep = [] if keep is None else keep
    rows = df.select(*[F.col(c).alias(f"_c{i}") for i, c in enumerate(keep)], F.col(lang).alias("_lang"), F.col(source).alias("_source"), F.col(text).alias("_text"))
    names = rows.columns[:-1]
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    counts = written(base_counts(rows, "_text", names).withColumn("base_failed", failed), "quality-counts")
    limits = fences(sketches(counts.filter(~F.col("base_failed")), "_lang", "_source"))
    joined = counts.join(limits, counts["_lang"].eqNullSafe(limits["lang"]) & counts["_source"].eqNullSafe(limits["source"]), "left")
    inside = F.lit(True)
    for rate, column in _rates().items():
        inside = inside & (column <= F.coalesce(F.col(f"{rate}_high"), column))
    inside = inside & (_rates()["word_length"] >= F.coalesce(F.col("word_length_low"), _rates()["word_length"]))
    return joined.select(
        *[F.col(f"_c{i}").alias(c) for i, c in enumerate(keep)],
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & inside).alias("kept"),
    )
