"""Mixing sources to target weights by pivotal rounding over a tree of blocks. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from segtide.llm.common import WORD, staging, written

#: Documents that meet in a block of the tree, on average.
BLOCK = 64


def size_in_words(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int], share: float, most: float) -> DataFrame:
    """The words that each source is to give: ``source``, ``source_size``, ``target``.

    Sources in code point order, null last, take the weights in turn and share ``share`` times
    all words by weight. Those that would give more than ``most`` times their size stop there, and the rest is
    shared again until none is above. That settles in the order of size by weight: a source stops if, with all
    before it stopped, its part of what is left is still too large. One row for each source.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # Spark compares strings by their UTF-8 bytes, which is code point order.
    turn = (F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    weighed = totals.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1)).withColumn("cap", most * F.col("source_size"))
    line = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = line.rowsBetween(W.unboundedPreceding, -1)
    after = line.rowsBetween(0, W.unboundedFollowing)
    rest = share * F.sum("source_size").over(W.partitionBy()) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    placed = weighed.withColumn("turn", F.row_number().over(line)).withColumn("level", rest / F.sum("weight").over(after)).withColumn("stops", F.col("cap") <= F.col("level") * F.col("weight"))
    # From the first source that doesn't stop on, none does and all get its level.
    level = F.min(F.when(~F.col("stops"), F.struct("turn", "level"))).over(W.partitionBy())
    return placed.withColumn("final", level["level"]).select(
        "source", "source_size", F.when(F.col("stops"), F.col("cap")).otherwise(F.col("final") * F.col("weight")).cast("double").alias("target")
    )


def _uniform(*columns: Column | str) -> Column:
    """A number in [0, 1) that depends on nothing but the columns."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 52)) / F.lit(float(1 << 52))


def _pair(state: Column, new: Column, seed: int) -> Column:
    """One pivotal step: move words between the open document and the next until one of them is settled.

    ``s * p`` words of the first and ``t * q`` of the second are due. Either words go from the
    second to the first until that is whole or this is empty, or the other way; the odds keep both
    expectations, and the sum of due words never changes.
    """
    a, b = state["open"], new
    s, p, t, q = a["size"], a["p"], b["size"], b["p"]
    to_a = F.least(s * (1 - p), t * q)
    to_b = F.least(s * p, t * (1 - q))
    forward = _uniform(a["row"], b["row"], F.lit(seed)) * (to_a + to_b) < to_b
    fills_a, empties_b = s * (1 - p) <= t * q, t * q <= s * (1 - p)
    empties_a, fills_b = s * p <= t * (1 - q), t * (1 - q) <= s * p
    new_p = F.when(forward, F.when(fills_a, 1.0).otherwise(p + t * q / s)).otherwise(F.when(empties_a, 0.0).otherwise(p - t * (1 - q) / s))
    new_q = F.when(forward, F.when(empties_b, 0.0).otherwise(q - s * (1 - p) / t)).otherwise(F.when(fills_b, 1.0).otherwise(q + s * p / t))
    clip = lambda x: F.greatest(F.least(x, F.lit(1.0)), F.lit(0.0))
    x = F.struct(a["row"].alias("row"), s.alias("size"), clip(new_p).alias("p"))
    y = F.struct(b["row"].alias("row"), t.alias("size"), clip(new_q).alias("p"))
    x_done = (x["p"] == 0.0) | (x["p"] == 1.0)
    settled, still = F.when(x_done, x).otherwise(y), F.when(x_done, y).otherwise(x)
    paired = F.struct(still.alias("open"), F.concat(state["done"], F.array(settled)).alias("done"))
    return F.when(a.isNull(), F.struct(new.alias("open"), state["done"].alias("done"))).otherwise(paired)


def _round(items: DataFrame, seed: int) -> DataFrame:
    """Settle all but one document of each block: ``source``, ``row``, ``size``, ``p``, ``open``."""
    kind = "struct<row: bigint, size: double, p: double>"
    start = F.struct(F.lit(None).cast(kind).alias("open"), F.array().cast(f"array<{kind}>").alias("done"))
    blocks = items.groupBy("source", "block").agg(F.sort_array(F.collect_list(F.struct("order", F.struct("row", "size", "p").alias("item")))).alias("items"))
    folded = blocks.select("source", F.aggregate(F.col("items.item"), start, lambda state, new: _pair(state, new, seed)).alias("r"))
    last = F.col("r.open")
    ended = (last["p"] == 0.0) | (last["p"] == 1.0)
    rows = F.concat(F.transform("r.done", lambda x: F.struct(x.alias("item"), F.lit(False).alias("open"))), F.array(F.struct(last.alias("item"), (~ended).alias("open"))))
    return folded.select("source", F.inline(rows)).select("source", "item.*", "open")


def copies(sizes: DataFrame, goals: DataFrame, seed: int = 0) -> DataFrame:
    """Copies of each document: ``row``, ``copies`` for ``row``, ``source``, ``size`` and the targets of sources.

    A source's documents are due ``target / source_size`` copies each. The whole part is certain; fractions are
    paired in small blocks by hash, so a hot source is spread over many, and the one left of each block goes to the next
    level of the tree, until a source has one left, which is drawn. So a source's words miss its target by less
    than one document. All draws are hashes of ids: reruns agree.
    """
    with staging(sizes.sparkSession):
        renamed = goals.withColumnRenamed("source", "goal_source")
        due = sizes.join(renamed, F.col("source").eqNullSafe(F.col("goal_source"))).select(
            "row", "source", F.col("size").cast("double").alias("size"), F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("rate")
        )
        due = due.withColumn("whole", F.floor("rate")).withColumn("p", F.col("rate") - F.col("whole"))
        settled = due.select("row", F.col("whole").cast("int").alias("copies"))
        still = due.filter((F.col("p") > 0) & (F.col("size") > 0)).select("source", "row", "size", "p")
        largest, level = still.groupBy("source").count().agg(F.max("count")).first()[0] or 0, 0
        while largest:
            blocks = -(-largest // BLOCK)
            items = still.withColumn("order", F.xxhash64("row", F.lit(seed + level))).withColumn("block", F.pmod(F.xxhash64("row", F.lit(-1 - seed - level)), F.lit(blocks)))
            result = written(_round(items, seed + level), "mixing")
            settled = settled.unionByName(result.filter(~F.col("open")).select("row", F.col("p").cast("int").alias("copies")))
            still = result.filter("open").select("source", "row", "size", "p")
            if blocks == 1:
                settled = settled.unionByName(still.select("row", (_uniform("row", F.lit(seed)) < F.col("p")).cast("int").alias("copies")))
            largest, level = (blocks if blocks > 1 else 0), level + 1
        return written(settled.groupBy("row").agg(F.sum("copies").cast("int").alias("copies")), "mixing-copies", outlives=True)


def _row(*columns: str) -> Column:
    return F.xxhash64(*columns)


def shares(df: DataFrame, weights: Sequence[int], share: float, most: float, row: str = "doc_id", text: str = "text", source: str = "source", seed: int = 0) -> DataFrame:
    """What the mix takes of each row: the column ``row``, ``size``, ``source_size``, ``target``, ``copies`` and ``taken`` words.

    Texts without words, null ones too, have size 0 and are never taken; a null source is a source like others, last in
    order. Rows that repeat an id with another text are documents of their own; those that repeat id, source and text are drawn
    together, each with as many copies. Null ids are told apart by text. An empty table gives an empty result.

    The text is read once and never shuffled.
    """
    named = df.select(F.col(row).alias("id"), F.col(source).alias("source"), F.col(text).alias("text"))
    rows = written(named.select("id", _row("id", "source", "text").alias("row"), "source", size_in_words("text").alias("size")), "mixing-sizes")
    goals = written(targets(rows, weights, share, most), "mixing-targets")
    drawn = copies(rows.groupBy("row", "source").agg(F.sum("size").alias("size")), goals, seed)
    joined = rows.join(drawn, "row").join(goals.withColumnRenamed("source", "goal_source"), F.col("source").eqNullSafe(F.col("goal_source")))
    return joined.select(F.col("id").alias(row), "size", "source_size", "target", F.when(F.col("size") > 0, F.col("copies")).otherwise(0).alias("copies")).withColumn("taken", F.col("copies") * F.col("size"))


def mix(df: DataFrame, weights: Sequence[int], share: float, most: float, row: str = "doc_id", text: str = "text", source: str = "source", seed: int = 0) -> DataFrame:
    """The mixed rows themselves, as often as they are taken, with the input's columns; see ``shares``."""
    key = _row(row, source, text)
    rows = written(df.select(key.alias("row"), F.col(source).alias("source"), size_in_words(text).alias("size")), "mixing-sizes")
    goals = written(targets(rows, weights, share, most), "mixing-targets")
    drawn = copies(rows.groupBy("row", "source").agg(F.sum("size").alias("size")), goals, seed).filter("copies > 0")
    data = df.select(F.struct(*[F.col(c) for c in df.columns]).alias("data"), key.alias("row"), size_in_words(text).alias("size")).filter("size > 0")
    repeated = data.join(drawn, "row").select("data", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return repeated.select("data.*")
