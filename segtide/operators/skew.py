"""Joins, samples and numberings that stay balanced when few keys hold most rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segtide.sources.staging import written

# A key is hot with more rows than one task should get.
HOT_ROWS = 1_000_000
PIECES = 256
# Hot keys that are split, at most: the size of the list that is broadcast.
MOST_HOT = 4096


def join_per_key(
    rows: DataFrame,
    per_key: DataFrame,
    on: Sequence[str],
    spread_by: str,
    sizes: DataFrame,
    hot_rows: int = HOT_ROWS,
    pieces: int = PIECES,
    most: int = MOST_HOT,
) -> DataFrame:
    """Inner join of many rows per key with one row per key, hot keys split into pieces.

    ``sizes`` carries ``n_rows``, the number of rows of the key or more. Hot are
    the ``most`` largest keys of those with more than ``hot_rows`` rows, so the
    broadcast list has ``most`` entries at most, whatever the data; further large
    keys are left to adaptive execution. Rows of a hot key are dealt to
    ``pieces`` slots by the hash of ``spread_by``, and only the hot rows of
    ``per_key`` are repeated.
    """
    largest = sizes.where(F.col("n_rows") > hot_rows).orderBy(F.desc("n_rows"), *on).limit(most)
    hot = F.broadcast(largest.select(*on, F.lit(True).alias("hot")))
    piece = F.pmod(F.xxhash64(spread_by), F.lit(pieces)).cast("int")
    slots = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(pieces - 1))).otherwise(F.array(F.lit(0)))

    dealt = rows.join(hot, list(on), "left").withColumn("slot", F.when(F.col("hot"), piece).otherwise(0))
    repeated = per_key.join(hot, list(on), "left").withColumn("slot", F.explode(slots)).drop("hot")
    return dealt.drop("hot").join(repeated, [*on, "slot"]).drop("slot")


def sample_rows(df: DataFrame, key: Column, n: int, seed: str = "") -> DataFrame:
    """Exactly ``n`` rows (all, if there are fewer), drawn by ``md5(key || seed)``.

    Keys must be unique and not NULL.

    The result equals ordering all rows by the hash and cutting at ``n``, but the
    rows themselves are only filtered. The first four hex digits of the hash name
    a bucket; bucket counts, 65,536 at most, tell which bucket holds the n-th
    row, and only that bucket is ranked to find the last hash that is in.
    """
    if n < 1:
        raise ValueError("a sample needs at least one row")
    draw = F.md5(F.concat(key.cast("string"), F.lit(seed)))
    # Never NULL, so that the join below adds no filter and both uses share one shuffle.
    bucket = F.coalesce(F.conv(F.substring(draw, 1, 4), 16, 10).cast("int"), F.lit(-1))
    drawn = df.select(draw.alias("draw"), bucket.alias("bucket"))
    counts = drawn.groupBy("bucket").agg(F.count("*").alias("in_bucket"))
    in_order = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    cut = (
        counts.withColumn("upto", F.sum("in_bucket").over(in_order))
        .withColumn("wanted", F.lit(n) - (F.col("upto") - F.col("in_bucket")))
        .where((F.col("upto") >= n) & (F.col("wanted") > 0))
    )
    place = F.row_number().over(Window.partitionBy("bucket").orderBy("draw"))
    last = (
        drawn.join(F.broadcast(cut), "bucket")
        .withColumn("place", place)
        .where(F.col("place") == F.col("wanted"))
        .select("draw")
        .scalar()
    )
    return df.where(last.isNull() | (draw <= last))


def number_rows(df: DataFrame, order: Sequence[Column], name: str = "place") -> DataFrame:
    """Add the place of each row, from 1, in an order of all rows, without sorting them in one task.

    Rows are sorted in ranges, which are written, and numbered inside; a range's first place follows from
    the number of rows before it. That is one row for each range, the only table that a single task
    reads. Starts a job. Rows that are equal in the order are numbered as they come.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranges = written(placed.withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_at", 33)
    counts = ranges.groupBy(part.alias("_part")).agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    before = F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    begun = counts.select("_part", (F.coalesce(before, F.lit(0)) - F.col("_first") + 1).alias("_shift"))
    found = ranges.withColumn("_part", part).join(begun, "_part")
    return found.withColumn(name, F.col("_at") + F.col("_shift")).drop("_part", "_at", "_shift")
