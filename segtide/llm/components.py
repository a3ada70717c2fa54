"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segtide.llm.common import staging, written


def _lowest(pairs: DataFrame) -> DataFrame:
    """Each pair (u, v) with the smallest of u and all its partners; minima combine on the map side."""
    lowest = pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
    return pairs.join(lowest, F.col("u") == F.col("k")).drop("k")


def components(links: DataFrame) -> DataFrame:
    """``id`` and ``component_id``, the smallest id reachable, for every id in the links ``a``, ``b``; ids without links are absent.

    Rounds hang partners onto smaller and smaller ids until every component is a star; the number of rounds grows with
    the logarithm of the longest path. Links are tables in the shared folder between rounds, never on the driver.
    """
    with staging(links.sparkSession):
        edges = written(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
        before, state = None, ()
        while state != before:
            both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
            # Larger partners of u move to its smallest one, then u itself and its smaller partners do.
            large = _lowest(both).filter("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
            near = _lowest(large)
            small = near.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(near.select("u", F.col("m").alias("v"))).distinct()
            edges = written(small, "links")
            before, state = state, edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003)).first()
        stars = edges.select(F.col("u").alias("id"), F.col("v").alias("component_id"))
        centres = edges.select(F.col("v").alias("id"), F.col("v").alias("component_id")).distinct()
        return written(stars.unionByName(centres), "components", outlives=True)
