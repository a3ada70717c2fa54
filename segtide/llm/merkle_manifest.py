"""Merkle manifest of a table: trees of digests with interval labels, proofs by containment and interval difference."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from segtide.llm.common import staging, width, written

#: Levels that are worked out together: a block covers 2^LEVELS consecutive nodes, and one task holds a block at a time.
LEVELS = 8
#: Leaves that make one range.
RANGE = 250_000
#: The fields of a leaf in order, and which documents are tampered with.
FIELDS, EVERY = ("doc_id", "source", "lang", "n_chars", "text"), 7


def _value(column: str) -> Column:
    value = F.col(column).cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_digest(values: dict[str, Column] | None = None) -> Column:
    """The digest of a document: its fields, each behind its length, so that no two documents read alike. ``values`` stand in for fields."""
    return F.sha2(F.concat(*[(values or {}).get(c, _value(c)) for c in FIELDS]).cast("binary"), 256)


def tampered_digest(digest: Column) -> Column:
    """The digest of a document with one added to ``n_chars`` where the id's checksum says so; others, and null counts, keep theirs."""
    hit = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(EVERY)) == 0
    more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("decimal(20,0)").cast("string")
    added = F.concat(F.octet_length(more).cast("string"), F.lit(":"), more)
    return F.when(hit & F.col("n_chars").isNotNull(), leaf_digest({"n_chars": added})).otherwise(digest)


def ranked(rows: DataFrame, tree: str, order: list[str], parts: int) -> DataFrame:
    """Add ``rank``, the place of each row in its tree from 0 on, and ``n``, the rows of the tree.

    Rows are sorted by ranges over the whole table and numbered range by range, so a tree with most rows is spread over many tasks;
    the last sort column tells equal rows apart. The ranges' counts are one row for each tree and range.
    """
    placed = rows.repartitionByRange(parts, tree, *order).sortWithinPartitions(tree, *order).withColumn("_at", F.monotonically_increasing_id())
    table = written(placed.withColumn("_part", F.shiftright("_at", 33)), "merkle-ranges")
    counts = written(table.groupBy(tree, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows")), "merkle-counts")
    total = counts.groupBy(F.col(tree).alias("_tree")).agg(F.sum("_rows").alias("n"))
    before = F.sum("_rows").over(Window.partitionBy(tree).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    ranges = counts.select(F.col(tree).alias("_tree"), F.col("_part").alias("_in"), "_first", F.coalesce(before, F.lit(0)).alias("_before"))
    offsets = ranges.join(total, "_tree")
    found = table.join(offsets, (F.col(tree) == F.col("_tree")) & (F.col("_part") == F.col("_in")))
    return found.withColumn("rank", F.col("_at") - F.col("_first") + F.col("_before")).drop("_at", "_part", "_tree", "_in", "_first", "_before")


def combined(digests: list[bytes]) -> bytes:
    """The digest of a run of digests, which are read as hexadecimal text."""
    return hashlib.sha256(b"".join(d.hex().encode() for d in digests)).digest()


class Block:
    """The nodes above consecutive nodes of one level, each labelled with the interval [low, high) of ranks that it covers.

    ``levels[k]`` has the lows, highs and digests of level k in order; level 0 are the given nodes.
    """

    def __init__(self, low: int, digests: list[bytes], depth: int):
        lows = np.arange(low, low + len(digests))
        self.levels: list[tuple[np.ndarray, np.ndarray, list[bytes]]] = [(lows, lows + 1, digests)]
        for _ in range(depth):
            lows, highs, own = self.levels[-1]
            ends = np.append(highs[1::2], highs[-1:]) if len(highs) % 2 else highs[1::2]
            self.levels.append((lows[::2], ends, [combined(own[k : k + 2]) for k in range(0, len(own), 2)]))

    @property
    def top(self) -> bytes:
        return self.levels[-1][2][0]

    def paths(self) -> list[list[tuple[bytes, bool]]]:
        """For each given node the siblings on its way up: digest and whether it stands on the left; a node without one has none on that level.

        The ancestor on a level is the node whose interval contains the rank. What the parent's interval
        has beside the node's own is the sibling's.
        """
        ranks = self.levels[0][0]
        found: list[list[tuple[bytes, bool] | None]] = [[] for _ in ranks]
        for (lows, highs, digests), (above, ends, _) in zip(self.levels, self.levels[1:]):
            own = np.searchsorted(lows, ranks, side="right") - 1
            parent = np.searchsorted(above, ranks, side="right") - 1
            left = lows[own] > above[parent]
            # The difference: before the node, or behind it; empty if the node covers all of its parent.
            begin = np.where(left, above[parent], highs[own])
            empty = ~left & (highs[own] == ends[parent])
            at = np.searchsorted(lows, begin)
            for path, k, first, none in zip(found, at.tolist(), left.tolist(), empty.tolist(), strict=True):
                path.append(None if none else (digests[k], first))
        return found


def fold(digest: bytes, path: list[tuple[bytes, bool] | None]) -> bytes:
    """The digest that a node's ancestor gets along its siblings; a lone node is combined by itself."""
    for step in path:
        digest = combined([digest] if step is None else [step[0], digest] if step[1] else [digest, step[0]])
    return digest


def _packed(path: list[tuple[bytes, bool] | None]) -> bytes:
    """Steps as text: a sign for no sibling, one on the left or one on the right, and the sibling's digest."""
    return b"".join(b"-" if s is None else (b"<" if s[1] else b">") + s[0] for s in path)


def _unpacked(data: bytes) -> list[tuple[bytes, bool] | None]:
    found, at = [], 0
    while at < len(data):
        sign = data[at : at + 1]
        found.append(None if sign == b"-" else (data[at + 1 : at + 33], sign == b"<"))
        at += 1 if sign == b"-" else 33
    return found


def _depth(n: int, levels: int) -> int:
    """Levels above n nodes of a tree within a block: all of them if the tree fits one."""
    return min(levels, (n - 1).bit_length())


def _gathered(nodes: DataFrame, extra: list[str]) -> DataFrame:
    """Blocks of nodes: of ``tree, n, rank, digest`` and further columns, at most 2^LEVELS rows to a block, in order."""
    listed = F.sort_array(F.collect_list(F.struct("rank", "digest", *extra)))
    grouped = nodes.groupBy("tree", "n", F.shiftright("rank", LEVELS).alias("block")).agg(listed.alias("nodes"))
    return grouped.select("tree", "n", "block", *[F.col(f"nodes.{c}").alias(c) for c in ("digest", *extra)])


def _mapped(blocks: DataFrame, work: Callable[[dict], Iterator[tuple]], schema: T.StructType) -> DataFrame:
    """Rows that ``work`` makes of each block, a few thousand to a batch. The driver's ``LEVELS``, by which blocks were cut, goes along as ``levels``."""
    levels = LEVELS
    kinds = [pa.binary() if isinstance(f.dataType, T.BinaryType) else pa.string() if isinstance(f.dataType, T.StringType) else pa.int64() for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for k in range(batch.num_rows):
                held += work({name: batch.column(i)[k].as_py() for i, name in enumerate(batch.schema.names)} | {"levels": levels})
                if len(held) >= 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], schema.names)
                    held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], schema.names)

    return blocks.mapInArrow(run, schema)


def _tops(row: dict) -> Iterator[tuple]:
    depth = _depth(row["n"], row["levels"])
    yield row["tree"], -(-row["n"] >> row["levels"]), row["block"], Block(0, row["digest"], depth).top


def _paths(row: dict) -> Iterator[tuple]:
    first = row["block"] << row["levels"]
    block = Block(first, row["digest"], _depth(row["n"], row["levels"]))
    for k, path in enumerate(block.paths()):
        yield row["tree"], first + k, _packed(path) + row["above"], row["top"]


def _proofs(row: dict) -> Iterator[tuple]:
    block, above = Block(row["block"] << row["levels"], row["digest"], _depth(row["n"], row["levels"])), _unpacked(row["above"])
    for path, doc, digest, tampered in zip(block.paths(), row["doc"], row["digest"], row["tampered"], strict=True):
        whole = path + above
        siblings = [s[0] for s in whole if s is not None]
        yield doc, digest.hex(), row["subroot"].hex(), row["top"].hex(), combined(siblings).hex(), fold(tampered, whole).hex()


NODE = T.StructType([T.StructField("tree", T.StringType()), T.StructField("n", T.LongType()), T.StructField("rank", T.LongType()), T.StructField("digest", T.BinaryType())])
PATH = T.StructType([T.StructField("tree", T.StringType()), T.StructField("rank", T.LongType()), T.StructField("above", T.BinaryType()), T.StructField("top", T.BinaryType())])
PROOF = T.StructType([T.StructField("doc_id", T.LongType()), *[T.StructField(c, T.StringType()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")]])


def _grown(nodes: DataFrame, extra: list[str], most: int) -> tuple[list[DataFrame], DataFrame]:
    """The blocks of each band of levels from the lowest on, and the top node of each tree. ``most`` is the size of the largest tree."""
    bands = []
    while True:
        bands.append(written(_gathered(nodes, [] if bands else extra), "merkle-blocks"))
        nodes = written(_mapped(bands[-1].select("tree", "n", "block", "digest"), _tops, NODE), "merkle-nodes")
        if most <= 1 << LEVELS:
            return bands, nodes
        most = -(-most >> LEVELS)


def _joined(blocks: DataFrame, above: DataFrame) -> DataFrame:
    """Blocks with what stands above them: the node of the next band whose interval contains the block has its rank and tree."""
    ways = above.select(F.col("tree").alias("_tree"), F.col("rank").alias("_rank"), *[c for c in above.columns if c not in ("tree", "rank")])
    return blocks.join(ways, (F.col("tree") == F.col("_tree")) & (F.col("block") == F.col("_rank"))).drop("_tree", "_rank")


def manifest(df: DataFrame) -> DataFrame:
    """One row for each document: ``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``.

    Leaves of a language ascend by id, null ids first, rows of one id by their digests; languages ascend bytewise, null first. Nodes are paired up
    to one subroot a language, and subroots to the root; the last of an odd number is combined by itself. The proof are the siblings
    from leaf to root; the folded root is what the tampered leaf gives with them, and ``verified`` tells whether that is the root. Equal rows are
    leaves of their own. Null texts and counts have a mark of their own; a document without a count or id isn't tampered with. An empty table gives
    an empty result. Columns besides those five play no part, whatever they are called.

    Blocks of 256 consecutive nodes give eight levels at once, so the number of rounds is the logarithm to base 256 of the largest language, and a language
    with most documents is many blocks. Paths come down the same way: a block is joined with the path of the one node above that covers it.
    """
    spark = df.sparkSession
    with staging(spark):
        tree = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit(""))
        own = df.select(tree.alias("tree"), F.col("doc_id").cast("long").alias("doc"), leaf_digest().alias("digest"), *FIELDS)
        hashed = own.select("tree", "doc", F.unhex("digest").alias("digest"), F.unhex(tampered_digest(F.col("digest"))).alias("tampered"), F.monotonically_increasing_id().alias("copy"))
        leaves = written(hashed, "merkle-hashes")
        parts = width(spark, leaves.count(), RANGE)
        placed = ranked(leaves, "tree", ["doc", "digest", "copy"], parts).drop("copy")
        sizes = written(placed, "merkle-leaves")
        most = sizes.agg(F.max("n")).first()[0]
        if most is None:
            return spark.createDataFrame([], T.StructType([*PROOF, T.StructField("verified", T.BooleanType())]))
        bands, subroots = _grown(sizes, ["doc", "tampered"], most)

        # The languages are the leaves of one more tree.
        tops = ranked(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest"), "tree", ["name"], width(spark, 0, 1))
        tops = written(tops, "merkle-tops")
        high, root = _grown(tops, ["name"], tops.count())
        paths = root.select("tree", "rank", F.lit(b"").alias("above"), F.col("digest").alias("top"))
        for band in reversed(high):
            paths = written(_mapped(_joined(band.select("tree", "n", "block", "digest"), paths), _paths, PATH), "merkle-paths")
        named = tops.select(F.col("rank").alias("_at"), F.col("name"), F.col("digest").alias("subroot")).join(paths, F.col("_at") == F.col("rank"))
        paths = named.select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("rank"), "above", "top", "subroot")

        # Down the bands of the languages; the subroot goes along.
        known = written(paths.select("tree", "subroot"), "merkle-subroots")
        paths = paths.select("tree", "rank", "above", "top")
        for band in reversed(bands[1:]):
            paths = written(_mapped(_joined(band.select("tree", "n", "block", "digest"), paths), _paths, PATH), "merkle-paths")
        last = _joined(bands[0], paths).join(known, "tree")
        proofs = _mapped(last.select("tree", "n", "block", "digest", "doc", "tampered", "above", "top", "subroot"), _proofs, PROOF)
        return written(proofs.withColumn("verified", F.col("folded_root") == F.col("root")), "merkle-proofs", outlives=True)
