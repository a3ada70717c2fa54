"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import os
import shutil
import tempfile
from collections.abc import Callable, Iterator
from contextlib import suppress
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from segtide.sources.staging import staging, written

__all__ = ["LAST", "WORD", "add_columns", "give_back", "in_portions", "in_small_batches", "lean", "read", "ship", "single_threaded", "staging", "text_bytes", "width", "words", "written"]

#: What separates words.
WORD = r"[^\x20\x09-\x0D]+"

#: A null id sorts behind every other id inside the operators.
LAST = 2**63 - 1

#: Bytes of rows that travel to a Python worker at a time.
BATCH = 4_000_000


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers once for each application, as they may not have it installed."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        package = Path(__file__).resolve().parents[1]
        archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='segtide-')}/{package.name}", "zip", package.parent, package.name)
        context.addPyFile(archive)
        _shipped.add(context.applicationId)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_bytes(column: str) -> Column:
    """The text in UTF-8, empty for null; Python then splits and lower-cases ASCII without decoding."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def words(column: str | Column) -> Column:
    """The words of a text as an array, empty for null."""
    column = F.col(column) if isinstance(column, str) else column
    return F.regexp_extract_all(F.coalesce(column, F.lit("")), F.lit(WORD), F.lit(0))


def width(spark: SparkSession, amount: float, each: float) -> int:
    """Partitions so that each holds about ``each`` of ``amount``, at least the session's shuffle width."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), int(amount // each) + 1)


def single_threaded() -> None:
    """Keep native tokenizers from starting a thread per core inside each task."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ["RAYON_NUM_THREADS"] = "1"


def in_small_batches(spark: SparkSession) -> None:
    """From now on rows travel to the session's Python workers about ``BATCH`` bytes at a time.

    Spark's own bounds are 10,000 rows and 64 MB. Each running task holds a batch outside the heap, twice while it grows, and its worker
    holds it again; what an executor took for that it keeps.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH))


def give_back() -> None:
    """Return what a task has freed to the system: workers live on for the next stages, where it would count on top of theirs."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def lean(run: Callable) -> Callable:
    """A worker's function over batches, or over one table, that gives its memory back once it is through."""

    def over(given):
        if isinstance(given, pa.Table):
            found = run(given)
            give_back()
            return found
        return through(given)

    def through(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return over


def in_portions(texts: pa.Array, most: int = 4_000_000) -> Iterator[tuple[int, list[bytes]]]:
    """Portions of a batch of texts with about ``most`` bytes each, with the row where each starts."""
    at, held, size = 0, [], 0
    for text in texts:
        held.append(text.as_py())
        size += len(held[-1])
        if size >= most:
            yield at, held
            at, held, size = at + len(held), [], 0
    if held:
        yield at, held


def add_columns(
    df: DataFrame, text: str, make: Callable[[], Callable[[list[bytes]], list[list]]], fields: dict[str, tuple[T.DataType, pa.DataType]], keep: list[str], portion: int = 4_000_000
) -> DataFrame:
    """The columns ``keep``, and columns computed from each row's whole text (UTF-8, empty for null) by a worker that ``make`` builds once a task.

    Columns are named by position inside, so that no name of the input clashes. The worker gets about ``portion`` bytes of texts at a time.
    """
    rows = df.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], text_bytes(text).alias("text"))
    schema = T.StructType([*rows.schema.fields[:-1], *[T.StructField(f"n{i}", kind) for i, (kind, _) in enumerate(fields.values())]])
    arrow = [kind for _, kind in fields.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            kept = batch.columns[:-1]
            for at, texts in in_portions(batch.column(len(kept)), portion):
                found = [pa.array(values, kind) for values, kind in zip(work(texts), arrow, strict=True)]
                yield pa.RecordBatch.from_arrays([*[c.slice(at, len(texts)) for c in kept], *found], schema.names)

    found = rows.mapInArrow(lean(run), schema)
    return found.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], *[F.col(f"n{i}").alias(c) for i, c in enumerate(fields)])
