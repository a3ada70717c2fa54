"""Token counts of whole texts, huge ones in overlapping chunks that are spliced where both sides provably agree."""

from __future__ import annotations

import bisect
import json
from collections.abc import Iterator
from itertools import chain
from unicodedata import category

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from segtide.llm.common import add_columns, single_threaded, written

#: Characters of a chunk, and by how many the first round's chunks overlap.
CHUNK, OVERLAP = 65_536, 1_024
#: Distinct pieces whose counts a task remembers.
REMEMBERED = 1_000_000
#: Distinct pieces that are encoded in one line.
JOINED = 100
#: Characters at a cut that no boundary may stand in; longer than the special strings.
MARGIN = 32
#: Marks that close a word; after an ASCII letter they start a word of their own.
MARKS = b".,;:!?%$#&*"

#: The normalisation and splitting that the cuts below are proven for, as a tokenizer file states them.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLITTER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}

_loaded: dict[str, object] = {}


def check_file(path: str) -> None:
    """Refuse a tokenizer file for which cuts at white space and behind letters aren't proven."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    if spec.get("normalizer") != NORMALIZER or spec.get("pre_tokenizer") != SPLITTER or any(len(t["content"]) >= MARGIN or " " in t["content"] for t in spec.get("added_tokens") or ()):
        raise ValueError(f"{path} normalises or splits text in another way than texts are cut here")


def _tokenizer(path: str):
    """The tokenizer of a file, once for each Python worker, without truncation or padding."""
    if path not in _loaded:
        single_threaded()
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(path)
        found.no_truncation()
        found.no_padding()
        _loaded[path] = found
    return _loaded[path]


class Counts:
    """Token counts of white-space-delimited pieces.

    The vocabulary drops white space and no token, normalisation or special string
    reaches across ASCII white space, so every such gap is a stable boundary and the
    counts of the pieces between them add up; likewise those of a piece that ends in a
    letter and the closing marks behind it. Each distinct piece is encoded once.
    """

    def __init__(self, path: str):
        self.encode = _tokenizer(path).encode_batch
        self.known: dict[bytes, int] = {}

    def of(self, texts: list[bytes]) -> list[int]:
        split = [t.split() for t in texts]
        distinct = set(chain.from_iterable(split))
        if len(self.known) + len(distinct) > REMEMBERED:
            self.known = {}
        self._learn([w for w in distinct if w not in self.known])
        get = self.known.__getitem__
        return [sum(map(get, ws)) for ws in split]

    def _learn(self, new: list[bytes]) -> None:
        cores = [w.rstrip(MARKS) for w in new]
        cut = [len(c) < len(w) and c[-1:].isalpha() for c, w in zip(cores, new, strict=True)]
        parts = {c if k else w for c, w, k in zip(cores, new, cut, strict=True)} | {w[len(c) :] for c, w, k in zip(cores, new, cut, strict=True) if k}
        todo = [p for p in parts if p not in self.known]
        for at in range(0, len(todo), 20_000):
            self.known.update(self._encoded(todo[at : at + 20_000]))
        get = self.known.__getitem__
        self.known.update({w: get(c) + get(w[len(c) :]) for c, w, k in zip(cores, new, cut, strict=True) if k})

    def _encoded(self, pieces: list[bytes]) -> Iterator[tuple[bytes, int]]:
        """Counts of pieces, encoded in lines of many; the offsets tell which piece a token is from."""
        decoded = [p.decode() for p in pieces]
        lines = [decoded[at : at + JOINED] for at in range(0, len(decoded), JOINED)]
        counts: list[int] = []
        for line, encoded in zip(lines, self.encode([" ".join(line) for line in lines], add_special_tokens=False), strict=True):
            begin = np.cumsum([0, *(len(p) + 1 for p in line)])
            starts = np.array([start for start, _ in encoded.offsets], np.int64)
            counts += np.diff(np.searchsorted(starts, begin)).tolist()
        return zip(pieces, counts, strict=True)

    def columns(self, texts: list[bytes]) -> list[list[int]]:
        return [self.of(texts)]


_kept: dict[str, Counts] = {}


def _counts(path: str) -> Counts:
    """A worker's counts outlive a task, as most pieces come again in the next."""
    if path not in _kept:
        _kept[path] = Counts(path)
    return _kept[path]


def _separates(before: str, after: str) -> bool:
    """Whether no token, normalisation or letter case reaches across the gap between two characters.

    White space always ends a word. So does a letter before punctuation or a symbol: a
    run of letters is matched greedily, nothing that starts with a letter goes past it, and
    neither character changes by what stands beyond the gap.
    """
    if before in " \t\n\r\x0b\x0c":
        return True
    return category(before)[0] == "L" and len(before.lower()) == 1 and category(after)[0] in "PS"


def stable_boundaries(text: str, offsets: list[tuple[int, int]], whole_left: bool, whole_right: bool) -> tuple[list[int], list[int]]:
    """Places in a chunk where two tokens meet that don't depend on each other, and the number of tokens before each.

    Near an edge that isn't the text's own, words and special strings may be cut: a margin stays out.
    """
    low, high = (0 if whole_left else MARGIN), (len(text) if whole_right else len(text) - MARGIN)
    places, before = [], []
    for k, (start, _) in enumerate(offsets):
        if k and start >= offsets[k - 1][1] and low < start < high and _separates(text[start - 1], text[start]):
            places.append(start)
            before.append(k)
    return places, before


def _chunks(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Cut each text into chunks that overlap by the row's own width; a width beyond the chunk joins chunks in effect."""
    for pdf in parts:
        for key, text, overlap in zip(pdf["key"], pdf["text"], pdf["overlap"], strict=True):
            step = max(CHUNK, overlap)
            for k, start in enumerate(range(0, len(text), step)):
                piece = text[start : start + step + overlap]
                last = start + step >= len(text)
                yield pd.DataFrame({"key": [key], "k": [k], "start": [start], "piece": [piece], "last": [last]})


def _encode(path: str):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Encode chunks with offsets; keep the number of tokens and the stable places in the overlaps at both ends."""
        tokenizer = _tokenizer(path)
        for pdf in parts:
            for key, k, start, piece, last, overlap in zip(*(pdf[c] for c in ("key", "k", "start", "piece", "last", "overlap")), strict=True):
                offsets = tokenizer.encode(piece, add_special_tokens=False).offsets
                places, before = stable_boundaries(piece, offsets, k == 0, last)
                step = max(CHUNK, overlap)
                head = bisect.bisect_right(places, overlap) if k else 0
                tail = len(places) if last else bisect.bisect_left(places, step)
                yield pd.DataFrame(
                    {
                        "key": [key],
                        "k": [k],
                        "n": [len(offsets)],
                        "head_at": [[p + start for p in places[:head]]],
                        "head_n": [before[:head]],
                        "tail_at": [[p + start for p in places[tail:]]],
                        "tail_n": [before[tail:]],
                    }
                )

    return run


def _huge(df: DataFrame, path: str) -> DataFrame:
    """Counts of texts longer than a chunk: ``key`` and ``n_tokens``.

    Texts with two neighbouring chunks that share no stable place go into another round with
    overlaps eight times as wide, until one chunk holds the whole text.
    """
    spark = df.sparkSession
    todo, done, overlap = df, None, OVERLAP
    while True:
        chunks = todo.withColumn("overlap", F.lit(overlap)).mapInPandas(_chunks, "key string, k long, start long, piece string, last boolean")
        parts = spark.conf.get("spark.sql.shuffle.partitions", "200")
        encoded = (
            chunks.repartition(int(parts), "key", "k")
            .withColumn("overlap", F.lit(overlap))
            .mapInPandas(_encode(path), "key string, k long, n long, head_at array<long>, head_n array<long>, tail_at array<long>, tail_n array<long>")
        )
        # Up to the place where the next chunk takes over, chunk k's tokens count, and chunk k + 1's before it don't; the last chunk counts in full.
        right = encoded.select("key", (F.col("k") - 1).alias("k"), "head_at", "head_n", F.lit(True).alias("next"))
        pairs = encoded.select("key", "k", "n", "tail_at", "tail_n").join(right, ["key", "k"], "left")
        place = F.array_min(F.array_intersect("tail_at", "head_at"))
        taken = F.element_at("tail_n", F.array_position("tail_at", place).cast("int")) - F.element_at("head_n", F.array_position("head_at", place).cast("int"))
        step = pairs.select("key", F.when(F.col("next").isNull(), F.col("n")).when(place.isNotNull(), taken).alias("tokens"))
        totals = step.groupBy("key").agg(F.sum("tokens").alias("n_tokens"), F.bool_or(F.col("tokens").isNull()).alias("failed"))
        totals = written(totals, "token-counts")
        good = totals.filter(~F.col("failed")).select("key", "n_tokens")
        done = good if done is None else done.unionByName(good)
        failed = totals.filter("failed")
        if failed.isEmpty():
            return done
        todo = todo.join(failed.select("key"), "key", "left_semi")
        overlap *= 8


def token_counts(df: DataFrame, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``n_tokens``, the number of tokens that the tokenizer file gives for each whole text, special tokens not added.

    Texts up to a chunk are counted in place, without a shuffle. Longer ones are cut
    into overlapping chunks that any executor can encode, and spliced; equal texts share
    the work. Null and empty texts have no tokens, repeated rows each their count; an
    empty table gives an empty result. Columns in ``keep`` are carried along. A file that cuts of texts aren't proven for is refused.
    """
    check_file(path)
    keep = [] if keep is None else keep
    rows = df.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.coalesce(F.col(text), F.lit("")).alias("text"))
    names = rows.columns[:-1]
    counted = add_columns(rows.filter(F.length("text") <= CHUNK), "text", lambda: _counts(path).columns, {"n_tokens": (T.LongType(), pa.int64())}, names)
    long = rows.filter(F.length("text") > CHUNK)
    if not long.isEmpty():
        long = long.withColumn("key", F.concat(F.md5("text"), F.length("text").cast("string")))
        totals = _huge(long.groupBy("key").agg(F.min("text").alias("text")), path)
        counted = counted.unionByName(long.drop("text").join(totals, "key").drop("key"))
    return counted.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "n_tokens")
