"""Quality classifier: a factorisation machine over hashed words, structure statistics and text metadata."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from segtide.llm.common import add_columns, written

#: Buckets of hashed words, size of the factors, labelled rows that are fitted at most.
BUCKETS, FACTORS, SAMPLE = 2048, 8, 6000
EPOCHS, BATCH, RATE, DECAY = 12, 128, 0.02, 1e-4
#: Fixed value: one in so many ids is held out.
HELD_OUT_PARTS = 5

_LOWER = np.zeros(256, bool)
_LOWER[ord("a") : ord("z") + 1] = True
_UPPER, _DIGIT, _MARK, _STOP = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_UPPER[ord("A") : ord("Z") + 1] = True
_DIGIT[ord("0") : ord("9") + 1] = True
_MARK[[ord(c) for c in "#*$%&|<>{}[]=_~^\\@+"]] = True
_STOP[[ord(c) for c in ".!?,;:"]] = True
STATISTICS = 16
WIDTH = BUCKETS + STATISTICS


class Features:
    """Turns whole texts into rows: logarithmic counts of hashed words with length one, then statistics in about [0, 1]."""

    def __init__(self) -> None:
        self.bucket: dict[bytes, int] = {}

    def rows(self, texts: list[bytes]) -> np.ndarray:
        x = np.zeros((len(texts), WIDTH), np.float32)
        for row, text in zip(x, texts, strict=True):
            self._fill(row, text)
        return x

    def _fill(self, row: np.ndarray, text: bytes) -> None:
        words = text.lower().split()
        distinct = set(words)
        if len(self.bucket) > 500_000:
            self.bucket = {}
        self.bucket.update((w, crc32(w) % BUCKETS) for w in distinct if w not in self.bucket)
        if words:
            counts = np.bincount(np.fromiter(map(self.bucket.__getitem__, words), np.int64, len(words)), minlength=BUCKETS)
            logs = np.log1p(counts)
            row[:BUCKETS] = logs / np.sqrt((logs * logs).sum())
        row[BUCKETS:] = self._statistics(text, words, len(distinct))

    @staticmethod
    def _statistics(text: bytes, words: list[bytes], distinct: int) -> list[float]:
        seen = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
        n, n_words = max(1, len(text)), max(1, len(words))
        lines = [line for line in text.split(b"\n") if line.strip()]
        n_lines = max(1, len(lines))
        letters = max(1, int(seen[_LOWER].sum() + seen[_UPPER].sum()))
        stops = int(seen[_STOP].sum())
        ended = sum(line.rstrip()[-1:] in (b".", b"!", b"?") for line in lines)
        return [
            1.0,
            min(1.0, 10 * int(seen[_MARK].sum()) / n),
            min(1.0, 3 * int(seen[_UPPER].sum()) / letters),
            min(1.0, 10 * int(seen[_DIGIT].sum()) / n),
            min(1.0, 5 * stops / n_words),
            min(1.0, 20 * int(seen[ord("!")]) / n),
            min(1.0, 20 * int(seen[ord("|")]) / n),
            int(seen[128:].sum()) / n,
            min(1.0, len(text) / n_words / 20),
            distinct / n_words,
            1 - len(set(lines)) / n_lines,
            ended / n_lines,
            min(1.0, np.log1p(n_words) / 12),
            min(1.0, np.log1p(n_words / n_lines) / 8),
            float(len(words) < 10),
            min(1.0, np.log1p(len(text)) / 16),
        ]


@dataclass
class Machine:
    """Bias, weights and factors."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def margins(self, x: np.ndarray) -> np.ndarray:
        """Linear part plus all pairwise interactions, by half the squared sum less the sum of squares."""
        sums = x @ self.factors
        squares = (x * x) @ (self.factors * self.factors).sum(axis=1)
        return self.bias + x @ self.linear + 0.5 * ((sums * sums).sum(axis=1) - squares)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(x).astype(np.float64), -30, 30)))

    @staticmethod
    def fitted(x: np.ndarray, y: np.ndarray, seed: int = 0) -> Machine:
        """Log loss by Adam over shuffled batches. Labels all alike, or none, give a constant."""
        random = np.random.default_rng(seed)
        params = [np.zeros(1, np.float32), np.zeros(x.shape[1], np.float32), random.normal(0, 0.01, (x.shape[1], FACTORS)).astype(np.float32)]
        if len(y) == 0 or y.min() == y.max():
            odds = 0.0 if len(y) == 0 else float(np.clip(6 * (2 * y[0] - 1), -6, 6))
            return Machine(odds, params[1], np.zeros_like(params[2]))
        moments = [[np.zeros_like(p), np.zeros_like(p)] for p in params]
        step = 0
        for _ in range(EPOCHS):
            order = random.permutation(len(y))
            for at in range(0, len(order), BATCH):
                xb, yb = x[order[at : at + BATCH]], y[order[at : at + BATCH]]
                machine = Machine(float(params[0][0]), params[1], params[2])
                error = ((machine.scores(xb) - yb) / len(yb)).astype(np.float32)
                sums = xb @ params[2]
                gradients = [
                    error.sum(keepdims=True),
                    xb.T @ error + DECAY * params[1],
                    xb.T @ (error[:, None] * sums) - ((xb * xb).T @ error)[:, None] * params[2] + DECAY * params[2],
                ]
                step += 1
                for p, g, m in zip(params, gradients, moments, strict=True):
                    m[0] += 0.1 * (g - m[0])
                    m[1] += 0.001 * (g * g - m[1])
                    p -= RATE * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8)
        return Machine(float(params[0][0]), params[1], params[2])


def held_out(row: str = "doc_id") -> Column:
    """Whether a row's labels are kept for testing; rows without an id are."""
    return F.coalesce(F.pmod(F.crc32(F.col(row).cast("string").cast("binary")), F.lit(HELD_OUT_PARTS)) == 0, F.lit(True))


def fit(documents: DataFrame, labels: DataFrame, row: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> Machine:
    """Fit the machine on at most ``sample`` labelled rows that aren't held out, those with the smallest hashes of their ids.

    Rows without id, with a null label or without a document are left out; of repeated labels of an id the smallest counts. The
    sample bounds the list of ids that is broadcast and the rows that reach the driver: word buckets and statistics, a few kilobytes each.
    """
    known = labels.select(F.col(row).alias("id"), F.col(label).cast("int").alias("label")).filter(F.col("label").isNotNull() & F.col("id").isNotNull())
    known = known.filter(~held_out("id")).groupBy("id").agg(F.min("label").alias("label"))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(sample)
    # A document stands once, so copies of an id don't outgrow the sample.
    texts = documents.select(F.col(row).alias("id"), F.col(text).alias("text")).join(F.broadcast(chosen), "id")
    found = add_columns(texts, "text", _sparse, {"at": (T.ArrayType(T.ShortType()), pa.list_(pa.int16())), "value": (T.ArrayType(T.FloatType()), pa.list_(pa.float32()))}, ["id", "label"])
    rows = found.dropDuplicates(["id"]).orderBy("id").toArrow()
    x = np.zeros((rows.num_rows, WIDTH), np.float32)
    for k, (at, value) in enumerate(zip(rows["at"], rows["value"], strict=True)):
        x[k, np.array(at.values)] = np.array(value.values)
    return Machine.fitted(x, np.array(rows["label"], np.float32))


def _sparse() -> Callable[[list[bytes]], list[list]]:
    features = Features()

    def work(texts: list[bytes]) -> list[list]:
        x = features.rows(texts)
        at = [np.flatnonzero(row) for row in x]
        return [[a.astype(np.int16) for a in at], [row[a] for row, a in zip(x, at, strict=True)]]

    return work


def score(documents: DataFrame, machine: Machine, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``score``, how likely label 1 is for each whole text, between 0 and 1.

    Only the text matters. Null and empty texts get the score of a text without words, repeated rows
    the same score; an empty table gives an empty result. Rows are scored where they are read; the machine is some 70 kilobytes.
    """

    def make() -> Callable[[list[bytes]], list[list]]:
        features = Features()

        def work(texts: list[bytes]) -> list[list]:
            # Blocks bound the dense rows, whatever the number of short texts.
            return [np.concatenate([machine.scores(features.rows(texts[k : k + 512])) for k in range(0, len(texts), 512)])]

        return work

    return add_columns(documents, text, make, {"score": (T.DoubleType(), pa.float64())}, keep or [])


def classify(documents: DataFrame, labels: DataFrame, threshold: float, row: str = "doc_id", text: str = "text", label: str = "quality", keep: list[str] | None = None) -> DataFrame:
    """Fit on the labels that aren't held out and add ``score`` and ``predicted`` to each document."""
    return score(documents, fit(documents, labels, row, text, label), text, keep).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


#: Rejected texts whose marks may be broadcast, 16 bytes each; beyond it Spark shuffles both sides.
FEW = 500_000


def without_rejected(documents: DataFrame, machine: Machine, threshold: float, text: str = "text") -> DataFrame:
    """The rows whose text isn't scored below the threshold, with all columns, whatever they are called.

    Texts alone go through the workers; what comes back are digests of the rejected ones, which are taken out of the documents where these lie.
    """
    mark = lambda c: F.unhex(F.md5(F.coalesce(c, F.lit("")).cast("binary")))
    texts = documents.select(F.col(text).alias("text"), mark(F.col(text)).alias("mark"))
    rejected = written(score(texts, machine, "text", ["mark"]).filter(F.col("score") < threshold).select("mark").distinct(), "quality-rejected")
    few = rejected.count() <= FEW
    return documents.join(F.broadcast(rejected) if few else rejected, mark(documents[text]) == rejected["mark"], "left_anti")
