"""Substring dedup: fixed blocks of every text are anchors, all rolling windows probe them, hits grow to maximal repeats."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from segtide.llm.common import LAST, lean, width

#: Words of a window; its half is the length of a block, so each window holds a whole block.
WINDOW = 20
BLOCK = WINDOW // 2
#: Bytes of text that are probed together, and that make one shuffle group.
PORTION, GROUP = 4_000_000, 24_000_000
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_END = 65_535

PROBES = pa.schema([("slot", pa.int32()), ("keys", pa.binary()), ("rows", pa.binary()), ("runs", pa.binary()), ("gaps", pa.binary()), ("sure_rows", pa.binary()), ("sure_runs", pa.binary()), ("sure_gaps", pa.binary())])
WINDOWS = pa.schema([("slot", pa.int32()), ("keys", pa.binary()), ("rows", pa.binary()), ("ranks", pa.binary()), ("runs", pa.binary()), ("gaps", pa.binary()), ("sure_rows", pa.binary()), ("sure_runs", pa.binary()), ("sure_gaps", pa.binary())])
PLACES, GATHERED = "home int, rows binary, runs binary, gaps binary", "row long, places binary"
#: Bytes of a window's key that travel; the slot holds more of its bits, the more windows there are.
KEY = 10


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The hash of two neighbouring stretches of words from theirs."""
    return _mixed(left * _A + right * _B + _C)


def _spread(keys: np.ndarray, slots: int) -> np.ndarray:
    return ((_mixed(keys + _C) >> np.uint64(32)) * np.uint64(slots) >> np.uint64(32)).astype(np.int64)


class Hashes:
    """Hashes of words and of stretches of half a window, for the concatenated words of many texts."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def words(self, words: list[bytes]) -> np.ndarray:
        if len(self.known) > 100_000:
            self.known = {}
        known = self.known
        for w in words:
            if w not in known:
                known[w] = xxhash.xxh64_intdigest(w)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))

    @staticmethod
    def halves(words: np.ndarray) -> np.ndarray:
        """The hash of the ``BLOCK`` words from each place on, built from those of 2, 4 and 8."""
        two = _joined(words[:-1], words[1:])
        four = _joined(two[:-2], two[2:])
        eight = _joined(four[:-4], four[4:])
        return _joined(eight[:-2], two[8:])


def planes(values: np.ndarray) -> bytes:
    """Whole numbers byte by byte: first all low bytes, then the next ones, which are mostly zero and take no room once compressed."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes()


def from_planes(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).reshape(-1).view(kind)


def packed(rows: np.ndarray, places: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Places sorted by row: the rows, the number of places of each, and the gaps between places in 16 bits; a longer gap takes more than one."""
    if not len(rows):
        return b"", b"", b""
    first = np.concatenate([[True], rows[1:] != rows[:-1]])
    gap = np.where(first, places, np.diff(places, prepend=0))
    out = np.full(int((1 + gap // _END).sum()), _END, np.uint16)
    out[np.cumsum(1 + gap // _END) - 1] = gap % _END
    at = np.flatnonzero(first)
    return rows[at].tobytes(), planes(np.diff(np.append(at, len(rows))).astype(np.int32)), planes(out)


def unpacked(runs: bytes, gaps: bytes) -> np.ndarray:
    """The places again, row after row."""
    steps, counts = from_planes(gaps, np.uint16), from_planes(runs, np.int32)
    upto = np.cumsum(steps.astype(np.int64))[steps != _END]
    ends = np.cumsum(counts.astype(np.int64))
    base = np.concatenate([[0], upto[ends[:-1] - 1]]) if len(ends) else np.zeros(0, np.int64)
    return upto - np.repeat(base, counts)


def _texts(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[tuple]]:
    """Rows of batches in portions of about ``most`` bytes of text, which is the last column."""
    held, size = [], 0
    for batch in batches:
        for row in zip(*(c.to_pylist() if k < batch.num_columns - 1 else c for k, c in enumerate(batch.columns)), strict=True):
            text = row[-1].as_py()
            held.append((*row[:-1], text))
            size += len(text)
            if size >= most:
                yield held
                held, size = [], 0
    if held:
        yield held


def _concatenated(hashes: Hashes, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of all texts, and where each text starts and how many words it has."""
    split = [t.split() for t in texts]
    sizes = np.array([len(w) for w in split], np.int64)
    flat = np.concatenate([hashes.words(w) for w in split]) if split else np.zeros(0, np.uint64)
    return flat, np.cumsum(sizes) - sizes, sizes


def _by_slot(slot: np.ndarray, sure_slot: np.ndarray) -> Iterator[tuple[int, slice, slice]]:
    for s in np.union1d(slot, sure_slot):
        yield int(s), slice(*(int(np.searchsorted(slot, s, side)) for side in ("left", "right"))), slice(*(int(np.searchsorted(sure_slot, s, side)) for side in ("left", "right")))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _probe(slots: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each rolling half window with its place, dealt by its hash.

        A hash that a portion holds twice is a hit already: all its places are sure, and one of them travels for the others,
        a block if there is one.
        """
        hashes = Hashes()
        for held in _texts(batches, PORTION):
            yield from _probed(hashes, held, slots)

    return run


def _probed(hashes: Hashes, held: list[tuple], slots: int) -> list[pa.RecordBatch]:
    """The probes of one portion; what they are made from is freed before the next one."""
    flat, starts, sizes = _concatenated(hashes, [t for _, t in held])
    if len(flat) < WINDOW:
        return []
    keys = hashes.halves(flat)
    n = len(keys)
    row = np.repeat(np.array([r for r, _ in held], np.int64), sizes)[:n]
    place = np.arange(n) - np.repeat(starts, sizes)[:n]
    size = np.repeat(sizes, sizes)[:n]
    inside = (place + BLOCK <= size) & (size >= WINDOW)
    del flat, size
    keys, row, place = keys[inside], row[inside], place[inside]

    order = np.lexsort((place % BLOCK != 0, keys))
    ranked = keys[order]
    first = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    del ranked
    counts = np.diff(np.append(np.flatnonzero(first), len(order)))
    sure = order[np.repeat(counts > 1, counts)]
    sent = order[first]
    del order, first, counts
    slot = _spread(keys[sent], slots)
    order = np.lexsort((place[sent], row[sent], slot))
    sent, slot = sent[order], slot[order]
    sure_slot = _spread(row[sure].view(np.uint64), slots)
    order = np.lexsort((place[sure], row[sure], sure_slot))
    sure, sure_slot = sure[order], sure_slot[order]
    del order
    short = (keys & np.uint64(2**32 - 1)).astype("<u4")
    del keys
    return [_batch([(s, short[sent[a]].tobytes(), *packed(row[sent[a]], place[sent[a]]), *packed(row[sure[b]], place[sure[b]])) for s, a, b in _by_slot(slot, sure_slot)], PROBES)]


def _homes(row: np.ndarray, place: np.ndarray, slots: int) -> pa.Table:
    """Places packed for the shuffle that brings those of a row together."""
    home = _spread(row.view(np.uint64), slots)
    order = np.lexsort((place, row, home))
    row, place, home = row[order], place[order], home[order]
    rows = [(s, *packed(row[a], place[a])) for s, a, _ in _by_slot(home, home[:0])]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["home", "rows", "runs", "gaps"])


def _gathered(table: pa.Table) -> pa.Table:
    """One line for each row with its places, ascending."""
    row, place = _read(table)
    order = np.lexsort((place, row))
    row, place = row[order], place[order]
    new = np.concatenate([[True], (row[1:] != row[:-1]) | (place[1:] != place[:-1])]) if len(row) else np.zeros(0, bool)
    row, place = row[new], place[new]
    at = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, np.int64)
    ends = np.append(at, len(row))
    return pa.table({"row": pa.array(row[at], pa.int64()), "places": pa.array([place[a:b].astype(np.int32).tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())})


def _read(table: pa.Table, prefix: str = "") -> tuple[np.ndarray, np.ndarray]:
    rows, places = [], []
    for r, runs, gaps in zip(*(table[prefix + c].to_pylist() for c in ("rows", "runs", "gaps")), strict=True):
        rows.append(np.repeat(np.frombuffer(r, np.int64), from_planes(runs, np.int32)))
        places.append(unpacked(runs, gaps))
    return np.concatenate(rows), np.concatenate(places)


def _hits(slots: int):
    def run(table: pa.Table) -> pa.Table:
        """Places of half windows that equal a block elsewhere, and of those blocks; a few others whose short hashes agree do no harm."""
        keys = np.concatenate([np.frombuffer(k, "<u4") for k in table["keys"].to_pylist()])
        row, place = _read(table)
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        counts = np.diff(np.append(edge, len(keys)))
        block = np.maximum.reduceat(place[order] % BLOCK == 0, edge) if len(keys) else np.zeros(0, bool)
        hit = order[np.repeat((counts > 1) & block, counts)]
        del keys, order, edge, counts, block
        row, place = row[hit], place[hit]
        sure_row, sure_place = _read(table, "sure_")
        return _homes(np.concatenate([row, sure_row]), np.concatenate([place, sure_place]), slots)

    return run


def _merged(places: bytes | None) -> np.ndarray:
    return np.frombuffer(places or b"", np.int32).astype(np.int64)


def _windows(slots: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole windows around the hits, by two hashes in 80 bits, dealt by the first. Only the earliest of a portion's equal windows travels; the others are sure."""
        hashes = Hashes()
        for held in _texts((b.select(["rank", "row", "places", "text"]) for b in batches), PORTION):
            yield from _around(hashes, held, slots)

    return run


def _around(hashes: Hashes, held: list[tuple], slots: int) -> list[pa.RecordBatch]:
    """The windows of one portion; what they are made from is freed before the next one."""
    flat, starts, sizes = _concatenated(hashes, [t for *_, t in held])
    near = np.zeros(len(flat) + 1, np.int64)
    for (_, _, places, _), start, size in zip(held, starts, sizes, strict=True):
        hit = _merged(places)
        low, high = np.maximum(hit - BLOCK + 1, 0), np.minimum(hit, size - WINDOW) + 1
        fits = low < high
        np.add.at(near, start + low[fits], 1)
        np.add.at(near, start + high[fits], -1)
    at = np.flatnonzero(np.cumsum(near) > 0)
    del near
    if not len(at):
        return []
    halves = hashes.halves(flat)
    key = _joined(halves[at], halves[at + BLOCK])
    check = (_mixed(halves[at] * _C + halves[at + BLOCK] * _A) >> np.uint64(48)).astype("<u2")
    del flat, halves
    of = np.searchsorted(starts + sizes, at, side="right")
    rank, row = np.array([h[0] for h in held], np.int64)[of], np.array([h[1] for h in held], np.int64)[of]
    place = at - starts[of]
    del at, of

    order = np.lexsort((row, place, rank, check, key))
    later, first = _later(key[order], check[order], rank[order], place[order])
    sure = order[later]
    # Rows that share an id may hold equal windows at one place: none is later, each travels once.
    same = np.concatenate([[False], (row[order][1:] == row[order][:-1]) & ~first[1:]])
    sent = order[~later & ~same]
    del later, first, same
    slot = _spread(key[sent], slots)
    order = np.lexsort((place[sent], row[sent], slot))
    sent, slot = sent[order], slot[order]
    sure_slot = _spread(row[sure].view(np.uint64), slots)
    order = np.lexsort((place[sure], row[sure], sure_slot))
    sure, sure_slot = sure[order], sure_slot[order]
    del order
    rows = []
    for s, a, b in _by_slot(slot, sure_slot):
        mine = sent[a]
        lead = np.flatnonzero(np.concatenate([[True], row[mine][1:] != row[mine][:-1]])) if len(mine) else np.zeros(0, np.int64)
        ids, runs, gaps = packed(row[mine], place[mine])
        rows.append((s, key[mine].tobytes() + check[mine].tobytes(), ids, rank[mine][lead].tobytes(), runs, gaps, *packed(row[sure[b]], place[sure[b]])))
    return [_batch(rows, WINDOWS)]


def _later(key: np.ndarray, check: np.ndarray, rank: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted windows, which start later than an equal one, and which is the first of its kind."""
    if not len(key):
        return np.zeros(0, bool), np.zeros(0, bool)
    first = np.concatenate([[True], (key[1:] != key[:-1]) | (check[1:] != check[:-1])])
    lead = np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))
    return (rank != rank[lead]) | (place != place[lead]), first


def _repeats(slots: int):
    def run(table: pa.Table) -> pa.Table:
        """Places of windows whose words also start earlier."""
        packs = [(k, len(k) // KEY) for k in table["keys"].to_pylist()]
        key = np.concatenate([np.frombuffer(k, np.uint64, n) for k, n in packs])
        check = np.concatenate([np.frombuffer(k, "<u2", n, 8 * n) for k, n in packs])
        row, place = _read(table)
        rank = np.concatenate([np.repeat(np.frombuffer(k, np.int64), from_planes(r, np.int32)) for k, r in zip(table["ranks"].to_pylist(), table["runs"].to_pylist(), strict=True)])
        order = np.lexsort((place, rank, check, key))
        later = order[_later(key[order], check[order], rank[order], place[order])[0]]
        del packs, key, check, rank, order
        row, place = row[later], place[later]
        sure_row, sure_place = _read(table, "sure_")
        return _homes(np.concatenate([row, sure_row]), np.concatenate([place, sure_place]), slots)

    return run


def kept_words(text: bytes, repeated: bytes | None) -> tuple[list[bytes], int]:
    """The words that no repeated window covers, and the number of all words."""
    words = text.split()
    places = _merged(repeated)
    if not len(places):
        return words, len(words)
    cover = np.zeros(len(words) + 1, np.int64)
    cover[places] += 1
    np.subtract.at(cover, places + WINDOW, 1)
    return [words[k] for k in np.flatnonzero(np.cumsum(cover)[:-1] == 0)], len(words)


def _cleaned(n_kept: int, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, results = [], [], []
            for repeated, text in zip(batch.column("places").to_pylist(), batch.column("text"), strict=True):
                kept, n = kept_words(text.as_py(), repeated)
                n_words.append(n)
                n_removed.append(n - len(kept))
                if digest:
                    results.append(hashlib.sha256(b" ".join(kept)).hexdigest())
                else:
                    results.append((text.as_py() if len(kept) == n else b" ".join(kept)).decode())
            names = [*batch.schema.names[:n_kept], "n_words", "n_removed", "result"]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_kept], pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(results, pa.string())], names)

    return run


def remove_repeats(df: DataFrame, row: str = "doc_id", text: str = "text", digest: bool = False, keep: list[str] | None = None) -> DataFrame:
    """Remove every word that a repeated window covers: ``n_words``, ``n_removed`` and ``kept_text``, or ``kept_sha256`` if ``digest``.

    The kept text is the text itself if nothing is removed, else the kept words joined by one space; the digest is always of the joined words.

    A window is ``WINDOW`` consecutive words of one text; it is repeated if the same words also start earlier, in a smaller id or earlier in the
    text. Windows are judged on the input. Null and empty texts have no words; a null id counts as larger than all others; rows with the same id and
    place are not earlier than one another, so rows that repeat id and text are cleaned alike. An empty table gives an empty result. Columns in ``keep`` are carried along.

    Any window holds a whole block of half its length, so of two equal windows one's block equals a half window of the other: blocks and probes
    meet by hash in one shuffle of about five bytes a word. Only windows around hits are compared as a whole, by 80 bits and their slot, each key's earliest surviving;
    runs of them are the maximal repeats. A hot passage travels once for each portion of text. Texts are shuffled once, by a hash of id and text, for both joins.
    """
    keep = [row] if keep is None else keep
    spark = df.sparkSession
    size = df.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    slots = width(spark, size, GROUP)
    words = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = df.select(
        *[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)],
        F.coalesce(F.col(row).cast("long"), F.lit(LAST)).alias("rank"),
        F.xxhash64(F.col(row), F.col(text)).alias("row"),
        words.alias("text"),
    )
    probes = rows.select("row", "text").mapInArrow(lean(_probe(slots)), "slot int, keys binary, rows binary, runs binary, gaps binary, sure_rows binary, sure_runs binary, sure_gaps binary")
    hits = probes.groupBy("slot").applyInArrow(lean(_hits(slots)), PLACES).groupBy("home").applyInArrow(lean(_gathered), GATHERED)
    # Both joins take the same columns of the texts, so they share one shuffle.
    windows = rows.join(hits.hint("shuffle_hash"), "row").select(*rows.columns, "places").mapInArrow(lean(_windows(slots)), "slot int, keys binary, rows binary, ranks binary, runs binary, gaps binary, sure_rows binary, sure_runs binary, sure_gaps binary")
    repeats = windows.groupBy("slot").applyInArrow(lean(_repeats(slots)), PLACES).groupBy("home").applyInArrow(lean(_gathered), GATHERED)
    joined = rows.join(repeats.hint("shuffle_hash"), "row", "left").select(*rows.columns, "places")
    schema = T.StructType([*joined.schema.fields[: len(keep)], *[T.StructField(n, T.LongType()) for n in ("n_words", "n_removed")], T.StructField("result", T.StringType())])
    cleaned = joined.mapInArrow(lean(_cleaned(len(keep), digest)), schema)
    return cleaned.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "n_words", "n_removed", F.col("result").alias("kept_sha256" if digest else "kept_text"))
