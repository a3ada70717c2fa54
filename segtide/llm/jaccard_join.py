"""N-gram Jaccard join on parity sketches: pigeonhole over sketch parts for each size band, then exact verification."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import ceil, exp, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segtide.llm.common import in_portions, lean, staging, text_bytes, width, written
from segtide.llm.components import components

#: Words of a shingle. Two sets link at 3/4: their symmetric difference is a seventh of both sizes at most.
SHINGLE, NUMERATOR, DENOMINATOR, SEVENTH = 5, 3, 4, 7
#: Bytes of text whose sketches are combined before the shuffle, and that make one shuffle group.
PORTION, GROUP = 4_000_000, 32_000_000
#: Ids that may be broadcast, 16 MB; beyond it Spark shuffles both sides.
FEW = 2_000_000
#: Rows of one bucket that are compared in one block, and bytes of them; what a row has besides its sketch.
BLOCK, BLOCK_BYTES, ROW = 512, 4_000_000, 64
#: Pairs of rows that make one group of blocks; a task holds those of its group that differ.
PAIRS = 2_000_000
#: Pairs of rows that a task compares at once, in some twelve arrays.
CHUNK = 250_000
#: Ids of different components in a bucket from which on its key is common, and keys, 8 MB, that a round adds to these.
COMMON, MOST_COMMON = 128, 1_000_000
#: Pairs in buckets of common keys, for each row of the input, that are worth looking for rarer keys.
WORTH = 50

_MULTIPLIERS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]


#: The part of a key that travels; the rest is in the slot's number.
LOW = np.uint64(2**48 - 1)


def mixed(h: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit words."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Shingles:
    """Sets of hashed word shingles; hashes have 64 bits, so two different ones of a pair meet once in 10^13 pairs of long texts."""

    def __init__(self, size: int = SHINGLE):
        self.size = size
        self.known: dict[bytes, int] = {}

    def of(self, text: bytes) -> np.ndarray:
        """The sorted distinct shingles of a text; a shorter text is one shingle, no words give none."""
        words = text.lower().split()
        if len(self.known) > 100_000:
            self.known = {}
        known = self.known
        for w in words:
            if w not in known:
                known[w] = xxhash.xxh64_intdigest(w)
        hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        if len(hashes) < self.size:
            return mixed(np.array([sum((i + 1) * int(h) for i, h in enumerate(hashes)) + len(hashes) & 2**64 - 1], np.uint64)) if len(hashes) else hashes
        n = len(hashes) - self.size + 1
        total = np.zeros(n, np.uint64)
        for k in range(self.size):
            total += mixed(hashes[k : k + n] + _MULTIPLIERS[k]) * _MULTIPLIERS[k]
        return np.unique(mixed(total))


def _bands() -> np.ndarray:
    """Where size bands start: the smallest whole numbers from each power of 4/3 on."""
    starts = [1]
    while starts[-1] < 2**40:
        k = len(starts)
        starts.append(-(-(4**k) // 3**k))
    return np.array(starts, np.int64)


BANDS = _bands()


def parts_of(band: int) -> int:
    """Into how many parts sketches of a band are cut.

    The smallest set of the band must keep more non-empty parts than the pigeonhole asks for, by eight standard
    deviations (a chance below 10^-14); within that, fewer parts tell texts better apart. Small sets get a part for each shingle.
    """
    n = int(BANDS[band])
    if n < 64:
        return 1 << 24
    need, load = n // 3 + 1, 3.0
    while load > 0.2:
        parts = ceil(n / load)
        full = parts * (1 - exp(-load))
        spread = sqrt(parts * (exp(-load) - (1 + load) * exp(-2 * load)))
        if full - 8 * spread >= need:
            return parts
        load -= 0.05
    return 1 << 24


PARTS = np.array([parts_of(b) for b in range(len(BANDS))], np.uint64)


def keys_of(sets: list[np.ndarray], common: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the leading non-empty sketch parts of each set, and the set that each key is from.

    A shingle toggles one bit of the part it falls into; a part is 2^64 bits wide and is kept as the XOR of one word
    for each bit that is set, so equal parts have equal words. Linked sets with sizes a <= b <= 4/3 a lie
    in a's band or the next and differ in d = (a + b) / 7 shingles at most, hence in d parts. Each gives
    its first d + 1 non-empty parts, counted with its largest possible d. Among the shorter of
    these two stretches at least one part is equal in both and not empty. Each set does so in its own band, and as the larger side in the band below.

    Any order of the keys that is one for all sets does: what is ahead of the first key of both is not in the other set, so d keys at most.
    Parts stand by number, and those whose keys have one of the sorted names ``common`` behind all others.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    of = np.repeat(np.arange(len(sets)), sizes)
    own = np.searchsorted(BANDS, sizes, side="right") - 1
    found, owners = [], []
    for below in (0, 1):
        band = own - below
        # Below its own band a set's partners are smaller than where its own band starts.
        partner = np.where(below, BANDS[np.maximum(own, 0)], 4 * sizes // 3)
        most = (sizes + partner) // SEVENTH + 1
        use = (sizes > 0) & (band >= 0)
        keep = use[of]
        h, o = flat[keep], of[keep]
        part = ((h >> np.uint64(32)) * PARTS[band[o]]) >> np.uint64(32)
        if not len(h):
            continue
        edge = np.flatnonzero(np.concatenate([[True], (part[1:] != part[:-1]) | (o[1:] != o[:-1])]))
        word = np.bitwise_xor.reduceat(mixed(h ^ _MULTIPLIERS[0]), edge)
        part, o = part[edge], o[edge]
        key = mixed(word + mixed(part * _MULTIPLIERS[1] + band[o].astype(np.uint64) * _MULTIPLIERS[2]))
        if common is not None and len(common):
            name = (key & LOW).view(np.int64)
            order = np.lexsort((common[np.minimum(np.searchsorted(common, name), len(common) - 1)] == name, o))
            key, o = key[order], o[order]
        first = np.flatnonzero(np.concatenate([[True], o[1:] != o[:-1]]))
        rank = np.arange(len(o)) - np.repeat(first, np.diff(np.append(first, len(o))))
        leading = rank < most[o]
        found.append(key[leading])
        owners.append(o[leading])
    return (np.concatenate(found), np.concatenate(owners)) if found else (flat[:0], of[:0])


def words_of(sizes: np.ndarray) -> np.ndarray:
    """64-bit words of the short sketch of a set: a power of two, with at least four bits for each shingle, so few toggles cancel."""
    return 1 << np.ceil(np.log2(np.maximum(sizes, 16) / 16)).astype(np.int64)


def short_sketches(sets: list[np.ndarray]) -> list[bytes]:
    """A short parity sketch of each set: a shingle toggles one bit, so two sketches differ in no more bits than the sets in shingles."""
    if not sets:
        return []
    sizes = np.array([len(s) for s in sets], np.int64)
    bits = 64 * words_of(sizes)
    ends = np.cumsum(bits)
    bit = mixed(np.concatenate(sets) + _MULTIPLIERS[4]) & np.repeat(bits - 1, sizes).astype(np.uint64)
    odd = np.bincount(bit.astype(np.int64) + np.repeat(ends - bits, sizes), minlength=int(ends[-1])) & 1
    data = np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()
    return [data[(e - b) // 8 : e // 8] for b, e in zip(bits, ends, strict=True)]


def folded(sketches: np.ndarray, words: int) -> np.ndarray:
    """Sketches of one width (rows) as those of a smaller width: the bits that fall together are XORed."""
    return np.bitwise_xor.reduce(sketches.reshape(len(sketches), -1, words), axis=1)


def may_link(left: list[bytes], right: list[bytes], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of pairs of sets with these sketches and sizes, which the sketches and sizes leave open."""
    found = (4 * np.minimum(a, b) >= 3 * np.maximum(a, b)) & (a > 0)
    widths = np.array([len(x) for x in left]) * 2**32 + np.array([len(x) for x in right]) if left else np.zeros(0, np.int64)
    for width_ in np.unique(widths[found]):
        at = np.flatnonzero(found & (widths == width_))
        x, y = (np.frombuffer(b"".join(s[k] for k in at), np.uint64).reshape(len(at), -1) for s in (left, right))
        words = min(x.shape[1], y.shape[1])
        apart = np.bitwise_count(folded(x, words) ^ folded(y, words)).sum(axis=1, dtype=np.int64)
        found[at] = SEVENTH * apart <= a[at] + b[at]
    return found


def _pack6(keys: np.ndarray) -> bytes:
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unpack6(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(-1, 6)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :6] = raw
    return out.reshape(-1).view("<u8")


#: Kinds of the rows that the sketch stage gives: a pair to verify, a bucket with one of its ids, a text's id and size, a text without id and its size.
PAIR, MEMBER, SIZE, NAMELESS = range(4)
SKETCHED = pa.schema([("slot", pa.int32()), ("keys", pa.binary()), ("ids", pa.binary()), ("runs", pa.binary()), ("sure", pa.binary()), ("sketches", pa.binary())])
MET = "kind int, a long, b long, sketch binary"


def _stars(bucket: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sort rows by bucket and id; the order, and where each row's bucket starts and how many rows it has."""
    order = np.lexsort((ids, bucket))
    b = bucket[order]
    first = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]])) if len(b) else np.zeros(0, np.int64)
    counts = np.diff(np.append(first, len(b)))
    return order, np.repeat(first, counts), np.repeat(counts, counts)


def _sketch(slots: int, common: np.ndarray | None = None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles()
        for batch in batches:
            names = batch.column(0).to_pylist()
            for at, texts in in_portions(batch.column(1), PORTION):
                yield _portion(names[at : at + len(texts)], [shingles.of(t) for t in texts], slots, common)

    return run


def _portion(names: list[int | None], sets: list[np.ndarray], slots: int, common: np.ndarray | None = None) -> pa.RecordBatch:
    """Rows for the shuffle, one for each slot: packed keys, and what is already sure. Of equal keys only the smallest id travels."""
    # The first rows are the texts themselves, in order, as their sketches are. Once common keys are known, texts have told theirs.
    sure = [(NAMELESS, 0, len(s)) if i is None else (SIZE, i, len(s)) for i, s in zip(names, sets, strict=True)] if common is None else []
    # Equal sets of a portion are pairs at once, and only the smallest id goes on.
    smallest: dict[tuple[int, bytes], int] = {}
    chosen: dict[tuple[int, bytes], np.ndarray] = {}
    for i, s in zip(names, sets, strict=True):
        if i is not None and len(s):
            mark = (len(s), xxhash.xxh128_digest(s))
            old = smallest.get(mark)
            if old is not None and old != i:
                sure.append((PAIR, min(old, i), max(old, i)))
            smallest[mark] = i if old is None else min(old, i)
            chosen[mark] = s
    sketches = short_sketches(sets) if common is None else []
    ids = np.array([smallest[m] for m in chosen], np.int64)
    order = np.argsort(ids, kind="stable")
    marks = list(chosen)
    keys, of = keys_of([chosen[marks[k]] for k in order], common)
    owner = ids[order][of]
    order, first, counts = _stars(keys, owner)
    keys, owner = keys[order], owner[order]
    many = (counts > 1) & (owner != owner[first])
    pairs = np.unique(np.stack([owner[first][many], owner[many]], axis=1), axis=0) if many.any() else np.zeros((0, 2), np.int64)
    members = np.stack([(keys & LOW).view(np.int64)[counts > 1], owner[counts > 1]], axis=1)
    told = np.concatenate([
        np.array(sure, np.int64).reshape(-1, 3),
        np.concatenate([np.full((len(pairs), 1), PAIR), pairs], axis=1),
        np.concatenate([np.full((len(members), 1), MEMBER), members], axis=1),
    ])
    # The smallest id of a bucket with company here travels twice, so that its bucket counts as one of three or more.
    leads = np.arange(len(keys)) - first < np.minimum(counts, 2)
    keys, owner = keys[leads], owner[first][leads]
    slot = ((mixed(keys + _MULTIPLIERS[3]) >> np.uint64(32)) * np.uint64(slots) >> np.uint64(32)).astype(np.int64)
    order = np.lexsort((owner, slot))
    keys, owner, slot = keys[order], owner[order], slot[order]
    # What is sure needs no company and is dealt evenly.
    told_slot = mixed(told[:, 1].astype(np.uint64) + told[:, 2].astype(np.uint64) * _MULTIPLIERS[4]) % np.uint64(slots)
    rows = []
    for s in np.union1d(slot, told_slot.astype(np.int64)):
        a, b = np.searchsorted(slot, s), np.searchsorted(slot, s, side="right")
        mine, runs = np.unique(owner[a:b], return_counts=True)
        here = np.flatnonzero(told_slot == s)
        own = b"".join(sketches[k] for k in here if told[k, 0] == SIZE)
        rows.append((int(s), _pack6(keys[a:b]), mine.tobytes(), runs.astype(np.int32).tobytes(), told[here].tobytes(), own))
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 6, SKETCHED, strict=True)], schema=SKETCHED)


def _meet(table: pa.Table) -> pa.Table:
    """The pairs and bucket members of one slot: in each bucket, every id is paired with the smallest."""
    keys = np.concatenate([_unpack6(k.as_py()) for k in table["keys"]])
    ids = np.concatenate([np.repeat(np.frombuffer(i.as_py(), np.int64), np.frombuffer(r.as_py(), np.int32)) for i, r in zip(table["ids"], table["runs"], strict=True)])
    told = np.concatenate([np.frombuffer(s.as_py(), np.int64).reshape(-1, 3) for s in table["sure"]])
    sizes = told[told[:, 0] == SIZE, 2]
    ends = 8 * np.cumsum(words_of(sizes))
    data = b"".join(s.as_py() for s in table["sketches"])
    sketches = iter([data[e - 8 * w : e] for w, e in zip(words_of(sizes), ends, strict=True)])
    order, first, counts = _stars(keys, ids)
    keys, ids = keys[order], ids[order]
    many = (counts > 1) & (ids != ids[first])
    pairs = np.unique(np.stack([ids[first][many], ids[many]], axis=1), axis=0) if many.any() else np.zeros((0, 2), np.int64)
    # Two ids of a bucket are a pair and no more is open; a bucket's name is its key's low 48 bits.
    several = counts > 2
    members = np.stack([keys.view(np.int64)[several], ids[several]], axis=1)
    rows = np.concatenate([
        told,
        np.concatenate([np.full((len(pairs), 1), PAIR), pairs], axis=1),
        np.concatenate([np.full((len(members), 1), MEMBER), members], axis=1),
    ])
    own = [next(sketches) if kind == SIZE else None for kind in rows[:, 0]]
    return pa.table({"kind": rows[:, 0].astype(np.int32), "a": rows[:, 1], "b": rows[:, 2], "sketch": pa.array(own, pa.binary())})


def _met(rows: DataFrame, slots: int, common: np.ndarray | None = None) -> DataFrame:
    """What the sketches of some rows tell, once they met."""
    packed = rows.mapInArrow(lean(_sketch(slots, common)), "slot int, keys binary, ids binary, runs binary, sure binary, sketches binary")
    return written(packed.repartition(slots, "slot").groupBy("slot").applyInArrow(lean(_meet), MET), "jaccard-met")


def _members(met: DataFrame) -> DataFrame:
    return met.filter(F.col("kind") == MEMBER).select(F.col("a").alias("bucket"), F.col("b").alias("id"))


def _pairs(met: DataFrame) -> DataFrame:
    return met.filter(F.col("kind") == PAIR).select("a", "b")


def _ids(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id")))


def _shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shingles = Shingles()
    for batch in batches:
        for at, texts in in_portions(batch.column(1)):
            sets = [shingles.of(t) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array([s.tobytes() for s in sets], pa.binary())], ["id", "members"])


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets reach the similarity."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both > 0 and DENOMINATOR * both >= NUMERATOR * (len(a) + len(b) - both)


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [[np.frombuffer(x.as_py(), np.uint64) for x in batch.column(k)] for k in (2, 3)]
        keep = pa.array([linked(x, y) for x, y in zip(*sets, strict=True)], pa.bool_())
        yield batch.select(["a", "b"]).filter(keep)


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``a``, ``b`` whose sets reach the similarity. A hot id's set goes to its many partners, not they to it."""
    with_a = pairs.join(sets.select(F.col("id").alias("a"), F.col("members").alias("set_a")), "a")
    both = with_a.join(sets.select(F.col("id").alias("b"), F.col("members").alias("set_b")), "b").select("a", "b", "set_a", "set_b")
    return both.mapInArrow(lean(_verified), "a long, b long")


def _sets(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The shingle sets of some ids, written once; texts are shuffled only if the ids are too many to broadcast."""
    ids = written(ids.distinct(), "jaccard-ids")
    few = ids.count() <= FEW
    chosen = rows.join(F.broadcast(ids) if few else ids, "id", "left_semi")
    return written(chosen.mapInArrow(lean(_shingled), "id long, members binary"), "jaccard-sets")


def _open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        left, right = batch.column("sketch_a").to_pylist(), batch.column("sketch_b").to_pylist()
        keep = may_link(left, right, batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy())
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def still_open(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs that short sketches and sizes leave open; ``sketches`` has ``id``, ``n`` and ``sketch``. A hot id's sketch goes to its partners."""
    for side in ("a", "b"):
        pairs = pairs.join(sketches.select(F.col("id").alias(side), F.col("n").alias(f"n_{side}"), F.col("sketch").alias(f"sketch_{side}")), side)
    return pairs.select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b").mapInArrow(lean(_open), "a long, b long")


def _meetings(bucket: np.ndarray, block: np.ndarray, part: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of entries to compare, about ``CHUNK`` at a time: entries are sorted by bucket, block and component (``part``).

    In every bucket each entry meets those of the components behind its own, once; two of one component need no link between them.
    """
    if not len(bucket):
        return
    apart = (bucket[1:] != bucket[:-1]) | (block[1:] != block[:-1])
    end, after = (np.repeat(e[1:], np.diff(e)) for e in (np.flatnonzero(np.concatenate([[True], a, [True]])) for a in (apart, apart | (part[1:] != part[:-1]))))
    size = end - after
    upto = np.cumsum(size)
    at = 0
    while at < len(size):
        stop = max(int(np.searchsorted(upto, (upto[at - 1] if at else 0) + CHUNK, side="right")), at + 1)
        own = size[at:stop]
        ends = np.cumsum(own)
        yield np.repeat(np.arange(at, stop), own), np.repeat(after[at:stop] - ends + own, own) + np.arange(ends[-1])
        at = stop


def _compare(table: pa.Table) -> pa.Table:
    """Pairs of ids that share a bucket in some block of a group of buckets, as far as components, sizes and sketches leave them open.

    A row is an id with all its buckets of the group, so a pair that shares many of them is compared once and told once.
    """
    table = table.combine_chunks()
    ids, n, part, lowest, i, j, home = (table[c].to_numpy() for c in ("id", "n", "component", "low", "i", "j", "own"))
    # Rows that share an id may have different texts; each is told by its sketch.
    marks = np.array([xxhash.xxh64_intdigest(x.as_py()) for x in table["sketch"]], np.uint64)
    _, first, line = np.unique(np.stack([ids.view(np.uint64), marks], axis=1), axis=0, return_index=True, return_inverse=True)
    names, line = ids[first], line.reshape(-1)
    lists = table["buckets"].combine_chunks()
    row = np.repeat(np.arange(table.num_rows), np.diff(lists.offsets.to_numpy()))
    bucket = lists.flatten().to_numpy()
    _, block = np.unique(np.stack([lowest, i, j], axis=1), axis=0, return_inverse=True)
    block = block.reshape(-1)
    order = np.lexsort((row, part[row], block[row], bucket))
    bucket, row = bucket[order], row[order]
    found = np.zeros(0, np.int64)
    for left, right in _meetings(bucket, block[row], part[row]):
        p, q = row[left], row[right]
        x, y = n[p], n[q]
        # Rows of one block of ids meet where both sides are that block.
        keep = ((i[p] == j[p]) | (home[p] != home[q])) & (4 * np.minimum(x, y) >= 3 * np.maximum(x, y))
        p, q = line[p[keep]], line[q[keep]]
        found = np.unique(np.concatenate([found, np.minimum(p, q) * len(names) + np.maximum(p, q)]))
    sketch, result = table["sketch"], []
    for at in range(0, len(found), CHUNK // 32):
        p, q = found[at : at + CHUNK // 32] // len(names), found[at : at + CHUNK // 32] % len(names)
        known = {k: sketch[int(first[k])].as_py() for k in np.union1d(p, q).tolist()}
        keep = may_link([known[k] for k in p.tolist()], [known[k] for k in q.tolist()], n[first[p]], n[first[q]])
        result.append(np.stack([names[p[keep]], names[q[keep]]], axis=1))
    pairs = np.concatenate(result) if result else np.zeros((0, 2), np.int64)
    return pa.table({"a": pairs.min(axis=1), "b": pairs.max(axis=1)})


def _placed(members: DataFrame, named: DataFrame) -> DataFrame:
    return members.join(named, "id", "left").withColumn("component", F.coalesce("component_id", "id")).drop("component_id")


def _split(members: DataFrame, named: DataFrame) -> DataFrame:
    """Buckets whose ids are not yet one component, each with its lowest one (``low``) and the most ``pairs`` of ids of two components that it may hold."""
    counts = _placed(members, named).groupBy("bucket", "component").agg(F.count("*").alias("n"))
    sizes = counts.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.sum("n").alias("size"), F.max("n").alias("most"))
    open_ = sizes.filter("low <> high AND size > 2")
    return written(open_.select("bucket", "low", (F.col("size").cast("double") * (F.col("size") - F.col("most"))).alias("pairs")), "jaccard-split")


def _inside(members: DataFrame, named: DataFrame, split: DataFrame) -> DataFrame:
    """The ids of open buckets; an id stands once for all of them that have one lowest component. Those that are ``crowded`` aren't listed, only told."""
    inside = _placed(members, named).join(split.select("bucket", "low", "crowded"), "bucket")
    listed = F.collect_set(F.when(~F.col("crowded"), F.col("bucket")))
    return written(inside.groupBy("low", "id").agg(F.min("component").alias("component"), listed.alias("buckets"), F.max("crowded").alias("crowded")), "jaccard-inside")


def _rounds(members: DataFrame, rows: DataFrame, named: DataFrame, slots: int, worth: float) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Ids of open buckets and these buckets, without those of common keys as far as rarer keys take their place; the pairs that rarer keys bring.

    A shingle that many unlike texts share makes a bucket that grows with the input, and its pairs with the square of that. Texts in such
    buckets are given keys once more, with the common ones behind all others. Two linked texts that share no other bucket are both among them, and share
    one of the new keys. That goes on while new common keys have more than ``worth`` pairs; what then is left of them is compared like any bucket.
    """
    spark = rows.sparkSession
    common, inside, splits, pairs = np.zeros(0, np.int64), [], [], []
    while True:
        split, least = _split(members, named), COMMON
        while (crowded := split.filter(F.col("pairs") > float(least) ** 2)).count() > MOST_COMMON:
            least *= 2
        crowded = crowded.select("bucket", "pairs").toArrow()
        names = crowded["bucket"].to_numpy()
        new = ~np.isin(names, common)
        if crowded["pairs"].to_numpy()[new].sum() <= worth:
            break
        names = names[new]
        found = spark.createDataFrame(pa.table({"bucket": names})).withColumn("found", F.lit(True))
        split = split.join(F.broadcast(found), "bucket", "left").withColumn("crowded", F.coalesce("found", F.lit(False)))
        inside.append(_inside(members, named, split))
        splits.append(split.filter(~F.col("crowded")).select("low", "pairs"))
        again = written(inside[-1].filter("crowded").select("id").distinct(), "jaccard-ids")
        common = np.union1d(common, names)
        met = _met(rows.join(F.broadcast(again) if again.count() <= FEW else again, "id", "left_semi"), slots, common)
        members = _members(met)
        pairs.append(_pairs(met))
    inside.append(_inside(members, named, split.withColumn("crowded", F.lit(False))))
    splits.append(split.select("low", "pairs"))
    return reduce(DataFrame.unionByName, inside), reduce(DataFrame.unionByName, splits), reduce(DataFrame.unionByName, pairs) if pairs else None


def _second(members: DataFrame, sketches: DataFrame, named: DataFrame) -> DataFrame:
    """Pairs of ids that share a bucket whose ids are not yet one component, as far as their sketches leave them open."""
    split = _split(members, named).withColumn("crowded", F.lit(False))
    return _compared(_inside(members, named, split), split, sketches)


def _compared(inside: DataFrame, split: DataFrame, sketches: DataFrame) -> DataFrame:
    """Pairs of ids that share one of these open buckets, as far as their sketches leave them open.

    Buckets with one lowest component make a group: copies of one text or passage share many buckets, so an id travels
    once for all of them, with its sketch, and a pair is compared and told once. The ids of a group are compared in blocks, so a large one is spread
    over many tasks. The number of tasks' portions follows the counted rows, bytes and pairs, so none grows with the input.
    """
    open_ = written(inside.filter(F.size("buckets") > 0).groupBy("low", "id").agg(F.min("component").alias("component"), F.array_distinct(F.flatten(F.collect_list("buckets"))).alias("buckets")), "jaccard-open")
    # Rows that share an id and a text are one.
    chosen = written(sketches.join(open_.select("id").distinct(), "id", "left_semi").distinct(), "jaccard-open-sketches")
    weights = chosen.groupBy("id").agg(F.count("*").alias("lines"), F.sum(F.octet_length("sketch") + ROW).alias("bytes"))
    counted = open_.select("low", "id", F.size("buckets").cast("long").alias("entries")).join(weights, "id")
    sums = counted.groupBy("low").agg(F.sum("lines").alias("lines"), F.sum(F.col("bytes") + 8 * F.col("entries") * F.col("lines")).alias("bytes"), F.count("*").alias("ids"))
    # What rows that share an id add to the pairs.
    pairs = split.groupBy("low").agg(F.sum("pairs").alias("pairs"))
    shared = sums.join(pairs, "low").withColumn("pairs", F.col("pairs") * F.pow(F.col("lines") / F.col("ids"), 2))
    blocked = written(shared.withColumn("blocks", F.ceil(F.greatest(F.col("lines") / BLOCK, F.col("bytes") / BLOCK_BYTES)).cast("long")), "jaccard-blocks")
    slots = _slots_of(blocked)
    rows = open_.join(blocked.select("low", "blocks"), "low").join(chosen, "id").withColumn("own", F.pmod(F.xxhash64("id", "n", "sketch"), F.col("blocks")))
    # A row meets every block of its group once: as the smaller or the larger number of the pair of blocks.
    paired = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    dealt = paired.select("low", "i", "j", "own", "id", "component", "n", "sketch", "buckets").withColumn("slot", F.pmod(F.xxhash64("low", "i", "j"), F.lit(slots)))
    return dealt.repartition(slots, "slot").groupBy("slot").applyInArrow(lean(_compare), "a long, b long").distinct()


def _slots_of(blocked: DataFrame) -> int:
    """Portions for the blocks of open groups, so that each holds about ``GROUP`` bytes of rows and ``PAIRS`` pairs, however much work there is; blocks share that out."""
    spark = blocked.sparkSession
    moved, pairs = blocked.agg(F.sum(F.col("bytes").cast("double") * F.col("blocks")), F.sum("pairs")).first()
    return max(width(spark, 0, 1) * 4, width(spark, moved or 0, GROUP), width(spark, pairs or 0, PAIRS))


def _known(links: DataFrame) -> DataFrame:
    """Components as a table, to be broadcast if the ids are few enough."""
    named = components(links)
    return F.broadcast(named) if named.count() <= FEW else named


def _apart(pairs: DataFrame, named: DataFrame) -> DataFrame:
    """The pairs whose ids are not known to be in one component."""
    for side in ("a", "b"):
        pairs = pairs.join(named.select(F.col("id").alias(side), F.col("component_id").alias(f"c_{side}")), side, "left")
    return pairs.filter(F.coalesce("c_a", "a") != F.coalesce("c_b", "b")).select("a", "b")


def _links(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """Those of the pairs that link; their sets are dropped once that is known."""
    with staging(rows.sparkSession):
        return written(verify(pairs, _sets(rows, _ids(pairs))), "jaccard-links", outlives=True)


def without(df: DataFrame, ids: DataFrame, row: str = "doc_id") -> DataFrame:
    """The rows whose id is not among ``ids``, rows without id included; texts are shuffled only if the ids are too many to broadcast."""
    ids = written(ids.distinct(), "jaccard-dropped")
    return df.join(F.broadcast(ids) if ids.count() <= FEW else ids, row, "left_anti")


def similar_groups(df: DataFrame, row: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` (or ``row``), ``n_shingles`` and ``component_id`` of each row: the smallest id reachable by links at 3/4 similarity.

    Texts without words, null ones too, have an empty set and link with nothing; shorter ones than a shingle are one shingle. Equal
    texts link like others. Rows that share an id are one node, each with its own size; a null id takes no part and has a
    null component. An empty table gives an empty result.

    One pass over the text makes packed sketch keys, which are the one large shuffle, and short sketches. Pairs that these leave open are verified on whole
    sets, first one partner for each id, then the other pairs with a bucket's smallest id, then the rest of open buckets, each time only what is still in different components. Texts in crowded buckets first get rarer keys. Links are complete: every two ids that
    share a bucket are compared, unless they are already known to be one component or share a rarer key whenever they link.
    """
    spark = df.sparkSession
    rows = df.select(F.col(row).cast("long").alias("id"), text_bytes(text).alias("text"))
    n, size = df.agg(F.count("*"), F.sum(F.octet_length(F.col(text)))).first()
    slots = width(spark, size or 0, GROUP)
    with staging(spark):
        met = _met(rows, slots)
        # Of texts that share an id any may link: their sizes and sketches all count.
        sketches = met.filter(F.col("kind") == SIZE).select(F.col("a").alias("id"), F.col("b").alias("n"), "sketch")
        pairs = written(still_open(_pairs(met).distinct(), sketches).distinct(), "jaccard-pairs")

        first = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
        links = _links(first, rows)
        rest = written(_apart(pairs, _known(links)).join(first, ["a", "b"], "left_anti"), "jaccard-pairs")
        links = links.unionByName(_links(rest, rows))
        named = _known(links)
        inside, split, rarer = _rounds(_members(met), rows, named, slots, WORTH * n)
        more = _compared(inside, split, sketches)
        if rarer:
            more = more.unionByName(still_open(_apart(rarer.distinct(), named).join(pairs, ["a", "b"], "left_anti"), sketches)).distinct()
        more = written(more.join(pairs, ["a", "b"], "left_anti"), "jaccard-pairs")
        named = components(links.unionByName(_links(more, rows)))
        sizes = met.filter(F.col("kind") == SIZE).select(F.col("a").alias("id"), F.col("b").alias("n_shingles"))
        known = sizes.join(named, "id", "left").select(F.col("id").alias(row), "n_shingles", F.coalesce("component_id", "id").alias("component_id"))
        nameless = met.filter(F.col("kind") == NAMELESS).select(F.lit(None).cast("long").alias(row), F.col("b").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))
        return written(known.unionByName(nameless), "jaccard-groups", outlives=True)


def _free(name: str, taken: list[str]) -> str:
    """A column name that isn't taken; names are compared as Spark does, without regard to case."""
    used = {t.lower() for t in taken}
    while name.lower() in used:
        name += "_"
    return name


def drop_near_duplicates(df: DataFrame, row: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of similar texts, with all columns: the one with the smallest id, nulls last.

    Rows are told apart by id and text, so a text that merely shares an id with a copy stays. Of rows that repeat id and text one
    stays, the least by its columns. Texts without words are linked with nothing and all stay. Further columns may have any names; an empty table gives an empty result.
    Only rows that are repeated as a whole are grouped; the others are filtered where they lie, if the dropped ones are few enough to broadcast.
    """
    key = _free("_key", df.columns)
    keyed = df.withColumn(key, F.xxhash64(F.col(row), F.col(text)))
    groups = similar_groups(keyed, key, text)
    rows = groups.filter("n_shingles > 0").groupBy(F.col(key).alias("k")).agg(F.count("*").alias("rows"), F.min("component_id").alias("component"))
    ids = keyed.select(F.col(key).alias("id_key"), F.col(row).alias("id")).distinct()
    named = written(rows.join(ids, F.col("k") == F.col("id_key")).select("k", "rows", "component", "id"), "jaccard-named")
    best = named.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "k")).alias("best"), F.count("*").alias("n"))
    gone = named.join(best.filter("n > 1").select(F.col("component").alias("c"), F.col("best.k").alias("stays")), F.col("component") == F.col("c")).filter("k <> stays")
    kept = without(keyed, gone.select(F.col("k").alias(key)), key)
    repeated = named.filter("rows > 1").join(gone.select(F.col("k").alias("g")), F.col("k") == F.col("g"), "left_anti").select(F.col("k").alias(key))
    if not repeated.head(1):
        return kept.select(*df.columns)
    repeated = written(repeated.distinct(), "jaccard-repeated")
    ones = kept.join(repeated, key, "left_semi").groupBy(key).agg(F.min(F.struct(*df.columns)).alias("one")).select("one.*")
    return without(kept, repeated, key).select(*df.columns).unionByName(ones)
