import hashlib
import random
import tracemalloc
import uuid
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from segtide.llm import jaccard_join, substring_dedup
from segtide.llm.components import components
from tests.llm.conftest import texts_of


def shingle_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def brute_groups(rows):
    """Components by comparing every two rows with a shared shingle."""
    sets, holders = [shingle_set(t) for _, t in rows], defaultdict(list)
    parent = {i: i for i, _ in rows if i is not None}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for n, (i, _) in enumerate(rows):
        if i is None:
            continue
        common = defaultdict(int)
        for s in sets[n]:
            for m in holders[s]:
                common[m] += 1
            holders[s].append(n)
        for m, c in common.items():
            if 100 * c >= 75 * (len(sets[n]) + len(sets[m]) - c):
                a, b = find(i), find(rows[m][0])
                parent[max(a, b)] = min(a, b)
    return sorted(((i, len(s), None if i is None else find(i)) for (i, _), s in zip(rows, sets, strict=True)), key=repr)


def groups_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def groups(df):
    return groups_of(jaccard_join.similar_groups(df))


def edited(words, share, rng):
    return [w if rng.random() > share else f"new{rng.random()}" for w in words]


def test_groups_of_near_copies(spark, documents):
    """Copies around the threshold, chains, large groups, passages that many texts share."""
    rng = random.Random(7)
    word = lambda: f"w{rng.randint(0, 5000)}"
    rows, passage = [], [word() for _ in range(60)]
    for length in (1, 3, 5, 6, 8, 20, 60, 150, 400, 1500):
        for _ in range(3):
            base = [word() for _ in range(length)]
            rows += [" ".join(edited(base, share, rng)) for share in (0, 0, 0.01, 0.02, 0.03, 0.04, 0.06, 0.1)]
    chain = [word() for _ in range(200)]
    for _ in range(30):
        at = rng.randrange(190)
        chain = chain[:at] + [word() for _ in range(6)] + chain[at + 6 :]
        rows.append(" ".join(chain))
    hot = [word() for _ in range(120)]
    rows += [" ".join(edited(hot, 0.01, rng)) for _ in range(150)]
    rows += [" ".join([word() for _ in range(rng.randint(30, 90))] + passage) for _ in range(150)]
    rng.shuffle(rows)
    numbered = [(i, t) for i, t in enumerate(rows)]
    assert groups(documents(numbered)) == brute_groups(numbered)


def test_groups_of_odd_rows(spark, clashing):
    long = " ".join(f"t{i % 977}" for i in range(150_000))
    rows = [(1, None), (2, ""), (3, " \n"), (None, "a b c d e f"), (4, "A b C d e f"), (9, "a b c d e f"), (9, "a b c d e f"), (5, "one two"), (6, "ONE  two"), (7, "one two three"), (8, long), (10, long + " x"), (None, None)]
    assert groups(clashing(rows)) == brute_groups(rows)
    assert groups(clashing([])) == []


def test_rows_that_share_an_id_are_one_node(spark, documents):
    rows = [(1, "a b c d e f"), (5, "a b c d e f"), (5, "p q r s t u"), (7, "p q r s t u")]
    assert {r[2] for r in groups(documents(rows))} == {1}


def test_blocks_of_a_large_bucket(spark, documents, monkeypatch):
    """Second-round comparisons dealt in several blocks find what one block finds."""
    rng = random.Random(1)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(80):
        at = rng.randrange(60)
        rows.append((i, " ".join(base[:at] + [f"x{rng.randint(0, 3)}" for _ in range(rng.randint(1, 5))] + base[at + 3 :])))
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    assert groups(documents(rows)) == brute_groups(rows)


def test_groups_of_blocks_are_bounded(spark, monkeypatch):
    """More open rows make more groups, not larger ones; rows that share an id are dealt as well."""
    monkeypatch.setattr(jaccard_join, "_compare", lambda table: pa.table({"a": [table.num_rows], "b": [table["slot"][0].as_py()]}))
    monkeypatch.setattr(jaccard_join, "PAIRS", 1_000, raising=False)
    monkeypatch.setattr(jaccard_join, "BLOCK", 32)
    members = spark.createDataFrame([(1, i) for i in range(600)], "bucket long, id long")
    sketches = spark.createDataFrame([(i, 16, i.to_bytes(8, "big")) for i in range(600)] + [(7, 16, i.to_bytes(8, "big")) for i in range(1_000, 1_400)], "id long, n long, sketch binary")
    named = spark.createDataFrame([], "id long, component_id long")
    found = [r["a"] for r in jaccard_join._second(members, sketches, named).collect()]
    assert sum(found) >= 1_000 and max(found) <= 600


def test_texts_that_share_common_shingles_get_rarer_keys(spark, documents, monkeypatch, tmp_path):
    """Unlike texts with a passage in common aren't compared all with all; copies among them, and texts of hardly anything else, are still found."""
    rng = random.Random(11)
    word = lambda: f"w{rng.randint(0, 10**6)}"
    passages = [[word() for _ in range(12)] for _ in range(5)]
    bases = [[word() for _ in range(20)] + rng.choice(passages[:2]) + [word() for _ in range(10)] for _ in range(260)]
    rows = [" ".join(b) for b in bases] + [" ".join(edited(b, 0.03, rng)) for b in bases[:60]] + [" ".join(edited(b, 0.01, rng)) for b in bases[:60]]
    rows += [" ".join(edited([w for p in rng.sample(passages, 3) for w in p], 0.03, rng)) for _ in range(60)]
    rng.shuffle(rows)
    numbered = [(None if i == 50 else i, t) for i, t in enumerate(rows)] + [(7, rows[3]), (9, "a b c d e f"), (500, None)]
    monkeypatch.setattr(jaccard_join, "COMMON", 24, raising=False)
    monkeypatch.setattr(jaccard_join, "WORTH", 0, raising=False)
    old, where = jaccard_join._compare, str(tmp_path)

    def compare(table):
        size = defaultdict(int)
        for r in table.to_pylist():
            for b in r["buckets"]:
                size[r["low"], r["i"], r["j"], b] += 1
        with open(f"{where}/{uuid.uuid4()}", "w") as f:
            f.write(str(sum(n * (n - 1) // 2 for n in size.values())))
        return old(table)

    monkeypatch.setattr(jaccard_join, "_compare", compare)
    assert groups(documents(numbered)) == brute_groups(numbered)
    compared = sum(int(p.read_text()) for p in tmp_path.iterdir())
    assert 0 < compared < 40_000


def test_pairs_of_one_component_are_not_compared():
    """A large group of copies and a stray text in its buckets: as many pairs as copies, whichever has the lower id."""
    for stray in (0, 9):
        part = np.sort(np.array([5] * 400 + [stray]))
        bucket = np.zeros(401, np.int64)
        left, right = (np.concatenate(x) for x in zip(*jaccard_join._meetings(bucket, bucket, part), strict=True))
        assert len(left) == 400 and (part[left] != part[right]).all()


def test_pigeonhole_with_common_keys_behind():
    """Linked sets share a key whichever keys are common, and keep off those while they have others."""
    rng = np.random.default_rng(8)
    for n in [1, 3, 9, 30, 63, 64, 85, 200, 700]:
        for _ in range(12):
            common = rng.integers(0, 2**63, n, dtype=np.uint64)
            extra = int(rng.integers(0, n // 3 + 1))
            mine = int(rng.integers(0, extra + 1))
            other = rng.integers(0, 2**63, extra, dtype=np.uint64)
            a, b = np.unique(np.append(common, other[:mine])), np.unique(np.append(common, other[mine:]))
            if not jaccard_join.linked(a, b):
                continue
            plain, of = jaccard_join.keys_of([a, b])
            names = np.unique((plain & jaccard_join.LOW).view(np.int64))
            late = names[rng.random(len(names)) < rng.random()]
            keys, of = jaccard_join.keys_of([a, b], late)
            assert np.intersect1d(keys[of == 0], keys[of == 1]).size
    many = rng.integers(0, 2**63, 60, dtype=np.uint64)
    names = (jaccard_join.keys_of([np.unique(many)])[0] & jaccard_join.LOW).view(np.int64)
    again = (jaccard_join.keys_of([np.unique(many)], np.sort(names[:10]))[0] & jaccard_join.LOW).view(np.int64)
    assert len(again) == len(names) and not np.isin(names[:10], again).any()


def test_pigeonhole_on_sketch_parts():
    """Linked sets always share a key, also at the very threshold and across size bands."""
    rng = np.random.default_rng(3)
    for n in [1, 2, 3, 4, 5, 7, 9, 13, 30, 63, 64, 65, 84, 85, 86, 113, 200, 268, 700, 3000]:
        for _ in range(12):
            common = rng.integers(0, 2**63, n, dtype=np.uint64)
            most = n // 3
            extra = int(rng.integers(0, most + 1))
            mine = int(rng.integers(0, extra + 1))
            other = rng.integers(0, 2**63, extra, dtype=np.uint64)
            a, b = np.unique(np.append(common, other[:mine])), np.unique(np.append(common, other[mine:]))
            if not jaccard_join.linked(a, b):
                continue
            keys, of = jaccard_join.keys_of([a, b])
            assert np.intersect1d(keys[of == 0], keys[of == 1]).size


def test_sketches_bound_the_symmetric_difference():
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 2**63, 300, dtype=np.uint64), rng.integers(0, 2**63, 40, dtype=np.uint64)
    x, y = jaccard_join.short_sketches([np.unique(s) for s in (a, np.append(a[30:], b))])
    wide, narrow = (np.frombuffer(s, np.uint64)[None, :] for s in jaccard_join.short_sketches([rng.integers(0, 2**63, n, dtype=np.uint64) for n in (520, 500)]))
    assert (wide.shape[1], narrow.shape[1]) == (64, 32) and jaccard_join.folded(wide, 32).shape == narrow.shape
    apart = np.bitwise_count(np.frombuffer(x, np.uint64) ^ np.frombuffer(y, np.uint64)).sum()
    assert 0 < apart <= 70
    sets = [np.unique(rng.integers(0, 2**63, n, dtype=np.uint64)) for n in (600, 600)]
    near = [sets[0], np.unique(np.append(sets[0][40:], sets[1][:30]))]
    far = [sets[0], sets[1]]
    for s, expected in ((near, True), (far, False)):
        left, right = ([k] for k in jaccard_join.short_sketches(s))
        assert jaccard_join.may_link(left, right, np.array([len(s[0])]), np.array([len(s[1])])).tolist() == [expected]


@pytest.mark.parametrize("size", [0, 40])
def test_components_of_paths_and_stars(spark, size):
    rng = random.Random(size)
    ids = rng.sample(range(10_000), size + 1)
    links = list(zip(ids, ids[1:], strict=False)) + [(20_000, 20_000 + i) for i in range(1, size)] + [(20_001, 20_000)] * (size > 1) + [(5, 5)]
    got = {r["id"]: r["component_id"] for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    expected = dict.fromkeys(ids, min(ids)) if size else {}
    assert got == expected | ({20_000 + i: 20_000 for i in range(size)} if size > 1 else {})


def test_registered_groups(spark, sf):
    from segtide.llm.queries import jaccard_join_query

    assert groups_of(jaccard_join_query(spark, sf)) == brute_groups(texts_of(spark, sf))


def brute_kept(rows):
    """Words left of each row, by the definition."""
    order = lambda i: (i is None, i or 0)
    first = {}
    split = [(i, (t or "").encode().split()) for i, t in rows]
    for i, words in split:
        for k in range(len(words) - 19):
            window = tuple(words[k : k + 20])
            first[window] = min(first.get(window, ((True, 1), 0)), (order(i), k))
    found = []
    for i, words in split:
        gone = {p for k in range(len(words) - 19) if first[tuple(words[k : k + 20])] < (order(i), k) for p in range(k, k + 20)}
        kept = b" ".join(w for p, w in enumerate(words) if p not in gone)
        found.append((i, len(words), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(found, key=repr)


def kept(df):
    return sorted((tuple(r) for r in substring_dedup.remove_repeats(df, digest=True).collect()), key=repr)


def test_repeats_of_all_alignments(spark, documents):
    rng = random.Random(9)
    word = lambda n: [f"w{rng.randint(0, 10**6)}" for _ in range(n)]
    passages = [word(n) for n in (19, 20, 21, 29, 30, 55, 200)]
    rows = []
    for i in range(150):
        parts = []
        for _ in range(rng.randint(1, 4)):
            parts += word(rng.randint(0, 25)) + rng.choice(passages)
        rows.append((rng.randint(-50, 10**6) if i % 9 else i, "\n".join(parts)))
    rows.append((10**7, " ".join(["same"] * 500)))
    rows.append((10**7 + 1, " ".join(["a", "b"] * 300)))
    assert kept(documents(rows)) == brute_kept(rows)


def test_repeats_in_odd_rows(spark, clashing):
    text = " ".join(f"w{i}" for i in range(70))
    later = " ".join(f"w{i}" for i in range(30, 100))
    rows = [(1, None), (2, ""), (3, text), (3, text), (3, later), (4, "x " + text), (None, later), (None, text), (5, "few words"), (6, text + " " + text), (7, " ".join(f"v{i % 5000}" for i in range(120_000)))]
    assert kept(clashing(rows)) == brute_kept(rows)
    assert kept(clashing([])) == []
    texts = {(r["doc_id"], r["n_removed"]): r["kept_text"] for r in substring_dedup.remove_repeats(clashing(rows[:6]), keep=["doc_id", "rank", "lists"]).collect()}
    assert texts[(3, 0)] == later and texts[(3, 40)] == " ".join(f"w{i}" for i in range(30)) and texts[(4, 70)] == "x" and texts[(2, 0)] == ""


def test_places_survive_packing():
    rng = np.random.default_rng(2)
    rows = np.sort(rng.integers(0, 5, 400)).astype(np.int64)
    places = np.concatenate([np.sort(rng.choice(400_000, (rows == r).sum(), replace=False)) for r in range(5)])
    ids, runs, gaps = substring_dedup.packed(rows, places)
    assert np.array_equal(substring_dedup.unpacked(runs, gaps), places)
    assert np.array_equal(np.repeat(np.frombuffer(ids, np.int64), substring_dedup.from_planes(runs, np.int32)), rows)
    assert substring_dedup.packed(rows[:0], places[:0]) == (b"", b"", b"")


def test_registered_repeats(spark, sf):
    from segtide.llm.queries import substring_dedup_query

    assert sorted((tuple(r) for r in substring_dedup_query(spark, sf).collect()), key=repr) == brute_kept(texts_of(spark, sf))


@pytest.mark.parametrize("step, most", [("_probe", 17), ("_windows", 23)])
def test_one_portion_is_freed_before_the_next(monkeypatch, step, most):
    """A worker holds little more than one portion's arrays: some 13 and 18 times its bytes."""
    monkeypatch.setattr(substring_dedup, "PORTION", 1_000_000)
    rng = random.Random(1)
    vocabulary = [b"w%d" % k for k in range(3000)]
    texts = [b" ".join(rng.choices(vocabulary, k=300)) for _ in range(3000)]
    ids = pa.array(range(len(texts)), pa.int64())
    places = pa.array([np.arange(250, dtype=np.int32).tobytes()] * len(texts), pa.binary())
    columns = {"rank": ids, "row": ids, "places": places, "text": pa.array(texts, pa.binary())}
    batch = pa.RecordBatch.from_pydict(columns).select(["row", "text"] if step == "_probe" else list(columns))
    tracemalloc.start()
    try:
        given = sum(len(b.column("keys")) for b in getattr(substring_dedup, step)(8)(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert given and peak < most * substring_dedup.PORTION


def test_few_pairs_are_held_at_once():
    rng, n, shared = np.random.default_rng(3), 512, list(range(30))
    sketches = [rng.bytes(128) for _ in range(n)]
    table = pa.table({
        "low": pa.array([0] * n, pa.int64()), "i": pa.array([0] * n, pa.int64()), "j": pa.array([0] * n, pa.int64()), "own": pa.array([0] * n, pa.int64()),
        "id": pa.array(range(n), pa.int64()), "component": pa.array(range(n), pa.int64()), "n": pa.array([100] * n, pa.int64()),
        "sketch": pa.array(sketches, pa.binary()), "buckets": pa.array([shared] * n, pa.list_(pa.int64())),
    })
    tracemalloc.start()
    try:
        found = jaccard_join._compare(table)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    expected = {
        (a, b) for a in range(n) for b in range(a + 1, n)
        if 7 * np.bitwise_count(np.frombuffer(sketches[a], np.uint64) ^ np.frombuffer(sketches[b], np.uint64)).sum() <= 200
    }
    assert set(zip(*(found[c].to_pylist() for c in "ab"), strict=True)) == expected
    # 3.9 million pairs share a bucket.
    assert peak < 40e6
