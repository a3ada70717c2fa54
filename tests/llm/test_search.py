import math
import random

from segtide.llm import mtree

VECTORS = "vec_id bigint, embedding array<float>, label int"


def brute(rows, k, scale, every):
    """Scores of all pairs."""
    whole = {(i, tuple(math.floor(scale * x) for x in v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    found = []
    for q in {i for i, _ in whole if i % every == 0}:
        scores = [(-sum(x * y for x, y in zip(a, b, strict=True)), j) for i, a in whole if i == q for j, b in whole if j != q and len(a) == len(b)]
        found += [(q, n + 1, j, -s) for n, (s, j) in enumerate(sorted(scores)[:k])]
    return sorted(found)


def search(spark, rows, k=3, scale=64, every=20):
    df = spark.createDataFrame([(*r, 0) for r in rows], VECTORS)
    return sorted(tuple(r) for r in mtree.top_k(df, k, scale, every).collect())


def test_ties_copies_and_odd_vectors(spark):
    rows = [(i, [1.0, 0.5]) for i in range(45)]  # all alike: ties go to smaller ids
    rows += [(100, None), (120, [None, 1.0]), (140, [float("nan"), 1.0]), (160, [float("inf"), 1.0]), (180, []), (None, [1.0, 1.0])]
    rows += [(200, [1.0, 2.0, 3.0]), (201, [0.0, 0.0, 0.0])]  # another length
    rows += [(7, [1.0, 0.5]), (40, [2.0, -1.0])]  # a repeated row; an id with two vectors
    assert search(spark, rows) == brute(rows, 3, 64, 20)


def test_fewer_candidates_than_asked(spark):
    rows = [(0, [1.0]), (1, [2.0])]
    assert search(spark, rows, k=5) == [(0, 1, 1, 64 * 128)]
    assert search(spark, [(0, [1.0])]) == []
    assert search(spark, []) == []


def test_many_pages_and_trees(spark, monkeypatch):
    random.seed(3)
    centres = [[random.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    rows = [(i, [random.gauss(c, 0.2) for c in random.choice(centres)]) for i in range(1500)]
    rows += [(2000 + i, [5.0] * 6) for i in range(400)]  # one very common vector
    monkeypatch.setattr(mtree, "TREE", 200)
    monkeypatch.setattr(mtree, "LEAF", 16)
    assert search(spark, rows, k=10) == brute(rows, 10, 64, 20)


def test_best_first_search_skips_pages(monkeypatch):
    import numpy as np

    monkeypatch.setattr(mtree, "LEAF", 64)

    rng = np.random.default_rng(0)
    centres = rng.integers(-500, 500, (20, 8))
    vectors = (centres[rng.integers(0, 20, 4000)] + rng.integers(-3, 4, (4000, 8))).astype(np.int64)
    tree = mtree.MTree(np.arange(4000), vectors)
    looked = []
    inner = tree.products
    tree.products = lambda rows, query, exact: looked.append(inner(rows, query, exact)) or looked[-1]
    ids, scores = tree.search(vectors[17], 17, 20)
    every = vectors @ vectors[17]
    order = [i for i in np.lexsort((np.arange(4000), -every)) if i != 17][:20]
    assert sorted(zip(ids.tolist(), scores.tolist(), strict=True)) == sorted((i, int(every[i])) for i in order)
    assert sum(map(len, looked)) < 2500


def test_pages_of_copies_and_whole_numbers():
    import numpy as np

    vectors = np.concatenate([np.full((1500, 3), 2**30), np.random.default_rng(1).integers(-(2**30), 2**30, (1500, 3))]).astype(np.int64)
    tree = mtree.MTree(np.arange(3000), vectors)
    for q in (0, 1700, 2999):
        ids, scores = tree.search(vectors[q], q, 15)
        every = vectors @ vectors[q]
        order = [i for i in np.lexsort((np.arange(3000), -every)) if i != q][:15]
        assert sorted(zip(ids.tolist(), scores.tolist(), strict=True)) == sorted((i, int(every[i])) for i in order)


def test_large_components_stay_exact(spark):
    rows = [(0, [3.0e7, 1.0]), (1, [3.0e7, 2.0]), (2, [3.0e7, -5.0]), (3, [1e30, 0.0])]
    assert search(spark, rows) == [r for r in brute(rows[:3], 3, 64, 20)]


def test_products_beyond_64_bits_are_refused(spark):
    import pytest

    with pytest.raises(ValueError, match="64 bits"):
        search(spark, [(0, [6.0e7, 1.0]), (1, [6.0e7, 2.0])], scale=64)


def test_a_hot_region_divides_by_distance(spark, monkeypatch):
    """Most vectors lie in one region; its trees are small and tight, and only copies are dealt by hash."""
    import numpy as np

    rng = random.Random(5)
    centres = [[rng.gauss(0, 40) for _ in range(4)] for _ in range(30)]
    rows = [(i, [rng.gauss(c, 0.3) for c in rng.choice(centres)]) for i in range(3000)] + [(5000 + i, [9.0] * 4) for i in range(700)]
    monkeypatch.setattr(mtree, "TREE", 200)
    monkeypatch.setattr(mtree, "PIVOTS", 1)
    df = spark.createDataFrame([(i, 5, np.floor(64 * np.array(v, np.float32).astype(float)).astype(np.int64).tobytes()) for i, v in rows], "id long, region long, vector binary")
    trees = {}
    for r in mtree.fitted(df).collect():
        trees.setdefault(r["tree"], []).append(np.frombuffer(r["vector"], np.int64))
    assert sum(map(len, trees.values())) == len(rows)
    others = [np.array(t) for t in trees.values() if len(np.unique(t, axis=0)) > 1]
    assert max(map(len, trees.values())) <= 300  # parts by hash come near the bound, parts by distance keep it
    spread = lambda t: np.sqrt(((t - t.mean(axis=0)) ** 2).sum(axis=1)).max()
    assert np.median([spread(t) for t in others]) < 0.2 * spread(np.concatenate(others))

    assert search(spark, rows, k=10) == brute(rows, 10, 64, 20)


def test_columns_of_any_name(spark):
    from pyspark.sql import functions as F

    rows = [(i, [1.0, i / 7]) for i in range(50)]
    df = spark.createDataFrame([(*r, 0) for r in rows], VECTORS)
    for name in ("id", "vector", "region", "tree", "score", "rank", "query_id", "n", "above", "pages", "packs", "slot"):
        df = df.withColumn(name, F.lit("x"))
    assert sorted(tuple(r) for r in mtree.top_k(df, 3, 64, 20).collect()) == brute(rows, 3, 64, 20)
