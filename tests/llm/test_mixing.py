import random

import pytest

from segtide.llm import mixing

SOURCES = ["b", "a", None, "\U0001f600", "�", "c", "a"]


def brute_targets(sizes, weights, share, most):
    """Sharing again and again until no source is above its cap."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, found = share * sum(sizes.values()), {}
    while True:
        rest = total - sum(found.values())
        open_ = [s for s in names if s not in found]
        level = rest / sum(weight[s] for s in open_) if open_ else 0
        above = [s for s in open_ if level * weight[s] >= most * sizes[s]]
        if not above:
            return found | {s: level * weight[s] for s in open_}
        found |= {s: most * sizes[s] for s in above}


def words(n, rng):
    return " ".join(f"w{rng.randint(0, 99)}" for _ in range(n))


def test_targets_stop_at_the_cap(spark):
    rng = random.Random(1)
    for _ in range(5):
        sizes = {s: rng.choice([0, 3, 10, 1000, 5000]) for s in SOURCES}
        df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size bigint")
        got = {r["source"]: r["target"] for r in mixing.targets(df, (5, 2, 1), 1.5, 2.0).collect()}
        assert got == pytest.approx(brute_targets(sizes, (5, 2, 1), 1.5, 2.0))


def test_sources_come_near_their_targets(spark, documents):
    rng = random.Random(2)
    rows = [(i, words(rng.randint(1, 40), rng), "en", rng.choice(["hot"] * 5 + SOURCES)) for i in range(3000)]
    df = documents(rows)
    found = mixing.shares(df, (5, 2, 1), 1.5, 2.0).collect()
    assert len(found) == len(rows)
    source = {r[0]: r[3] for r in rows}
    sizes, taken, goal = {}, {}, {}
    for r in found:
        s = source[r["doc_id"]]
        assert r["size"] == len(rows[r["doc_id"]][1].split())
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        sizes[s], taken[s], goal[s] = sizes.get(s, 0) + r["size"], taken.get(s, 0) + r["taken"], r["target"]
    assert goal == pytest.approx(brute_targets(sizes, (5, 2, 1), 1.5, 2.0))
    assert all(abs(taken[s] - goal[s]) <= 40 for s in sizes)
    assert sorted(map(tuple, mixing.shares(df.repartition(3), (5, 2, 1), 1.5, 2.0).collect())) == sorted(map(tuple, found))


def test_rows_stand_as_often_as_taken(spark, clashing):
    rng = random.Random(3)
    rows = [(i, words(5, rng), "en", rng.choice("ab")) for i in range(200)]
    rows += [(1000, None, "en", "a"), (1001, "", "en", "b"), (None, "n n n", "en", None), (None, "m m", None, None), (5, *rows[5][1:]), (6, "another text", "en", "a")]
    df = clashing(rows)
    copies = {}
    for r in mixing.shares(df, (5, 2, 1), 1.5, 2.0).collect():
        copies[r["doc_id"]] = copies.get(r["doc_id"], 0) + r["copies"]
    mixed = mixing.mix(df, (5, 2, 1), 1.5, 2.0)
    assert mixed.columns == df.columns
    counted = {}
    for r in mixed.collect():
        counted[r["doc_id"]] = counted.get(r["doc_id"], 0) + 1
    assert counted == {i: c for i, c in copies.items() if c}
    assert copies[1000] == copies[1001] == 0
    assert mixing.shares(clashing([]), (5, 2, 1), 1.5, 2.0).collect() == []
    assert mixing.mix(clashing([]), (5, 2, 1), 1.5, 2.0).collect() == []


def test_expectations_are_kept(spark):
    """Over 400 sources alike, drawn on their own, each document is taken as often as its share, within three standard errors, and each source's words come near the target."""
    rng = random.Random(4)
    sizes, n = [float(rng.randint(1, 9)) for _ in range(20)], 400
    rows = [(20 * s + i, f"s{s}", int(x)) for s in range(n) for i, x in enumerate(sizes)]
    goals = [(f"s{s}", int(sum(sizes)), 0.3 * sum(sizes)) for s in range(n)]
    drawn = mixing.copies(spark.createDataFrame(rows, "row bigint, source string, size bigint"), spark.createDataFrame(goals, "source string, source_size bigint, target double"))
    taken, words_of = [0] * 20, [0.0] * n
    for r in drawn.collect():
        assert r["copies"] in (0, 1)
        taken[r["row"] % 20] += r["copies"]
        words_of[r["row"] // 20] += r["copies"] * sizes[r["row"] % 20]
    error = (0.3 * 0.7 / n) ** 0.5
    assert all(abs(t / n - 0.3) <= 3 * error for t in taken)
    assert all(abs(w - 0.3 * sum(sizes)) <= max(sizes) for w in words_of)


def test_pivotal_steps_settle_one(spark):
    from pyspark.sql import functions as F

    state = F.struct(F.struct(F.lit(1).cast("long").alias("row"), F.col("s").alias("size"), F.col("p")).alias("open"), F.array().cast("array<struct<row: bigint, size: double, p: double>>").alias("done"))
    new = F.struct(F.col("n").alias("row"), F.col("t").alias("size"), F.col("q").alias("p"))
    rng = random.Random(5)
    rows = [(n, float(rng.randint(1, 9)), rng.random(), float(rng.randint(1, 9)), rng.random()) for n in range(2, 300)] + [(1, 2.0, 0.5, 2.0, 0.5)]
    df = spark.createDataFrame(rows, "n bigint, s double, p double, t double, q double")
    for r in df.select("*", mixing._pair(state, new, 0).alias("r")).collect():
        settled, still = r["r"]["done"][0], r["r"]["open"]
        assert settled["p"] in (0.0, 1.0) and 0 <= still["p"] <= 1
        assert settled["size"] * settled["p"] + still["size"] * still["p"] == pytest.approx(r["s"] * r["p"] + r["t"] * r["q"])
