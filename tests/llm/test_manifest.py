import hashlib
import random
import zlib

import pytest

from segtide.llm import merkle_manifest
from segtide.llm.merkle_manifest import Block, combined, fold

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    shown = [None if v is None else str(v) for v in (doc_id, source, lang, n_chars, text)]
    return h(*["-" if v is None else f"{len(v.encode())}:{v}" for v in shown])


def climb(digests):
    """All levels from the given one to the single node."""
    levels = [digests]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][k : k + 2]) for k in range(0, len(levels[-1]), 2)])
    return levels


def path(levels, at):
    for level in levels[:-1]:
        yield at, level[at - at % 2 : at - at % 2 + 2]
        at //= 2


def expected(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: climb([leaf(*r) for r in rows if r[2] == x]) for x in langs}
    top = climb([trees[x][-1][0] for x in langs])
    found = []
    for k, x in enumerate(langs):
        for at, r in enumerate(r for r in rows if r[2] == x):
            changed = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            folded, siblings = leaf(*r[:4], r[4] + 1) if changed else leaf(*r), []
            for place, run in (*path(trees[x], at), *path(top, k)):
                siblings += [d for j, d in enumerate(run) if j != place % 2]
                folded = h(*[folded if j == place % 2 else d for j, d in enumerate(run)])
            found.append((r[0], leaf(*r), trees[x][-1][0], top[-1][0], h(*siblings), folded, folded == top[-1][0]))
    return sorted(found, key=repr)


def got(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


def strange(n, langs, seed=4):
    rng = random.Random(seed)
    return [(rng.choice([None, k, k, k, k]), rng.choice([None, "", "teéxt", "1:a-", "x" * rng.randint(0, 50)]), rng.choice(langs), rng.choice([None, "", "s"]), rng.choice([None, 0, k])) for k in range(n)]


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 13, 64, 100])
def test_paths_of_a_block(n):
    digests = [hashlib.sha256(bytes([k])).digest() for k in range(n)]
    block = Block(64, digests, (n - 1).bit_length())
    assert block.top.hex() == climb([d.hex() for d in digests])[-1][0]
    assert [fold(d, p) for d, p in zip(digests, block.paths(), strict=True)] == [block.top] * n
    for (lows, highs, _), (above, ends, _) in zip(block.levels, block.levels[1:]):
        assert above[0] == lows[0] == 64 and ends[-1] == highs[-1] == 64 + n and (above[1:] == ends[:-1]).all()
    assert combined([]) == hashlib.sha256(b"").digest()


@pytest.mark.parametrize("levels", [1, 2, 8])
def test_strange_tables(spark, monkeypatch, levels):
    """Blocks of two and four nodes give many bands."""
    monkeypatch.setattr(merkle_manifest, "LEVELS", levels)
    for name in ("_tops", "_paths", "_proofs"):
        inner = getattr(merkle_manifest, name)

        def patched(row, inner=inner):  # the workers import the module anew
            merkle_manifest.LEVELS = levels
            return inner(row)

        monkeypatch.setattr(merkle_manifest, name, patched)
    rows = strange(60, ["en", "en", "en", None, "", "dé"]) + [(3, "same", "en", "s", 4)] * 5
    assert got(merkle_manifest.manifest(spark.createDataFrame(rows, SCHEMA))) == expected(rows)


@pytest.mark.parametrize("levels", [2, 5])
def test_workers_cut_blocks_as_the_driver_does(spark, monkeypatch, levels):
    """Whatever a worker's module holds, as one that lives on may hold another number."""
    monkeypatch.setattr(merkle_manifest, "LEVELS", levels)
    rows = strange(80, ["en", "en", None])
    assert got(merkle_manifest.manifest(spark.createDataFrame(rows, SCHEMA))) == expected(rows)


def test_one_language_with_most_documents(spark):
    rows = strange(900, ["en"] * 30 + [f"l{k}" for k in range(300)])
    assert got(merkle_manifest.manifest(spark.createDataFrame(rows, SCHEMA))) == expected(rows)


def test_odd_tables(spark, clashing):
    assert merkle_manifest.manifest(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(14, "t" * 300_000, "en", "s", 2**63 - 1), (14, "t" * 300_000, "en", "s", 2**63 - 1), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("tree", "n", "rank", "digest", "block", "doc", "tampered", "copy", "leaf", "subroot", "root", "above", "top", "_at"):
        df = df.selectExpr("*", f"'x' AS {name}")
    assert got(merkle_manifest.manifest(df)) == expected(rows)
    assert got(merkle_manifest.manifest(spark.createDataFrame(rows[2:], SCHEMA))) == expected(rows[2:])


def test_registered_manifest(spark, sf):
    queries = pytest.importorskip("segtide.llm.queries")
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    found = got(queries.merkle_manifest_query(spark, sf))
    assert found == expected(rows)
    assert {r[6] for r in found} == {True, False}
