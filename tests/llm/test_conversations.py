import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest

from segtide.llm import conversation_repair
from segtide.llm.conversation_repair import Automaton

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
WHITE = "\t\n\x0b\x0c\r "
COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def damaged(rows):
    for conv, turn, role, text in rows:
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if fate == 1:
            text = ""
        if fate == 2:
            text = re.sub("[.!?]", "", text)
        if fate == 4:
            role = "user"
        yield from [(conv, turn, role, text)] * {0: 0, 3: 2}.get(fate, 1)


def cheapest(symbols):
    """All ways from left to right, by cost and then by the audit itself. A symbol is (role initial, has to go, truncated)."""
    places = {"": "su", "s": "u", "u": "a", "a": "u"}

    @lru_cache(None)
    def best(at, state, inserted):
        ways = [(0, "")] if at == len(symbols) and state in ("", "a") else []
        if inserted < 3:
            for to in places[state].replace("s", ""):
                cost, rest = best(at, to, inserted + 1)
                ways.append((cost + 5, "I" + rest))
        if at < len(symbols):
            role, gone, truncated = symbols[at]
            cost, rest = best(at + 1, state, 0)
            ways.append((cost + 2, "D" + rest))
            for to in "" if gone else places[state]:
                cost, rest = best(at + 1, to, 0)
                if to == role:
                    ways.append((cost + 5 * truncated, "K" + rest))
                if to != "s":
                    ways.append((cost + 1 + 5 * truncated, "R" + rest))
        return min(ways, default=(10**9, ""))

    for at in range(len(symbols), 0, -100):  # keeps the recursion flat
        for state in places:
            best(at, state, 0)
    return best(0, "", 0)


def expected(rows, hurt=True):
    found = []
    for conv in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == conv]
        mine = list(damaged(own)) if hurt else [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in own]
        mine.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.md5(r[3].encode()).digest()))
        turns = [r[1] for r in mine if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        faults, seen = [], set()
        for _, _, role, text in mine:
            bare = text.strip(WHITE)
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        initials = [r[2][:1] for r in mine]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit = cheapest(tuple((i, f in ("blank", "duplicate"), f == "truncated") for i, f in zip(initials, faults)))
        lines, at, state = [], 0, ""
        for letter in audit:
            after = {"": "user", "s": "user", "u": "assistant", "a": "user"}[state]
            if letter == "I":
                lines.append(f"{after}:")
                state = after[0]
                continue
            _, _, role, text = mine[at]
            at += 1
            if letter != "D":
                lines.append(f"{role if letter == 'K' else after}:{text}")
                state = lines[-1][0]
        sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        found.append((conv, gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, sha))
    return sorted(found, key=repr)


def got(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


def strange(n, longest=9, seed=3):
    rng = random.Random(seed)
    texts = ["Yes.", "Yes.", "No!", "why", "", " \t\n", None, "Well?  ", "a.b", " ", ".", "\x1c?\r\n"]
    roles = ["user", "user", "assistant", "assistant", "system", None, "", "tool", "usher", "User"]
    rows = []
    for conv in range(n):
        turn = rng.randint(-3, 3)
        for _ in range(rng.randint(1, longest)):
            rows.append((None if conv == 7 else conv, rng.choice([turn, turn, turn, None]), rng.choice(roles), rng.choice(texts)))
            turn += rng.choice([0, 1, 1, 1, 2])
    return rows


def test_automaton_against_all_ways():
    rng = random.Random(11)
    some = {tuple((rng.choice("suao"), rng.random() < 0.2, rng.random() < 0.2) for _ in range(rng.randint(0, 9))) for _ in range(3000)}
    symbols = {"".join("d" if gone else role.upper() if cut else role for role, gone, cut in s)[::-1]: s for s in some}
    automaton = Automaton()
    for backwards in sorted(symbols):
        assert automaton.cheapest(backwards) == cheapest(tuple((r if r != "o" else "x", g, t) for r, g, t in symbols[backwards])), backwards
    # Endings in common are worked out once.
    endings = {b[:k] for b in symbols for k in range(1, len(b) + 1)}
    assert automaton.made == len(endings) < sum(map(len, symbols))


def test_a_long_signature():
    backwards = "au" * 60_000 + "s"
    assert Automaton().cheapest(backwards) == (0, "K" * 120_001)


def test_strange_conversations(spark):
    rows = strange(300)
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(conversation_repair.repair(conversation_repair.damage(df))) == expected(rows)
    assert got(conversation_repair.repair(conversation_repair.undamaged(df))) == expected(rows, hurt=False)


def test_one_conversation_over_many_tasks(spark):
    """Most rows are of one conversation, whose pieces come from several ranges."""
    rng = random.Random(1)
    rows = [(5, rng.randint(0, 900), rng.choice(["user", "assistant", "system"]), f"{rng.randint(0, 300)}{rng.choice('.!a')}") for _ in range(1500)] + strange(20)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert got(conversation_repair.repair(conversation_repair.damage(spark.createDataFrame(rows, SCHEMA)))) == expected(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_odd_tables(spark):
    from pyspark.sql import functions as F

    empty = spark.createDataFrame([], SCHEMA)
    assert conversation_repair.repair(conversation_repair.damage(empty)).collect() == []
    rows = [(None, None, None, None), (1, None, "user", "Hi."), (2, 2**63 - 1, "user", "Hi."), (2, -(2**63), "assistant", "Ho."), (3, 0, "user", "x" * 200_000 + ".")]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("conv", "kind", "copies", "mark", "piece", "audit", "cost", "symbols", "p", "s", "since", "gaps", "blank", "backwards", "fate"):
        df = df.withColumn(name, F.lit("x"))
    want = [(*r[:1], min(r[1], 2**63 - 1), *r[2:]) for r in expected(rows, hurt=False)]
    assert got(conversation_repair.repair(conversation_repair.undamaged(df))) == want


def test_repaired_rows(spark):
    rows = strange(60)
    df = conversation_repair.damage(spark.createDataFrame(rows, SCHEMA))
    lines = {}
    for r in conversation_repair.repaired(df).orderBy("conv_id", "position").collect():
        lines.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    hashes = {r["conv_id"]: r["repaired_sha256"] for r in conversation_repair.repair(df).collect()}
    assert {k: hashlib.sha256("\n".join(lines.get(k, [])).encode()).hexdigest() for k in hashes} == hashes
    assert all(re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in v)) for v in lines.values())


def test_registered_repairs(spark, sf):
    queries = pytest.importorskip("segtide.llm.queries")
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(queries.conversation_repair_query(spark, sf)) == expected(rows)
