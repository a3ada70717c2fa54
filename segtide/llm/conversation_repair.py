"""Conversation structure repair: cheapest edits from a suffix-shared automaton over role and fault signatures."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Costs of edits, and what an undeleted truncated row adds.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: A row takes one of so many fates by its key; these are drop, empty, strip, repeat, reassign.
FATES, DROP, EMPTY, STRIP, REPEAT, REASSIGN = 20, 0, 1, 2, 3, 4

#: States of the grammar (s?(ua)+)?: nothing yet, after a system row, after a user row, after an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state that a rerolled or inserted row leads to, and the states where a row may be kept, with what it leads to.
NEXT = (USER, USER, ASSISTANT, USER)
KEPT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}, "o": {}}
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: The symbol of a row that has to go; other rows are s, u, a, o by their role's initial, in capitals if truncated.
GONE = "d"
LONGEST = 2**63 - 1


def damage(df: DataFrame) -> DataFrame:
    """Rows ``conv, turn, role, text, copies`` after the damage: ``copies`` is 0 for a dropped row, 2 for a repeated one.

    Null roles and texts are one space, and so are null ids and turns inside the key that settles a row's fate.
    """
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    rows = df.select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"), F.pmod(F.crc32(key), F.lit(FATES)).alias("fate"),
    )
    text = F.when(F.col("fate") == EMPTY, "").when(F.col("fate") == STRIP, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fate") == REASSIGN, "user").otherwise(F.col("role"))
    copies = F.when(F.col("fate") == DROP, 0).when(F.col("fate") == REPEAT, 2).otherwise(1)
    return rows.select("conv", "turn", role.alias("role"), text.alias("text"), copies.alias("copies"))


def undamaged(df: DataFrame) -> DataFrame:
    """Rows as they are, in the form that ``damage`` gives."""
    return df.select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"), F.lit(1).alias("copies"),
    )


def _mark() -> F.Column:
    """A digest in place of the text: tells equal texts and orders rows that share a turn and a role."""
    return F.unhex(F.md5("text"))


def _signed(rows: DataFrame) -> DataFrame:
    """The distinct rows of each conversation with how often they stand, their role's class and their own fault.

    ``since`` is where the same role and text stands first, null if it stands in one turn only. Repeated rows are counted before they are
    shuffled, and what is shuffled has a digest in place of the text.
    """
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    initial = F.substring("role", 1, 1)
    there = F.col("copies") > 0
    marked = rows.select(
        "conv", "copies",
        *[F.when(there, c).alias(name) for name, c in (
            ("turn", F.col("turn")), ("role", F.col("role")), ("mark", _mark()),
            ("class", F.when(initial.isin("s", "u", "a"), initial).otherwise("o")),
            ("blank", last == ""), ("truncated", ~last.isin(".", "!", "?")),
        )],
    )
    distinct = marked.groupBy("conv", "turn", "role", "mark", "class", "blank", "truncated").agg(F.sum("copies").alias("copies"))
    place = F.struct(F.col("turn").isNotNull().alias("has"), F.col("turn").alias("turn"))
    repeated = distinct.groupBy(F.col("conv").alias("c"), F.col("role").alias("r"), F.col("mark").alias("m")).agg(F.min(place).alias("since"), F.count("*").alias("n")).filter("n > 1 AND m IS NOT NULL")
    same = distinct["conv"].eqNullSafe(repeated["c"]) & (distinct["role"] == repeated["r"]) & (distinct["mark"] == repeated["m"])
    later = F.coalesce(F.col("since") != place, F.lit(False))
    return distinct.join(repeated, same, "left").select("conv", "turn", "role", "mark", "class", "blank", "truncated", later.alias("later"), "copies")


PIECE = "conv long, piece int, symbols string, first string, last string, low long, high long, turns long, blank long, duplicate long, truncated long, illegal long"
LEGAL = {"su", "ua", "au"}


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each conversation's rows in one ordered partition amount to."""
    schema = pa.schema([("conv", pa.int64()), ("piece", pa.int32()), *[(c, pa.string()) for c in ("symbols", "first", "last")], *[(c, pa.int64()) for c in ("low", "high", "turns", "blank", "duplicate", "truncated", "illegal")]])
    now, out = None, []

    def closed(p: dict) -> dict:
        p["symbols"] = "".join(p["symbols"])
        return p

    for batch in batches:
        for conv, turn, kind, blank, truncated, later, copies, piece in zip(*[batch.column(k).to_pylist() for k in range(8)], strict=True):
            if now is None or now["conv"] != conv:
                if now is not None:
                    out.append(closed(now))
                now = dict.fromkeys(schema.names, 0) | {"conv": conv, "piece": piece, "symbols": [], "first": None, "last": None, "low": None, "high": None}
            if not copies:
                continue
            if turn is not None:
                now["low"] = turn if now["low"] is None else now["low"]
                now["turns"] += turn != now["high"]
                now["high"] = turn
            now["illegal"] += (now["last"] is not None and now["last"] + kind not in LEGAL) + (copies - 1) * (kind + kind not in LEGAL)
            now["first"] = now["first"] or kind
            now["last"] = kind
            if blank:
                now["blank"] += copies
                now["symbols"].append(GONE * copies)
                continue
            now["duplicate"] += copies - (not later)
            if not later:
                now["truncated"] += truncated
                now["symbols"].append(kind.upper() if truncated else kind)
            now["symbols"].append(GONE * (copies - (not later)))
        if len(out) > 4096:
            yield pa.RecordBatch.from_pylist(out, schema)
            out = []
    if now is not None:
        out.append(closed(now))
    yield pa.RecordBatch.from_pylist(out, schema)


def signatures(rows: DataFrame) -> DataFrame:
    """For each conversation its signature, last row first, and the counts of gaps, faults and illegal neighbours.

    Rows are ordered by ranges of conversation and turn, so a conversation with a large share of all rows is spread over
    tasks; each gives a piece, and pieces are put together.
    """
    order = ["conv", "turn", "role", "mark"]
    placed = _signed(rows).repartitionByRange(*order).sortWithinPartitions(*order)
    pieces = placed.select("conv", "turn", "class", "blank", "truncated", "later", "copies", F.spark_partition_id().alias("piece")).mapInArrow(_pieces, PIECE)
    listed = pieces.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("piece", "symbols", "first", "last", "low", "high", "turns"))).alias("p"), *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")])
    # Where two pieces meet, a turn may stand in both and two rows become neighbours.
    seams = F.expr("""aggregate(p, named_struct('last', CAST(NULL AS string), 'low', CAST(NULL AS bigint), 'high', CAST(NULL AS bigint), 'turns', 0L, 'illegal', 0L), (s, x) -> named_struct(
        'last', coalesce(x.last, s.last), 'low', coalesce(s.low, x.low), 'high', coalesce(x.high, s.high),
        'turns', s.turns + x.turns - CAST(coalesce(s.high = x.low, false) AS bigint),
        'illegal', s.illegal + CAST(coalesce(s.last || x.first NOT IN ('su', 'ua', 'au'), false) AS bigint)))""")
    symbols = F.reverse(F.array_join(F.transform("p", lambda x: x["symbols"]), ""))
    span = (F.col("s.high").cast("decimal(20,0)") - F.col("s.low") + 1 - F.col("s.turns")).cast("decimal(20,0)")
    return listed.withColumn("s", seams).select(
        "conv", symbols.alias("backwards"), F.when(span.isNull(), 0).otherwise(F.least(span, F.lit(LONGEST).cast("decimal(20,0)"))).cast("long").alias("gaps"),
        "blank", "duplicate", "truncated", (F.col("illegal") + F.col("s.illegal")).alias("illegal"),
    )


class Automaton:
    """Nodes of signatures read from the end: signatures with a common ending share its nodes, whatever stands before it.

    A node has, for each grammar state, the cost to go and the best audit of its ending, as a link to what follows. Signatures come
    sorted, so only the nodes of the present one are kept; those it shares with the one before are taken as they are.
    """

    def __init__(self):
        #: An accepted end costs nothing; else an assistant, or a user and an assistant, are inserted.
        one = ("I", ASSISTANT, None)
        self.path: list[tuple[tuple[int, ...], tuple]] = [((0, 2 * INSERT, INSERT, 0), (None, ("I", USER, one), one, None))]
        self.before = ""
        self.made = 0

    def _node(self, symbol: str, costs: tuple[int, ...], best: tuple) -> tuple:
        """The node of one more row in front of a node."""
        self.made += 1
        role, more = symbol.lower(), TRUNCATED if symbol.isupper() else 0
        found = []
        for state in range(4):
            options = [(DELETE + costs[state], "D", state)]
            if symbol != GONE:
                if state in KEPT[role]:
                    options.append((more + costs[KEPT[role][state]], "K", KEPT[role][state]))
                options.append((REROLE + more + costs[NEXT[state]], "R", NEXT[state]))
            cost, letter, after = min(options)
            found.append((cost, letter, after, best[after]))
        # A row may be inserted in front; never three, as the third stands where the first did. Equal costs take the smaller letter.
        plain = list(found)
        for state in (USER, ASSISTANT, START, SYSTEM):
            other = plain[NEXT[state]] if state in (USER, ASSISTANT) else found[NEXT[state]]
            if (INSERT + other[0], "I") < found[state][:2]:
                found[state] = (INSERT + other[0], "I", NEXT[state], other[1:])
        return tuple(c for c, *_ in found), tuple(x[1:] for x in found)

    def cheapest(self, backwards: str) -> tuple[int, str]:
        """The least cost and its least audit, in order of the conversation."""
        same, most = 0, min(len(backwards), len(self.before))
        if backwards[:most] == self.before[:most]:
            same = most
        else:
            while backwards[same] == self.before[same]:
                same += 1
        del self.path[same + 1 :]
        for symbol in backwards[same:]:
            self.path.append(self._node(symbol, *self.path[-1]))
        self.before = backwards
        costs, best = self.path[-1]
        letters, at = [], best[START]
        while at is not None:
            letters.append(at[0])
            at = at[2]
        return costs[START], "".join(letters)


def _audited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    automaton = Automaton()
    for batch in batches:
        found = [automaton.cheapest(x) for x in batch.column(batch.num_columns - 1).to_pylist()]
        columns = [*batch.columns[:-1], pa.array([c for c, _ in found], pa.int64()), pa.array([a for _, a in found], pa.string())]
        yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], "cost", "audit"])


def audits(signed: DataFrame) -> DataFrame:
    """Cost and audit of each conversation, in place of its signature.

    Signatures are sorted from the end by ranges over the whole table, so each ending is worked out once, but for those that lie on
    both sides of a border. Many conversations with one signature are told apart by their id and may go to several tasks.
    """
    counts = ["conv", "gaps", "blank", "duplicate", "truncated", "illegal"]
    placed = signed.select(*counts, "backwards").repartitionByRange("backwards", "conv").sortWithinPartitions("backwards", "conv")
    return placed.mapInArrow(_audited, "conv long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string")


def _merged(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Each conversation together and in order: its audit, then its damaged rows."""
    heads = found.select("conv", F.lit(0).alias("kind"), *[F.lit(None).cast(t).alias(c) for c, t in (("turn", "long"), ("role", "string"), ("mark", "binary"), ("text", "binary"))], *found.columns[1:])
    copies = rows.filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in found.schema.fields[1:]]
    lines = copies.select("conv", F.lit(1).alias("kind"), "turn", "role", _mark().alias("mark"), F.col("text").cast("binary").alias("text"), *none)
    return heads.unionByName(lines).repartition("conv").sortWithinPartitions("conv", "kind", "turn", "role", "mark").drop("turn", "mark")


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple | None, bytes, bytes]]:
    """Follow the audits: for each conversation its first columns, then role and text of each repaired row."""
    letters, state = iter(()), START
    for batch in batches:
        for conv, kind, role, text, *head in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if kind == 0:
                for letter in letters:
                    state = NEXT[state]
                    yield None, ROLE[state].encode(), b""
                letters, state = iter(head[-1]), START
                yield (conv, *head), b"", b""
                continue
            for letter in letters:
                if letter == "D":
                    break
                state = KEPT[role[0]][state] if letter == "K" else NEXT[state]
                yield None, (role if letter == "K" else ROLE[state]).encode(), b"" if letter == "I" else text
                if letter != "I":
                    break
    for letter in letters:
        state = NEXT[state]
        yield None, ROLE[state].encode(), b""


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv", pa.int64()), *[(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], ("audit", pa.string()), ("repaired_sha256", pa.string())])
    head, sha, begun, out = None, None, False, []
    for first, role, text in _edits(batches):
        if first is None:
            sha.update((b"\n" if begun else b"") + role + b":" + text)
            begun = True
            continue
        if head is not None:
            out.append((*head, sha.hexdigest()))
        head, sha, begun = first, hashlib.sha256(), False
        if len(out) == 4096:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
            out = []
    if head is not None:
        out.append((*head, sha.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "position", "role", "text"]
    conv, at, out, size = None, 0, [], 0
    for first, role, text in _edits(batches):
        if first is not None:
            conv, at = first[0], 0
            continue
        out.append((conv, at, role.decode(), text.decode()))
        at, size = at + 1, size + len(text)
        if len(out) == 4096 or size > 4_000_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], names)
            out, size = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], names)


def repaired(rows: DataFrame) -> DataFrame:
    """The repaired conversations as rows ``conv_id, position, role, text``; a conversation of which nothing is left has none."""
    return _merged(rows, audits(signatures(rows))).mapInArrow(_told, "conv_id long, position long, role string, text string")


def repair(rows: DataFrame) -> DataFrame:
    """One row for each conversation: counts of its gaps, faults and illegal neighbours, the least cost of its repair, the audit and a hash of the result.

    ``rows`` comes from ``damage`` or ``undamaged``. Rows stand by turn, nulls first; rows of one turn by role, then by a digest of their text,
    so that repeated rows are neighbours. A null id is one conversation. A conversation without rows has zeros, an empty audit and the
    hash of nothing; an empty table gives an empty result. Gaps beyond 64 bits are given as the largest number. Further columns of any name do no harm.

    Texts are shuffled once, for the hash, which reads a conversation in order in one task but never holds it; everything else goes by digests.
    """
    return _merged(rows, audits(signatures(rows))).mapInArrow(
        _hashed, "conv long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    ).withColumnRenamed("conv", "conv_id")
