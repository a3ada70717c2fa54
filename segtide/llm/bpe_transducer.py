"""Byte-level BPE as a finite-state transducer: ranks become a machine whose states are made as texts need them; decoding streams through a UTF-8 machine."""

from __future__ import annotations

import base64
import gc
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from segtide.llm import bpe
from segtide.llm.common import add_columns

#: States and pairs of tokens that a worker keeps; beyond it the machine starts anew. It is a cache, never a limit of texts.
STATES, PAIRS = 200_000, 1_000_000
#: Tokens that go through the decoder at once.
FEED = 65_536
#: Bytes of a word after which tokens are written.
WINDOW = 4_096
#: Key of a state's own description; bytes are 0 to 255.
SELF = -1
#: The rank of a join that doesn't come.
NEVER = 2**62


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and ranks of a rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Transducer:
    """Reads a word byte by byte and writes its tokens as soon as they are settled.

    The last token of each prefix of a word is unique: it is the one token that ends the prefix and stands next to the last
    token of what comes before it, where two tokens stand next to each other if their joined bytes encode to just
    these two. A state keeps the places where a token may still be under way, each with the last token before it and its place in the trie of
    all tokens; the step of a byte gives the next state and the last token of what has been read. States are
    determinised when a byte first leads to them. Tokens are written from a window of last tokens: at the end of a word, and
    in a long word as far as all live places agree. No live place is further back than the longest token, which bounds the lookahead.
    """

    special: dict[str, int] = {}
    cut = None

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN):
        self.ids = read_ranks(path)
        missing = [b for b in range(256) if bytes([b]) not in self.ids]
        if missing:
            raise ValueError(f"{path} has no token for the bytes {missing}")
        self.spelled = [b""] * (max(self.ids.values()) + 1)
        for token, k in self.ids.items():
            self.spelled[k] = token
        self.size = [len(s) for s in self.spelled]
        self.children: list[dict[int, int]] = [{}]
        self.token, self.depth = [-1], [0]
        for token, k in self.ids.items():
            node = 0
            for byte in token:
                after = self.children[node].get(byte)
                if after is None:
                    after = self.children[node][byte] = len(self.children)
                    self.children.append({})
                    self.token.append(-1)
                    self.depth.append(self.depth[node] + 1)
                node = after
            self.token[node] = k
        self.split = regex.compile(pattern).findall
        self.neighbours: dict[int, bool] = {}
        self.known: dict[int, tuple[list, list] | None] = {}
        self._begin()
        self.decoder = Decoder(self.spelled)

    def _begin(self) -> None:
        """An empty machine; states lead to each other in circles, which are cut here because they are kept from the garbage collector."""
        for state in getattr(self, "states", {}).values():
            state.clear()
        self.states: dict[tuple, dict] = {}
        self.start = self._state(((-1, 0),))

    def _state(self, live: tuple) -> dict:
        """The state of these live places: the token before each and its place in the trie; equal ones are one state."""
        found = self.states.get(live)
        if found is None:
            found = self.states[live] = {SELF: live}
        return found

    def merged(self, data: bytes) -> list[bytes]:
        """The tokens of a few bytes by their definition: the leftmost pair of lowest rank is joined until none is left."""
        for _, parts in self._joins(data):
            pass
        return parts

    def _joins(self, data: bytes) -> Iterator[tuple[int, list[bytes]]]:
        """The parts of a few bytes before the first join and after each, with the rank of that join."""
        parts, rank = [data[i : i + 1] for i in range(len(data))], -1
        while True:
            yield rank, list(parts)
            ranks = [self.ids.get(a + b, -1) for a, b in zip(parts, parts[1:])]
            known = [r for r in ranks if r >= 0]
            if not known:
                return
            at = ranks.index(rank := min(known))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def edges(self, token: int) -> tuple[list, list] | None:
        """The parts that begin and that end a token while its bytes are joined, each with the rank of the join that takes it up.

        None for a token that its own bytes don't encode to. Ranks of the joins must not fall, so that the joins of two neighbours can be told in order.
        """
        found = self.known.get(token, ())
        if found == ():
            first, last, found, before = [], [], None, -1
            for rank, parts in self._joins(self.spelled[token]):
                if rank < before:
                    raise ValueError("a token's parts rank behind it")
                before = rank
                for side, part in ((first, parts[0]), (last, parts[-1])):
                    if not side or side[-1][0] != part:
                        if side:
                            side[-1][1] = rank
                        side.append([part, NEVER])
            if len(parts) == 1:
                found = first, last
            self.known[token] = found
        return found

    def stands(self, left: int, right: int) -> bool:
        """Whether a token stands next to another one, or at the start of a word if ``left`` is -1.

        It does unless some part at the end of the left one and one at the start of the right one are joined before their own tokens take them up.
        """
        after = self.edges(right)
        if after is None or left < 0:
            return after is not None
        key = left * len(self.spelled) + right
        found = self.neighbours.get(key)
        if found is None:
            if len(self.neighbours) >= PAIRS:
                self.neighbours = {}
            found = self.neighbours[key] = self._apart(self.edges(left)[1], after[0])
        return found

    def _apart(self, ends: list, begins: list) -> bool:
        i = j = 0
        while True:
            (end, taken), (begin, then) = ends[i], begins[j]
            rank = self.ids.get(end + begin, NEVER)
            # Of joins of one rank the leftmost comes first.
            if rank < taken and rank <= then and rank < NEVER:
                return False
            if taken == then == NEVER:
                return True
            i, j = (i + 1, j) if taken <= then else (i, j + 1)

    def _grow(self, state: dict, byte: int) -> tuple[dict, int]:
        """The state that a byte leads to, and the last token of what has been read then."""
        children, tokens = self.children, self.token
        going, ending = [], None
        for before, node in state[SELF]:
            after = children[node].get(byte)
            if after is not None:
                token = tokens[after]
                if ending is None and token >= 0 and self.stands(before, token):
                    ending = token
                if children[after]:
                    going.append((before, after))
        going.append((ending, 0))
        state[byte] = found = self._state(tuple(going)), ending
        return found

    def encode(self, word: bytes) -> list[int]:
        """The tokens of one word; a word that is a token by itself is that token, however its bytes would merge."""
        whole = self.ids.get(word)
        if whole is not None:
            return [whole]
        state, lasts, written = self.start, [], []
        for at in range(0, len(word), WINDOW):
            for byte in word[at : at + WINDOW]:
                state, token = state.get(byte) or self._grow(state, byte)
                lasts.append(token)
            if len(word) > WINDOW:
                lasts = self._settle(state, lasts, written)
            if len(self.states) > STATES:
                live = state[SELF]
                self._begin()
                state = self._state(live)
        return written + self._back(lasts, len(lasts))

    def _back(self, lasts: list[int], end: int) -> list[int]:
        """The tokens up to a place, found from the last one on."""
        found = []
        while end:
            found.append(token := lasts[end - 1])
            end -= self.size[token]
        return found[::-1]

    def _settle(self, state: dict, lasts: list[int], written: list[int]) -> list[int]:
        """Write the tokens on which all places agree where a token may still be under way; what is left of the last tokens."""
        common = None
        for _, node in state[SELF]:
            place = len(lasts) - self.depth[node]
            passed = {place}
            while place > 0:
                place -= self.size[lasts[place - 1]]
                passed.add(place)
            common = passed if common is None else common & passed
        settled = max(common)
        written += self._back(lasts, settled)
        return lasts[settled:]

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, one after the other, and how many each word has."""
        gc.disable()
        found = [self.encode(w) for w in words]
        gc.freeze()
        gc.enable()
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((k for ids in found for k in ids), np.uint32, int(sizes.sum())), sizes

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes that ids stand for."""
        return b"".join(self.decoder.raw(ids))


def _utf8() -> tuple[list[list[int]], list[int]]:
    """The machine that checks UTF-8: for each state the next one after each byte (-1: no character has it there), and how many bytes a state still needs.

    Fixed values are the ranges of the standard: a lead byte says how many bytes follow, and after E0, ED, F0 and F4 the first of them has a narrower range.
    """
    any_, kinds = (0x80, 0xBF), [((0x00, 0x7F), [])]
    kinds += [((0xC2, 0xDF), [any_]), ((0xE0, 0xE0), [(0xA0, 0xBF), any_]), ((0xE1, 0xEC), [any_, any_]), ((0xED, 0xED), [(0x80, 0x9F), any_]), ((0xEE, 0xEF), [any_, any_])]
    kinds += [((0xF0, 0xF0), [(0x90, 0xBF), any_, any_]), ((0xF1, 0xF3), [any_, any_, any_]), ((0xF4, 0xF4), [(0x80, 0x8F), any_, any_])]
    table, names, need = [[-1] * 256], {(): 0}, [0]

    def state(rest: tuple) -> int:
        if rest not in names:
            names[rest] = len(table)
            table.append([-1] * 256)
            need.append(len(rest))
            after = state(rest[1:])
            for byte in range(rest[0][0], rest[0][1] + 1):
                table[names[rest]][byte] = after
        return names[rest]

    for (low, high), rest in kinds:
        after = state(tuple(rest))
        for byte in range(low, high + 1):
            table[0][byte] = after
    return table, need


class Decoder:
    """Turns a stream of ids into text, holding back at most the three bytes of an unfinished character.

    The step of a whole token from a place in the machine is remembered, so the stream is read token by token. Tokens that
    are whole characters leave the machine where it starts; stretches of them are copied at once.
    """

    table, need = _utf8()

    def __init__(self, spelled: list[bytes]):
        self.spelled = spelled
        self.lengths = np.array([len(s) for s in spelled], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(spelled), np.uint8)
        self.steps: dict[tuple[bytes, int], tuple[bytes, bytes]] = {}
        self.whole = np.array([self._step(b"", k)[1] == b"" and b"\xef\xbf\xbd" not in self._step(b"", k)[0] or s == b"" for k, s in enumerate(spelled)])

    def _step(self, held: bytes, token: int) -> tuple[bytes, bytes]:
        """UTF-8 of the characters that a token finishes after the held bytes, and the bytes held then; what can't go on becomes U+FFFD."""
        found = self.steps.get((held, token))
        if found is None:
            state = 0
            for byte in held:
                state = self.table[state][byte]
            out, begun = bytearray(), bytearray(held)
            for byte in self.spelled[token]:
                after = self.table[state][byte]
                if after < 0 and state:
                    out += b"\xef\xbf\xbd"
                    begun.clear()
                    after = self.table[0][byte]
                if after < 0:
                    out += b"\xef\xbf\xbd"
                    state = 0
                    continue
                begun.append(byte)
                state = after
                if state == 0:
                    out += begun
                    begun.clear()
            found = self.steps[held, token] = bytes(out), bytes(begun)
        return found

    def _copied(self, ids: np.ndarray) -> bytes:
        return bpe.gather(self.flat, self.starts[ids], self.lengths[ids]).tobytes()

    def raw(self, ids: np.ndarray) -> Iterator[bytes]:
        """The bytes of ids, a portion at a time, just as the tokens have them."""
        for at in range(0, len(ids), FEED):
            yield self._copied(ids[at : at + FEED].astype(np.int64))

    def stream(self, ids: np.ndarray) -> Iterator[str]:
        """The text of ids, a portion at a time; no portion ends inside a character."""
        held = b""
        for at in range(0, len(ids), FEED):
            part = ids[at : at + FEED].astype(np.int64)
            out, done = [], 0
            for k in np.flatnonzero(~self.whole[part]).tolist():
                if k < done:
                    continue
                if k > done:
                    out.append(self._after(held, part[done:k]))
                    held = b""
                while k < len(part) and (held or not self.whole[part[k]]):
                    finished, held = self._step(held, int(part[k]))
                    out.append(finished)
                    k += 1
                done = k
            if done < len(part):
                out.append(self._after(held, part[done:]))
                held = b""
            yield b"".join(out).decode()
        if held:
            yield "�"

    def _after(self, held: bytes, whole: np.ndarray) -> bytes:
        """Whole tokens after held bytes: these can't go on, as a whole token begins with a character."""
        return (b"\xef\xbf\xbd" if held else b"") + self._copied(whole)


class Codec(bpe.Codec):
    """Splits texts into words and remembers pieces as the base class does; words go through the transducer."""

    def __init__(self, path: str):
        self.vocabulary = Transducer(path)
        self._forget()


_kept: dict[str, Codec] = {}


def _codec(path: str) -> Codec:
    """A worker's machine outlives a task, as most of its states are needed again in the next."""
    if path not in _kept:
        _kept[path] = Codec(path)
    return _kept[path]


def encode(df: DataFrame, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``ids``, the token ids of each whole text by the ranks in ``path``; strings of special tokens are ordinary text.

    Null and empty texts have no ids, repeated rows the same ids; an empty table gives an empty result; columns in ``keep`` may have
    any names. Rows are encoded where they are read, without a shuffle.
    """

    def make():
        codec = _codec(path)
        return lambda texts: [codec.encode([t.decode() for t in texts])]

    return add_columns(df, text, make, {"ids": (T.ArrayType(T.LongType()), pa.list_(pa.int64()))}, keep or [])


def decode(df: DataFrame, path: str, ids: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """Add ``text``, what the ids of each row stand for; null ids give an empty text, bytes that aren't UTF-8 the replacement character."""
    keep = keep or []

    def run(batches):
        decoder = _codec(path).vocabulary.decoder
        for batch in batches:
            texts = ["".join(decoder.stream(np.array(x.as_py() or [], np.int64))) for x in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], [*batch.schema.names[:-1], "text"])

    rows = df.selectExpr(*[f"`{c}` AS k{i}" for i, c in enumerate(keep)], f"`{ids}` AS ids")
    found = rows.mapInArrow(run, T.StructType([*rows.schema.fields[:-1], T.StructField("text", T.StringType())]))
    return found.selectExpr(*[f"k{i} AS `{c}`" for i, c in enumerate(keep)], "text")


def _hashes(codec: Codec, texts: list[bytes]) -> list[list]:
    ids = codec.encode([t.decode() for t in texts])
    back = []
    for x in ids:
        sha = hashlib.sha256()
        for portion in codec.vocabulary.decoder.stream(x):
            sha.update(portion.encode())
        back.append(sha.hexdigest())
    return [[len(x) for x in ids], [hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids], back]


def round_trip(df: DataFrame, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Encode each whole text and decode its ids again; add ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``.

    The hashes are of the ids as little-endian unsigned 32-bit integers and of the decoded bytes. Null and empty texts have no
    tokens and the hash of nothing. Ids of a text always decode to whole characters.
    """

    def make():
        codec = _codec(path)
        return lambda texts: _hashes(codec, texts)

    fields = {
        "n_tokens": (T.LongType(), pa.int64()),
        "ids_sha256": (T.StringType(), pa.string()),
        "decoded_sha256": (T.StringType(), pa.string()),
    }
    return add_columns(df, text, make, fields, keep or [])
