"""Byte-level BPE: many words are merged together in rounds over one flat numpy array."""

from __future__ import annotations

import hashlib
import json
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from segtide.llm.common import add_columns

#: How the byte-level vocabulary splits text into words.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SPLITTER = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
#: Distinct text pieces whose ids a task remembers, and bytes of the words merged together.
REMEMBERED, TOGETHER = 200_000, 2_000_000
#: Bytes of texts that are encoded together: their pieces and ids take some fifty times as much meanwhile.
PORTION = 500_000
#: White space that touches other white space; what lies between single spaces that don't.
TOUCHING, SINGLE = re.compile(r"\s\s").search, re.compile(r"(?<=\S)(?= \S)").split


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in the vocabulary: itself where it shows, else the next free one from 256 on."""
    shown = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


class Vocabulary:
    """What a tokenizer file says, as arrays: ids of bytes, merges as sorted pair keys, bytes of ids, special strings."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec.get("normalizer") is not None or spec.get("pre_tokenizer") != SPLITTER or spec["model"].get("end_of_word_suffix") or spec["model"].get("byte_fallback"):
            raise ValueError(f"{path} is not a byte-level vocabulary that splits text by the pattern here")
        ids: dict[str, int] = spec["model"]["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        characters = byte_characters()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.of_byte = np.array([ids[c] for c in characters], np.int64)
        self.n = max([*ids.values(), *self.special.values()]) + 1

        left = np.array([ids[a] for a, _ in merges], np.int64)
        right = np.array([ids[b] for _, b in merges], np.int64)
        into = np.array([ids[a + b] for a, b in merges], np.int64)
        keys = left * self.n + right
        order = np.argsort(keys, kind="stable")
        first = np.concatenate([[True], np.diff(keys[order]) != 0]) if len(order) else np.zeros(0, bool)
        self.keys, self.ranks, self.into = keys[order][first], order[first], into[order][first]
        # All places of a word's lowest pair may be merged in one round, as no merge makes a pair of lower rank than its own.
        made = np.full(self.n, -1, np.int64)
        made[into[::-1]] = np.arange(len(into))[::-1]
        if len(np.unique(into)) != len(into) or (np.maximum(made[left], made[right]) >= np.arange(len(into))).any():
            raise ValueError("merges are not in the order in which they were learnt")

        back = {c: b for b, c in enumerate(characters)}
        spelled = [b""] * self.n
        for token, k in ids.items():
            spelled[k] = bytes(back[c] for c in token)
        for token, k in self.special.items():
            spelled[k] = token.encode()
        self.lengths = np.array([len(s) for s in spelled], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.spelled = np.frombuffer(b"".join(spelled), np.uint8)
        self.split = regex.compile(SPLIT).findall
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, one after the other, and how many each word has."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        symbols = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), sizes)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        none = len(self.keys)
        while len(symbols):
            # The rank of the pair that starts at each symbol, found by binary search; none across words.
            key = symbols[:-1] * self.n + symbols[1:]
            at = np.searchsorted(self.keys, key)
            at[at == none] = 0
            ok = (self.keys[at] == key) & (word[:-1] == word[1:]) if none else np.zeros(len(key), bool)
            rank = np.append(np.where(ok, self.ranks[at] if none else 0, none), none)
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            lowest = np.minimum.reduceat(rank, first)
            lengths = np.diff(np.append(first, len(word)))
            least = np.repeat(lowest, lengths)
            if (lowest == none).any():
                over = least == none
                done.append((symbols[over], word[over]))
                if over.all():
                    break
            going = least < none
            here = (rank == least) & going
            # Of touching places of one pair (x x x) every second one counts, from the left.
            spots = np.flatnonzero(here)
            run = np.concatenate([[True], np.diff(spots) != 1]) if len(spots) else np.zeros(0, bool)
            begin = np.maximum.accumulate(np.where(run, np.arange(len(spots)), 0))
            spots = spots[(np.arange(len(spots)) - begin) % 2 == 0]
            symbols = symbols.copy()
            symbols[spots] = self.into[at[spots]]
            going[spots + 1] = False
            symbols, word = symbols[going], word[going]
        ids = np.concatenate([s for s, _ in done]) if done else np.zeros(0, np.int64)
        of = np.concatenate([w for _, w in done]) if done else np.zeros(0, np.int64)
        order = np.argsort(of, kind="stable")
        return ids[order].astype(np.uint32), np.bincount(of, minlength=len(words))

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes that ids stand for, special ones included."""
        return gather(self.spelled, self.starts[ids], self.lengths[ids]).tobytes()


def gather(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Slices of one array, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.arange(total) + np.repeat(starts - (ends - lengths), lengths)]


class Codec:
    """Encodes and decodes texts; remembers the ids of the text pieces between single spaces and line ends.

    Where no two white-space characters touch, a space starts a new word and a line end is
    a word by itself, so a text falls into lines and these into pieces that can be
    encoded on their own. Other texts are cut only at places where that holds.
    """

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat = np.zeros(1 << 20, np.uint32)
        self.used = 0
        self.starts = np.zeros(1 << 16, np.int64)
        self.lengths = np.zeros(1 << 16, np.int64)

    def pieces(self, text: str) -> list[str]:
        """The text cut at special strings and before single spaces; joined they give it again."""
        if self.vocabulary.cut is None or not self.vocabulary.cut.search(text):
            return self._spaced(text)
        found, at = [], 0
        for hit in self.vocabulary.cut.finditer(text):
            found += self._spaced(text[at : hit.start()])
            found.append(hit.group())
            at = hit.end()
        return found + self._spaced(text[at:])

    @staticmethod
    def _spaced(text: str) -> list[str]:
        if not TOUCHING(text):
            return [p for p in text.replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0") if p] if "\0" not in text else [text]
        return [p for p in SINGLE(text) if p]

    def _learn(self, pieces: list[str]) -> None:
        """Encode distinct pieces: split them into words together, merge each distinct word once."""
        vocabulary, at = self.vocabulary, 0
        while at < len(pieces):
            size, upto = 0, at
            while upto < len(pieces) and size < TOGETHER:
                size += len(pieces[upto])
                upto += 1
            part = pieces[at:upto]
            # What follows a piece that starts with a space or line end is cut off from it by that; other pieces are split alone.
            words: list[str] = []
            counts: list[int] = []
            spaced = [p for p in part if p[0] == " " and not p[1:2].isspace() and not p[-1].isspace()]
            alone = [p for p in part if not (p[0] == " " and not p[1:2].isspace() and not p[-1].isspace())]
            if spaced:
                words = vocabulary.split("".join(spaced))
                ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
                bounds = np.cumsum(np.fromiter(map(len, spaced), np.int64, len(spaced)))
                counts = np.diff(np.searchsorted(ends, bounds, side="right"), prepend=0).tolist()
            for p in alone:
                found = [p] if p in vocabulary.special else vocabulary.split(p)
                words += found
                counts.append(len(found))
            number: dict[str, int] = {}
            which = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
            ids, sizes = self._words(list(number))
            begin = np.cumsum(sizes) - sizes
            self._append(spaced + alone, gather(ids, begin[which], sizes[which]), np.add.reduceat(np.append(sizes[which], 0), np.cumsum([0, *counts])[:-1]) if counts else sizes[:0])
            at = upto

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        special = self.vocabulary.special
        ids, sizes = self.vocabulary.merge([b"" if w in special else w.encode() for w in words])
        for k in [k for k, w in enumerate(words) if w in special]:
            ids = np.insert(ids, int(sizes[:k].sum()), special[words[k]])
            sizes[k] = 1
        return ids, sizes

    def _append(self, pieces: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        n, end = len(self.known), self.used + len(ids)
        if end > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), len(ids)), np.uint32)])
        while n + len(pieces) > len(self.starts):
            self.starts, self.lengths = np.concatenate([self.starts, np.zeros_like(self.starts)]), np.concatenate([self.lengths, np.zeros_like(self.lengths)])
        self.flat[self.used : end] = ids
        self.starts[n : n + len(pieces)] = self.used + np.cumsum(lengths) - lengths
        self.lengths[n : n + len(pieces)] = lengths
        self.known.update(zip(pieces, range(n, n + len(pieces)), strict=True))
        self.used = end

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        split = [self.pieces(t) for t in texts]
        distinct = dict.fromkeys(chain.from_iterable(split))
        if len(self.known) + len(distinct) > REMEMBERED or self.used > 8 * REMEMBERED:
            self._forget()
        self._learn([p for p in distinct if p not in self.known])
        n = sum(map(len, split))
        index = np.fromiter(map(self.known.__getitem__, chain.from_iterable(split)), np.int64, n)
        lengths = self.lengths[index]
        ids = gather(self.flat, self.starts[index], lengths)
        ends = np.concatenate([[0], np.cumsum(lengths)])[np.cumsum([0, *map(len, split)])]
        return [ids[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def decode(self, ids: list[np.ndarray]) -> list[bytes]:
        return [self.vocabulary.decode(x) for x in ids]


_kept: dict[str, Codec] = {}


def _codec(path: str) -> Codec:
    """A worker's codec outlives a task, as most pieces come again in the next."""
    if path not in _kept:
        _kept[path] = Codec(path)
    return _kept[path]


def _ids_column(path: str):
    def make():
        codec = _codec(path)
        return lambda texts: [codec.encode([t.decode() for t in texts])]

    return make


def encode(df: DataFrame, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``ids``, the token ids of each whole text; special strings become special ids, none are added.

    Null and empty texts have no ids, repeated rows the same ids; an empty table gives an
    empty result. Rows are encoded where they are read, without a shuffle.
    """
    return add_columns(df, text, _ids_column(path), {"ids": (T.ArrayType(T.LongType()), pa.list_(pa.int64()))}, keep or [], PORTION)


def decode(df: DataFrame, path: str, ids: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """Add ``text``, what the ids of each row stand for; null ids give an empty text, bytes that aren't UTF-8 the replacement character."""
    keep = keep or []

    def run(batches):
        vocabulary = Vocabulary(path)
        for batch in batches:
            column = batch.column(len(keep))
            texts = [vocabulary.decode(np.array(x.as_py() or [], np.int64)).decode("utf-8", "replace") for x in column]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], [*batch.schema.names[:-1], "text"])

    rows = df.selectExpr(*[f"`{c}` AS k{i}" for i, c in enumerate(keep)], f"`{ids}` AS ids")
    found = rows.mapInArrow(run, T.StructType([*rows.schema.fields[:-1], T.StructField("text", T.StringType())]))
    return found.selectExpr(*[f"k{i} AS `{c}`" for i, c in enumerate(keep)], "text")


def round_trip(df: DataFrame, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Encode each whole text and decode its ids again; add ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``.

    The hashes are of the ids as little-endian unsigned 32-bit integers and of the decoded text
    in UTF-8. Null and empty texts have no tokens and the hash of nothing.
    """

    def make():
        codec = _codec(path)

        def work(texts: list[bytes]) -> list[list]:
            ids = codec.encode([t.decode() for t in texts])
            back = codec.decode(ids)
            sha = lambda b: hashlib.sha256(b).hexdigest()
            return [[len(x) for x in ids], [sha(x.astype("<u4").tobytes()) for x in ids], [sha(b.decode("utf-8", "replace").encode()) for b in back]]

        return work

    fields = {
        "n_tokens": (T.LongType(), pa.int64()),
        "ids_sha256": (T.StringType(), pa.string()),
        "decoded_sha256": (T.StringType(), pa.string()),
    }
    return add_columns(df, text, make, fields, keep or [], PORTION)
