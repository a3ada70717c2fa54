"""URL filters: all glob rules simulated at once as bit masks over each canonical URL."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Separates host and path in the canonical URL; neither side of a rule may hold it.
CUT = "\x00"
CUT_BYTE = 0


@dataclass(frozen=True)
class Rule:
    """A verdict for a host with its subdomains and a path prefix; written ``example.com/en/``.

    A ``*`` in it stands for any characters, a ``?`` for one: ``*.example.com/*/print?/``. Neither reaches from the host into the path.
    """

    text: str
    verdict: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0].lower()

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2]

    @property
    def globs(self) -> tuple[str, str]:
        """The host itself and its subdomains, each followed by a path that starts with the rule's."""
        return f"{self.host}{CUT}{self.path}", f"*.{self.host}{CUT}{self.path}"


class ShiftAnd:
    """Globs packed into one row of 64-bit words, a bit for each character that isn't a ``*``.

    A bit says that the pattern fits up to its character. A ``*`` keeps the bit before it
    set whatever follows, except that it never reaches from the host into the path; a leading one lets the
    pattern start anywhere. A ``?`` accepts any character: its bit takes every first byte and
    stays over the bytes that continue the character. The end is always open, so a
    pattern fits once its last bit is set. Bits of one pattern are adjacent and may
    cross a word's edge: the shift carries the top bit into the next word.
    """

    def __init__(self, globs: Iterable[str]):
        parsed = [self._parsed(g) for g in globs]
        starts = np.cumsum([0, *(len(steps) for _, steps in parsed)])
        n_words = int(starts[-1]) // 64 + 1
        self.first = np.zeros(n_words, np.uint64)
        self.anywhere = np.zeros(n_words, np.uint64)
        self.accepts = np.zeros((256, n_words), np.uint64)
        self.stays = np.zeros((256, n_words), np.uint64)
        self.begins = np.zeros(n_words, np.uint64)
        self.last = []
        for (open_, steps), start in zip(parsed, starts[:-1].tolist(), strict=True):
            self._set(self.anywhere if open_ else self.first, start)
            self._set(self.begins, start)
            for k, (byte, star, host) in enumerate(steps):
                for b in [byte] if byte is not None else [x for x in range(0xF8) if not 0x80 <= x < 0xC0 and x != CUT_BYTE]:
                    self._set(self.accepts[b], start + k)
                for b in range(256):
                    if star and not (host and b == CUT_BYTE) or byte is None and 0x80 <= b < 0xC0:
                        self._set(self.stays[b], start + k)
            self.last.append(start + len(steps) - 1)
        self.looped = bool(self.stays.any())

    @staticmethod
    def _parsed(glob: str) -> tuple[bool, list[tuple[int | None, bool, bool]]]:
        """Whether the glob may start anywhere, and for each character its byte (None: any character), whether a star follows, and whether it is part of the host."""
        bare = glob.lstrip("*")
        if not bare:
            raise ValueError("a glob needs a character besides stars")
        steps: list[tuple[int | None, bool, bool]] = []
        host = True
        for char in bare:
            if char == "*":
                byte, _, inside = steps[-1]
                steps[-1] = byte, True, inside
            elif char == "?":
                steps.append((None, False, host))
            else:
                host = host and char != CUT
                steps += [(b, False, host) for b in char.encode()]
        return bare != glob, steps

    @staticmethod
    def _set(masks: np.ndarray, bit: int) -> None:
        masks[bit // 64] |= np.uint64(1) << np.uint64(bit % 64)

    def match(self, texts: list[bytes]) -> np.ndarray:
        """A row per text and a column per glob: whether the glob fits. Texts of one length band are stepped together."""
        hits = np.zeros((len(texts), len(self.last)), bool)
        lengths = np.array([len(t) for t in texts], np.int64)
        order = np.argsort(lengths, kind="stable")
        at = 0
        while at < len(order):
            # A block of texts is padded to its longest; its area is bounded, so one very long URL stands alone.
            most = max(int(lengths[order[at]]), 64) * 2
            upto = min(int(np.searchsorted(lengths[order], most, side="right")), at + max(1, 4_000_000 // most))
            hits[order[at:upto]] = self._block([texts[i] for i in order[at:upto]])
            at = upto
        return hits

    def _block(self, texts: list[bytes]) -> np.ndarray:
        longest = max(map(len, texts))
        if not longest:
            return np.zeros((len(texts), len(self.last)), bool)
        chars = np.frombuffer(b"".join(t.ljust(longest, b"\xff") for t in texts), np.uint8).reshape(len(texts), longest)
        state = np.zeros((len(texts), len(self.first)), np.uint64)
        seen = np.zeros_like(state)
        for k in range(longest):
            moved = state << np.uint64(1)
            moved[:, 1:] |= state[:, :-1] >> np.uint64(63)
            moved &= ~self.begins  # the end of one pattern is no start of the next
            moved |= self.anywhere | self.first if k == 0 else self.anywhere
            moved &= self.accepts[chars[:, k]]
            state = moved | state & self.stays[chars[:, k]] if self.looped else moved
            seen |= state
        bits = np.array(self.last, np.int64)
        return (seen[:, bits // 64] >> (bits % 64).astype(np.uint64) & np.uint64(1)).astype(bool)


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge_urls(df: DataFrame, rules: list[Rule], default: str = "allow", url: str = "url", keep: list[str] | None = None) -> DataFrame:
    """Judge each row's URL by the longest rule that fits; ``default`` where none does.

    Of rules that fit and have the same length the one with the longer host
    wins, then the one listed first. Null URLs and URLs without ``://`` have an empty host
    and path and fit no rule. Rows are judged one by one, repeated rows alike; an
    empty table gives an empty result. Columns in ``keep`` are carried along.

    The automaton is a few kilobytes; nothing is shuffled.
    """
    keep = [] if keep is None else keep
    if any(CUT in r.text or not r.host.strip("*") for r in rules):
        raise ValueError("a rule holds a character that it may not hold, or no host")
    if {c.lower() for c in keep} & {"host", "path", "rule", "verdict"}:
        raise ValueError("a kept column has the name of a result")
    ranked = sorted(range(len(rules)), key=lambda i: (-len(rules[i].text), -len(rules[i].host), i))
    ordered = [rules[i] for i in ranked]
    automaton = ShiftAnd(g for r in ordered for g in r.globs)
    texts = [r.text for r in ordered]

    @F.pandas_udf("string")
    def fitting(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for canonical in parts:
            hits = automaton.match([c.encode() for c in canonical])
            either = hits.reshape(len(canonical), -1, 2).any(axis=2)
            best = either.argmax(axis=1) if either.shape[1] else np.zeros(len(canonical), int)
            found = either.any(axis=1)
            yield pd.Series([texts[b] if f else None for b, f in zip(best, found, strict=True)], dtype=object)

    host, path = host_of(F.col(url)), path_of(F.col(url))
    # The cut stands once: a URL's own zero characters are replaced in the copy that is matched.
    canonical = F.concat(F.translate(host, CUT, "\x01"), F.lit(CUT), F.translate(path, CUT, "\x01"))
    verdicts = F.lit(default)
    for r in rules:
        verdicts = F.when(F.col("rule") == r.text, F.lit(r.verdict)).otherwise(verdicts)
    return df.select(*keep, host.alias("host"), path.alias("path"), fitting(canonical).alias("rule")).withColumn("verdict", verdicts)
