"""Lines of many texts at once, as numpy arrays of code points.

Java's and Python's regular expressions take minutes for what the operators on page lines need:
hashes of a line's letters, of its words with names and numbers masked, of its outline. Here the
texts of a batch are one array of code points, and each of these is a handful of array operations.
All hashes are 64-bit sums of mixed codes times powers of an odd number, mixed again at the end.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np

U64 = np.uint64
_P, _Q = U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F)
_BACK = U64(pow(int(_P), -1, 1 << 64))  # undoes a multiplication by _P
AHEAD = 1 << 20  # powers that are kept from batch to batch
NUMBER, NAME = U64(1), U64(2)  # stand-ins for masked words
SHINGLE = 5


@lru_cache(maxsize=1)
def tables() -> dict[str, np.ndarray]:
    """Per code point of the basic plane: lower-case form and classes."""
    n = 0x10000
    lower = np.arange(n, dtype=np.uint32)
    letter, word, upper, small, other, digit, space = (np.zeros(n, bool) for _ in range(7))
    for cp in range(n):
        ch = chr(cp)
        cat = unicodedata.category(ch)
        if len(low := ch.lower()) == 1:
            lower[cp] = ord(low)
        letter[cp] = cat[0] == "L"
        word[cp] = cat[0] in "LM" or cat == "Nd" or ch in "'’"
        upper[cp], small[cp], other[cp], digit[cp] = cat in ("Lu", "Lt"), cat == "Ll", cat in ("Lo", "Lm"), cat == "Nd"
        space[cp] = ch.isspace() or ch in "​﻿"
    return {"lower": lower, "letter": letter, "word": word, "upper": upper, "small": small, "other": other, "digit": digit, "space": space}


@lru_cache(maxsize=1)
def mixed_codes() -> np.ndarray:
    """``mix(code + 0x51)`` of the codes of the basic plane."""
    return mix(np.arange(0x10000, dtype=U64) + U64(0x51))


def mix_codes(codes: np.ndarray) -> np.ndarray:
    """``mix(codes + 0x51)`` of code points, from a table where they allow it."""
    if codes.max(initial=0) < 0x10000:
        return mixed_codes()[codes]
    return mix(codes.astype(U64) + U64(0x51))


@lru_cache(maxsize=16)
def _members(chars: str) -> np.ndarray:
    out = np.zeros(0x10000, bool)
    out[[ord(c) for c in chars]] = True
    return out


def among(low: np.ndarray, chars: str) -> np.ndarray:
    """Which codes of the basic plane are one of the characters."""
    return _members(chars)[low]


@lru_cache(maxsize=4)
def powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, dtype=U64)
    with np.errstate(over="ignore"):
        np.multiply.accumulate(np.concatenate((np.ones(1, U64), np.full(n - 1, U64(base), dtype=U64))), out=out)
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x.astype(U64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> U64(30)
        x *= U64(0xBF58476D1CE4E5B9)
        x ^= x >> U64(27)
        x *= U64(0x94D049BB133111EB)
        x ^= x >> U64(31)
    return x


def _pow(base: U64, exponents: np.ndarray) -> np.ndarray:
    size = 1 << max(10, int(exponents.max(initial=0) + 1).bit_length())
    return powers(int(base), size)[exponents]


def segment_sum(values: np.ndarray, segment: np.ndarray, n: int) -> np.ndarray:
    """Wrapping sums of values by ascending segment number."""
    out = np.zeros(n, dtype=U64)
    if len(values):
        first = np.flatnonzero(np.concatenate(([True], segment[1:] != segment[:-1])))
        out[segment[first]] = np.add.reduceat(values, first)
    return out


def rank_within(segment: np.ndarray) -> np.ndarray:
    """0, 1, 2, ... within each run of equal segment numbers."""
    if not len(segment):
        return np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate(([True], segment[1:] != segment[:-1])))
    return np.arange(len(segment)) - np.repeat(first, np.diff(np.append(first, len(segment))))


def sequence_hash(codes: np.ndarray, segment: np.ndarray, n: int) -> np.ndarray:
    """Hash of each segment's sequence of codes, of code points if they are of 32 bits; 0 for an empty one."""
    out = np.zeros(n, dtype=U64)
    if not len(codes):
        return out
    edge = np.empty(len(segment), bool)
    edge[0] = True
    np.not_equal(segment[1:], segment[:-1], out=edge[1:])
    first = np.flatnonzero(edge)
    values = mix_codes(codes) if codes.dtype == np.uint32 else mix(codes + U64(0x51))
    out[segment[first]] = run_hashes(running(values), first, np.append(first[1:], len(codes)))
    return out


def running(values: np.ndarray) -> np.ndarray:
    """Sums of mixed codes times powers by place, over all before each place and over all."""
    out = np.zeros(len(values) + 1, dtype=U64)
    with np.errstate(over="ignore"):
        np.cumsum(values * places(_P, len(values)), out=out[1:])
    return out


def run_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """``sequence_hash`` of the runs of places from ``start`` to before ``end``, from ``running``; 0 for an empty one.

    The difference of two sums has the powers of the run's places; the inverse at its start makes them 0, 1, 2, ...
    """
    with np.errstate(over="ignore"):
        got = mix((sums[end] - sums[start]) * places(_BACK, len(sums))[start]) | U64(1)
    return np.where(end > start, got, U64(0))


def places(base: U64, n: int) -> np.ndarray:
    """The powers 0 to n - 1."""
    return powers(int(base), AHEAD)[:n] if n <= AHEAD else powers.__wrapped__(int(base), n)


def before(mask: np.ndarray) -> np.ndarray:
    """How many are true before each place, and in all."""
    out = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=out[1:])
    return out


class Lines:
    """The lines of some texts; one entry per line in each array, blank lines included."""

    def __init__(self, texts: list[str]):
        t = tables()
        joined = "\n".join([x.replace("\r", " ") for x in texts] + [""])
        self.flat = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        low = np.minimum(self.flat, 0xFFFF).astype(np.intp)  # numpy is slower with other indices
        breaks = np.flatnonzero(self.flat == 10)
        self.n = len(breaks)
        self.start = np.concatenate(([0], breaks[:-1] + 1))
        self.end = breaks
        self.line_of = np.repeat(np.arange(self.n), self.end - self.start + 1)
        per_text = np.fromiter((x.count("\n") + 1 for x in texts), np.int64, len(texts))
        self.text_of = np.repeat(np.arange(len(texts)), per_text)
        self.line_no = rank_within(self.text_of) + 1
        self.lower = t["lower"][low]
        if self.flat.max(initial=0) > 0xFFFF:
            self.lower = np.where(self.flat > 0xFFFF, self.flat, self.lower)
        self.low = low
        inked = ~t["space"][low]
        at, passed = np.flatnonzero(inked), before(inked)
        lo, hi = passed[self.start], passed[self.end]
        self.inked = hi - lo
        # trimmed length: from the first to the last inked character
        first, last = np.zeros(self.n, np.int64), np.full(self.n, -1, np.int64)
        some = np.flatnonzero(hi > lo)
        first[some], last[some] = at[lo[some]], at[hi[some] - 1]
        self.first, self.last = first, last
        self.length = last - first + 1
        self._words = self._letters = self._mixed = None

    def mixed(self) -> np.ndarray:
        """``mix_codes`` of all characters in lower case."""
        if self._mixed is None:
            self._mixed = mix_codes(self.lower)
        return self._mixed

    def _letter_sums(self) -> tuple[np.ndarray, np.ndarray]:
        """(letters before each character, ``running`` of the letters)."""
        if self._letters is None:
            letter = tables()["letter"][self.low]
            self._letters = before(letter), running(self.mixed()[np.flatnonzero(letter)])
        return self._letters

    def letters(self) -> tuple[np.ndarray, np.ndarray]:
        """(hash, number) of each line's letters, ignoring case; hash 0 where there are none."""
        passed, sums = self._letter_sums()
        lo, hi = passed[self.start], passed[self.end]
        return run_hashes(sums, lo, hi), hi - lo

    def letters_before(self, at: np.ndarray) -> np.ndarray:
        """Hash of the letters before a position (one a line; -1 for none), as ``letters`` gives it."""
        passed, sums = self._letter_sums()
        return run_hashes(sums, passed[self.start], passed[np.maximum(at, self.start)])

    def words(self) -> dict[str, np.ndarray]:
        """Words of all lines: line, start, hash (lower case), and their classes."""
        if self._words is None:
            t = tables()
            edge = np.diff(np.concatenate(([0], t["word"][self.low].view(np.int8), [0])))
            start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            within = lambda kind: (n := before(t[kind][self.low]))[end] - n[start]
            upper = t["upper"][self.low[start]]
            self._words = {
                "line": self.line_of[start], "start": start, "end": end, "hash": run_hashes(running(self.mixed()), start, end),
                "capital": upper & (within("small") > 0), "lead_upper": upper, "number": within("digit") == end - start, "other": within("other") > 0,
            }
        return self._words

    def masked(self) -> tuple[np.ndarray, np.ndarray]:
        """(line, code) of each line's words with numbers and names masked, runs of a mask as one.

        A name is a capitalised word that does not open the line.
        """
        w = self.words()
        opens = rank_within(w["line"]) == 0
        code = np.where(w["number"], NUMBER, np.where(w["capital"] & ~opens, NAME, w["hash"]))
        again = np.concatenate(([False], (code[1:] == code[:-1]) & (code[1:] <= NAME) & (w["line"][1:] == w["line"][:-1]))) if len(code) else np.zeros(0, bool)
        return w["line"][~again], code[~again]

    def outline(self) -> np.ndarray:
        """Hash of each line's outline: classes of its words and its signs, runs of a class as one."""
        t = tables()
        w = self.words()
        klass = np.where(w["number"], 1, np.where(w["other"], 4, np.where(w["lead_upper"], 2, 3))).astype(U64)
        is_sign = ~t["word"][self.low] & ~t["space"][self.low]
        at = np.flatnonzero(is_sign)
        where = np.concatenate((w["start"], at))
        code = np.concatenate((klass, self.flat[at].astype(U64) + U64(100)))
        order = np.argsort(where, kind="stable")
        where, code = where[order], code[order]
        line = self.line_of[where] if len(where) else np.zeros(0, np.int64)
        again = np.concatenate(([False], (code[1:] == code[:-1]) & (line[1:] == line[:-1]))) if len(code) else np.zeros(0, bool)
        return sequence_hash(code[~again], line[~again], self.n)

    def shingles(self) -> tuple[np.ndarray, np.ndarray]:
        """(line, hash) of the masked word 5-shingles; a line of fewer words is one shingle."""
        line, code = self.masked()
        if not len(line):
            return line, code
        count = np.bincount(line, minlength=self.n)[line]
        rank = rank_within(line)
        mixed = mix(code + U64(0x51))
        with np.errstate(over="ignore"):
            total = np.zeros(len(code), dtype=U64)
            for j in range(SHINGLE):
                part = np.zeros(len(code), dtype=U64)
                part[: max(0, len(code) - j)] = mixed[j:]
                total += np.where(rank + j < count, part, U64(0)) * powers(int(_Q), 16)[j]
        keep = (rank + SHINGLE <= count) | ((count < SHINGLE) & (rank == 0))
        return line[keep], mix(total[keep])
