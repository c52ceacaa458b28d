"""Pre-token boundaries of many texts at once, by numpy over code points.

Used inside tasks by the tokenizer operators.  Texts are joined with one separator
position after each; every code point gets a class (letter, number, other, white
space), and the boundaries of the two public tokenizer patterns follow from runs
of classes, so no text is matched character by character in Python.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import regex

LETTER, NUMBER, OTHER, SPACE, SEPARATOR = range(5)
# The contractions of the public patterns, without the apostrophe.
ONE_LETTER = "stmd"
TWO_LETTERS = ("re", "ve", "ll")


EVERY = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))


def regex_runs(pattern: str, text: str) -> list[tuple[int, int]]:
    return [m.span() for m in regex.finditer(pattern, text)]


def code_point_classes(runs: Callable[[str, str], list[tuple[int, int]]] = regex_runs) -> np.ndarray:
    """Class of every code point (one byte each); ``runs`` finds the matches of a pattern in a text,
    as libraries follow different versions of Unicode."""
    table = np.full(0x110000, OTHER, dtype=np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for start, end in runs(pattern, EVERY):
            # a run may step over the surrogate gap, whose code points never occur in text
            table[ord(EVERY[start]):ord(EVERY[end - 1]) + 1] = kind
    return table


class Joined:
    """Texts joined to one array of code points; ``sep[i]`` is the position after text i."""

    def __init__(self, texts: list[str], classes: np.ndarray):
        joined = "\n".join(texts) + "\n"
        self.cp = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
        lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        self.sep = np.cumsum(lengths + 1) - 1
        self.kind = classes[self.cp]
        self.kind[self.sep] = SEPARATOR
        self.utf8 = joined.encode("utf-8")
        width = np.ones(len(self.cp), dtype=np.int8)
        if len(self.utf8) != len(self.cp):
            width += self.cp >= 0x80
            width += self.cp >= 0x800
            width += self.cp >= 0x10000
        self.width = width

    def run_starts(self) -> np.ndarray:
        first = np.ones(len(self.kind), dtype=bool)
        np.not_equal(self.kind[1:], self.kind[:-1], out=first[1:])
        return first

    def contractions(self, run_start: np.ndarray, after_blank: bool) -> tuple[np.ndarray, np.ndarray]:
        """Positions of apostrophes that begin a contraction, and how many letters follow in it."""
        at = np.flatnonzero((self.cp == 0x27) & run_start)
        at = at[self.kind[at + 1] == LETTER]  # the last position is a separator
        if not after_blank:
            at = at[(at == 0) | (self.cp[np.maximum(at - 1, 0)] != 0x20)]
        one = np.isin(self.cp[at + 1], [ord(c) for c in ONE_LETTER])
        second = self.cp[np.minimum(at + 2, len(self.cp) - 1)]
        two = np.zeros(len(at), dtype=bool)
        for a, b in TWO_LETTERS:
            two |= (self.cp[at + 1] == ord(a)) & (second == ord(b))
        hit = one | two
        return at[hit], np.where(one[hit], 1, 2)

    def _split_contractions(self, start: np.ndarray, run_start: np.ndarray, after_blank: bool) -> None:
        at, letters = self.contractions(run_start, after_blank)
        start[at + 1] = False
        start[at + 1 + letters] = True

    def spaced_pieces(self) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of ``'s|'t|'re|'ve|'m|'ll|'d| ?L+| ?N+| ?other+|\\s+(?!\\S)|\\s+``."""
        run_start = self.run_starts()
        start = run_start.copy()
        # the last blank before a word stands apart from the blanks before it, and joins the word if it is U+0020
        last = np.flatnonzero((self.kind[:-1] == SPACE) & (self.kind[1:] < SPACE))
        start[last] = True
        start[last[self.cp[last] == 0x20] + 1] = False
        self._split_contractions(start, run_start, after_blank=False)
        starts = np.flatnonzero(start)
        ends = np.append(starts[1:], len(start))
        text = self.kind[starts] != SEPARATOR
        return starts[text], ends[text]

    def bare_pieces(self) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of ``'s|'t|'re|'ve|'m|'ll|'d|L+|N|other+``; blanks belong to none."""
        run_start = self.run_starts()
        start = run_start | (self.kind == NUMBER)
        self._split_contractions(start, run_start, after_blank=True)
        starts = np.flatnonzero(start)
        ends = np.append(starts[1:], len(start))
        word = self.kind[starts] < SPACE
        return starts[word], ends[word]

    def byte_offsets(self) -> np.ndarray:
        """First UTF-8 byte of every code point, and the end."""
        return np.concatenate([[0], np.cumsum(self.width, dtype=np.int64)])


_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_powers = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2**64, kept for the next call."""
    if len(_powers.get(base, ())) < n:
        p = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        p[0] = 1
        _powers[base] = np.multiply.accumulate(p)
    return _powers[base][:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def piece_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of ``values[start:end]`` for each piece, equal for equal contents wherever they stand."""
    n = len(values)
    scrambled = mix64(values.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019))
    total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(scrambled * _power(_MULTIPLIER, n))])
    h = (total[ends] - total[starts]) * _power(_INVERSE, n + 1)[starts]
    return mix64(h + (ends - starts).astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
