"""Token counts by a compiled finite-state transducer.

The tokenizer (lower case, words cut by a public pattern, BPE with word ends) is
compiled into a deterministic transducer over (byte, ends-a-word) symbols.  A
transition carries the change of the token count; its sum over a word is the
word's number of tokens, and every word end leads back to the start state.

Compilation.  BPE is settled by pairs: a token sequence is the encoding of its
bytes exactly when each adjacent pair is the encoding of its own bytes.  So the
last token of an encoded prefix is the one token that ends there and fits the
last token of the prefix before it.  A state holds, for every place from which
a token may still reach further, the node of the token trie, the last token
before that place, and the count up to it relative to now.  States and
transitions are made on first use; the table is bounded by ``TABLE_CELLS`` and
restarted when full, which changes no count.

Running.  A slice of texts becomes one symbol sequence cut into chunks that
advance together, one numpy step per position.  A chunk is a map from state to
(state, count); from its first word end on it is constant.  A scan composes the
chunks' maps, whose entries are made for the states that reach them, many chunks at once (``_scan``); heads before a
first word end are then run from the state that comes in.  Each document's count is the sum of its own symbols'
transitions.

A task holds one slice of texts and the table.  Defined results: a null text is
an empty one with 0 tokens; special strings inside a text are one token each,
as by the library's default; rows and further columns are carried through.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tokenizers import Regex, normalizers, pre_tokenizers

from .bpe import slices
from .common import map_arrow
from .scan import EVERY, Joined, code_point_classes

TABLE_CELLS = 32_000_000  # transitions held by a worker, four bytes each
CHUNK = 512  # symbols that a lane reads
ENDS = 256  # added to the byte that ends a word


class WordBpe:
    """Merges and special strings of a tokenizer file: BPE over bytes whose last one ends the word."""

    def __init__(self, vocab: dict[str, int], merges: list[list[str]], specials: list[str], suffix: str = "</w>"):
        letters = _byte_letters()

        def symbols(token: str) -> tuple[int, ...]:
            ends = token.endswith(suffix)
            out = [letters[c] for c in (token[:-len(suffix)] if ends else token)]
            return (*out[:-1], out[-1] + ENDS) if ends else tuple(out)

        self.specials = specials
        self.tokens = sorted({symbols(t) for t in vocab if t not in specials and t != suffix})
        self.rank = {(symbols(a), symbols(b)): i for i, (a, b) in enumerate(merges)}
        self.classes = code_point_classes(_library_runs)
        # lower-case forms that the library's version of Unicode has and Python's has not, or has otherwise
        low = normalizers.Lowercase().normalize_str("\n".join(EVERY.replace("\n", " "))).split("\n")
        self.lower = {c: x for c, x in zip(EVERY, low, strict=True) if c != "\n" and c.lower() != x}
        self.name = xxhash.xxh3_128_hexdigest(repr((self.tokens, merges, specials)))

    @classmethod
    def read(cls, path: str) -> WordBpe:
        """A tokenizer file whose model is BPE with a word-end suffix."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        return cls(model["vocab"], merges, [t["content"] for t in spec["added_tokens"]], model["end_of_word_suffix"])

    def merge(self, symbols: tuple[int, ...]) -> list[tuple[int, ...]]:
        """Encoding of a short symbol sequence by the definition: lowest merge first, leftmost among equals."""
        parts = [(s,) for s in symbols]
        while True:
            best = min(((r, i) for i in range(len(parts) - 1)
                        if (r := self.rank.get((parts[i], parts[i + 1]))) is not None), default=None)
            if best is None:
                return parts
            i = best[1]
            parts[i:i + 2] = [parts[i] + parts[i + 1]]


def _library_runs(pattern: str, text: str) -> list[tuple[int, int]]:
    cut = pre_tokenizers.Split(Regex(pattern), "removed", invert=True)
    return [span for _, span in cut.pre_tokenize_str(text)]


def _byte_letters() -> dict[str, int]:
    """Printable stand-in of each byte in byte-level vocabularies: itself if printable, else the next from 256 on."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Transducer:
    """Lazily built deterministic transducer of a ``WordBpe``; state 0 is the start of a word."""

    def __init__(self, bpe: WordBpe, cells: int = TABLE_CELLS):
        self.bpe = bpe
        if max(map(len, bpe.tokens)) > 63:
            raise ValueError("tokens of more than 63 bytes do not fit the table")
        self.trie: list[dict[int, int]] = [{}]
        self.token_at: list[int] = [-1]
        self.tokens = bpe.tokens
        for k, token in enumerate(self.tokens):
            node = 0
            for s in token:
                if s not in self.trie[node]:
                    self.trie[node][s] = len(self.trie)
                    self.trie.append({})
                    self.token_at.append(-1)
                node = self.trie[node][s]
            self.token_at[node] = k
        self.fits: dict[tuple[int, int], bool] = {}
        self.cells = cells
        self._restart()

    def _restart(self) -> None:
        self.column = np.full(2 * ENDS, -1, dtype=np.int64)  # of a symbol: columns are given on first use
        self.n_columns = 0
        # next state * 128 + change of the count + 64; a token has at most 63 bytes, so the change fits
        self.table = np.full((1024, 64), -1, dtype=np.int32)
        start = ((0, -1, 0),)
        self.states = [start]
        self.number = {start: 0}

    def _fit(self, before: int, token: int) -> bool:
        key = (before, token)
        if key not in self.fits:
            t = self.tokens[token]
            if before < 0:
                self.fits[key] = self.bpe.merge(t) == [t]
            else:
                b = self.tokens[before]
                self.fits[key] = self.bpe.merge(b + t) == [b, t]
        return self.fits[key]

    def step(self, state: tuple, symbol: int) -> tuple[tuple, int]:
        """Next state and change of the count; places are (trie node, last token before, relative count)."""
        reach, last, count = [], None, 0
        for node, before, rel in state:
            child = self.trie[node].get(symbol)
            if child is None:
                continue
            reach.append((child, before, rel))
            token = self.token_at[child]
            if last is None and token >= 0 and self._fit(before, token):
                last, count = token, rel + 1
        if last is None:
            raise ValueError("a byte without a token")
        if symbol >= ENDS:
            return self.states[0], count
        alive = [(c, b, r - count) for c, b, r in reach if self.trie[c]]
        return (*alive, (0, last, 0)), count

    def full(self) -> bool:
        return len(self.states) * max(64, self.n_columns) > self.cells

    def columns_of(self, symbols: np.ndarray) -> np.ndarray:
        new = np.flatnonzero((np.bincount(symbols, minlength=2 * ENDS) > 0) & (self.column < 0))
        self.column[new] = self.n_columns + np.arange(len(new))
        self.n_columns += len(new)
        if self.n_columns > self.table.shape[1]:
            self._grow(self.table.shape[0], -(-self.n_columns // 64) * 64)
        self.symbol = np.argsort(np.where(self.column < 0, 4 * ENDS, self.column), kind="stable")
        return self.column[symbols]

    def _grow(self, rows: int, columns: int) -> None:
        new = np.full((rows, columns), -1, dtype=np.int32)
        new[:self.table.shape[0], :self.table.shape[1]] = self.table
        self.table = new

    def _make(self, state: np.ndarray, column: np.ndarray) -> None:
        """Adds the transitions (state, column) that lanes have asked for."""
        for pair in np.unique(state.astype(np.int64) * (4 * ENDS) + column).tolist():
            at, c = divmod(pair, 4 * ENDS)
            to, count = self.step(self.states[at], int(self.symbol[c]))
            if to not in self.number:
                self.number[to] = len(self.states)
                self.states.append(to)
                if len(self.states) > self.table.shape[0]:
                    self._grow(self.table.shape[0] * 5 // 4, self.table.shape[1])
            self.table[at, c] = self.number[to] * 128 + count + 64

    def _advance(self, columns: np.ndarray, out: np.ndarray, at: np.ndarray, stop: np.ndarray,
                 state: np.ndarray) -> np.ndarray:
        """Runs lanes over ``columns[at:stop]`` from ``state``; counts go to ``out``; returns the last states."""
        final = state.astype(np.int64)
        lane = np.flatnonzero(at < stop)
        pos, state, stop = at[lane], state[lane], stop[lane]
        while len(lane):
            c = columns[pos]
            to = self.table[state, c]
            if (lacking := to < 0).any():
                self._make(state[lacking], c[lacking])
                to = self.table[state, c]
            out[pos] = (to & 127) - 64
            state = to >> 7
            pos = pos + 1
            if (over := pos >= stop).any():
                final[lane[over]] = state[over]
                going = ~over
                lane, pos, state, stop = lane[going], pos[going], state[going], stop[going]
        return final

    def _scan(self, columns: np.ndarray, out: np.ndarray, begin: np.ndarray, stop: np.ndarray, last: np.ndarray,
              constant: np.ndarray) -> np.ndarray:
        """The state that comes into every chunk; chunks without a word end are run from it.

        A chunk with a word end maps every state to ``last``.  The map of any other chunk is filled in where it is asked
        for: the maps are composed from the left, an entry that is missing stands in by another one of its chunk, and
        all that was missing on the way is run at once, one lane per chunk.  A round settles the first unsettled chunk at
        least, and as a rule all of them, since the states that come into a long word soon run together.
        """
        maps: list[dict[int, int]] = [{} for _ in begin]
        ran = np.full(len(begin), -1, dtype=np.int64)
        came = np.zeros(len(begin), dtype=np.int64)
        while True:
            state, missing = 0, []
            for i in range(len(begin)):
                came[i] = state
                if constant[i]:
                    state = int(last[i])
                elif state in maps[i]:
                    state = maps[i][state]
                else:
                    missing.append(i)
                    state = next(iter(maps[i].values()), 0)
            # in the end every chunk has to stand as run from the state that really comes
            todo = np.array(missing, dtype=np.int64) if missing else np.flatnonzero(~constant & (ran != came))
            if not len(todo):
                return came
            ended = self._advance(columns, out, begin[todo], stop[todo], came[todo])
            ran[todo] = came[todo]
            for i, s, e in zip(todo.tolist(), came[todo].tolist(), ended.tolist(), strict=True):
                maps[i][s] = e

    def run(self, symbols: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
        """Change of the token count at every symbol of a sequence that begins with a word."""
        n = len(symbols)
        out = np.zeros(n, dtype=np.int64)
        if n == 0:
            return out
        if self.full():
            self._restart()
        columns = self.columns_of(symbols)
        begin = np.arange(0, n, chunk)
        stop = np.minimum(begin + chunk, n)
        # tail of each chunk: from its first word end on the state does not depend on what comes in
        word_ends = np.flatnonzero(symbols >= ENDS)
        k = np.searchsorted(word_ends, begin)
        first = np.append(word_ends, n)[k]
        constant = first < stop
        head = np.where(constant, first + 1, stop)
        last = self._advance(columns, out, head, stop, np.zeros(len(begin), dtype=np.int64))
        came = self._scan(columns, out, begin, stop, last, constant)
        heads = np.flatnonzero(constant)
        self._advance(columns, out, begin[heads], head[heads], came[heads])
        return out


class Counter:
    """Counts tokens of texts in a task."""

    def __init__(self, bpe: WordBpe):
        self.classes = bpe.classes
        self.transducer = Transducer(bpe)
        self.specials = bpe.specials
        self.cut = regex.compile("|".join(map(regex.escape, bpe.specials))) if bpe.specials else None
        self.lower = bpe.lower
        self.odd = regex.compile("([" + "".join(map(regex.escape, bpe.lower)) + "])") if bpe.lower else None

    def _plain(self, text: str) -> tuple[str, int]:
        """Lower-cased text with special strings cut out, and how many there were."""
        n, parts = 0, [text]
        if self.cut is not None and any(s in text for s in self.specials):
            parts = self.cut.split(text)
            n = len(parts) - 1
        # parts are normalised one by one; a blank between them is no part of any word
        return " ".join(map(self._lowered, parts)), n

    def _lowered(self, text: str) -> str:
        if text.isascii():
            return text.lower()
        text = unicodedata.normalize("NFC", text)
        text = text.replace("Σ", "σ")  # the library lowers each character by itself
        if self.odd is None or not self.odd.search(text):
            return text.lower()
        return "".join(self.lower[p] if i % 2 else p.lower() for i, p in enumerate(self.odd.split(text)))

    def count_all(self, texts: list[str]) -> np.ndarray:
        plain, special = zip(*map(self._plain, texts), strict=True) if texts else ((), ())
        joined = Joined(list(plain), self.classes)
        starts, ends = joined.bare_pieces()
        offsets = joined.byte_offsets()
        symbols = np.frombuffer(joined.utf8, dtype=np.uint8).astype(np.int64)
        symbols[offsets[ends] - 1] += ENDS
        inside = np.zeros(len(symbols) + 1, dtype=np.int8)
        inside[offsets[starts]] += 1
        inside[offsets[ends]] -= 1
        inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
        counts = np.zeros(len(symbols) + 1, dtype=np.int64)
        counts[1:][inside] = self.transducer.run(symbols[inside])
        until = np.cumsum(counts)[offsets[joined.sep]]
        return np.diff(until, prepend=0) + np.array(special, dtype=np.int64)


_COUNTERS: dict[str, Counter] = {}


def _counter(bpe: WordBpe) -> Counter:
    if bpe.name not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[bpe.name] = Counter(bpe)
    return _COUNTERS[bpe.name]


def count_tokens(df: DataFrame, bpe: WordBpe, text: str = "text", n_tokens: str = "n_tokens",
                 n_bytes: str = "n_bytes") -> DataFrame:
    """``df`` with the number of tokens and of UTF-8 bytes (both long) of every whole ``text``."""
    sent = df.sparkSession.sparkContext.broadcast(bpe)
    kept = [c for c in df.columns if c not in (n_tokens, n_bytes)]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(c, T.LongType()) for c in (n_bytes, n_tokens)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(sent.value)
        for whole in batches:
            for batch, texts in slices(whole, text):
                size = pa.array([len(t.encode("utf-8")) for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c) for c in kept] + [size, pa.array(counter.count_all(texts))],
                    [*kept, n_bytes, n_tokens])

    return map_arrow(df, run, schema)
