"""Token ids of a BPE with word ends, as the public library gives them, many texts at once.

Words are cut by numpy over code points (``scan.Joined``), hashed, and resolved in a table of the words met
before.  Words not met yet are merged together, those of like length as the rows of a matrix: in every round each row
joins its pair of lowest rank, the leftmost among equals, and loses one column.  The library cuts a text into the
same words and merges each by itself in the same order, so the ids are its own.  Words of more than ``LONG`` bytes and
texts with special strings go to the library.  The table holds ``WORDS`` words and starts anew when full, which
changes no id.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
from tokenizers import Tokenizer

from .scan import Joined, piece_hashes
from .transducer import WordBpe, _byte_letters

WIDTHS = (6, 10, 16, 40)  # bytes of the words of a matrix, at most
LONG = WIDTHS[-1]
NO_PAIR = np.int32(1 << 30)
PAIR_SLOTS = 1 << 19
WORDS = 1_000_000
SLOTS = 1 << 22
PIECE_CHARS = 400_000  # a longer text is encoded in parts


class WordTable:
    """Open addressing from 64-bit hashes to runs of token ids."""

    def __init__(self):
        self.keys = np.zeros(SLOTS, dtype=np.uint64)
        self.number = np.full(SLOTS, -1, dtype=np.int32)
        self.start = np.zeros(1, dtype=np.int64)  # of word i's ids, and the end
        self.ids = np.zeros(0, dtype=np.uint16)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each word, -1 where it is not held."""
        out = np.full(len(hashes), -1, dtype=np.int64)
        slot = (hashes & np.uint64(SLOTS - 1)).astype(np.int64)
        open_ = np.arange(len(hashes))
        while len(open_):
            number = self.number[slot[open_]]
            hit = (number >= 0) & (self.keys[slot[open_]] == hashes[open_])
            out[open_[hit]] = number[hit]
            open_ = open_[(number >= 0) & ~hit]
            slot[open_] = (slot[open_] + 1) & (SLOTS - 1)
        return out

    def add(self, hashes: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> None:
        """New, different words."""
        first = len(self.start) - 1
        self.start = np.append(self.start, self.start[-1] + np.cumsum(lengths))
        self.ids = np.append(self.ids, ids.astype(np.uint16))
        slot = (hashes & np.uint64(SLOTS - 1)).astype(np.int64)
        open_ = np.arange(len(hashes))
        while len(open_):
            free = open_[self.number[slot[open_]] < 0]
            mine = free[np.unique(slot[free], return_index=True)[1]]  # one word to a slot
            self.keys[slot[mine]] = hashes[mine]
            self.number[slot[mine]] = first + mine
            open_ = np.setdiff1d(open_, mine, assume_unique=True)
            taken = open_[self.number[slot[open_]] >= 0]
            slot[taken] = (slot[taken] + 1) & (SLOTS - 1)


class Merges:
    """Merges many words at once."""

    def __init__(self, vocab: dict[str, int], merges: list[list[str]], suffix: str):
        self.inner, self.last = np.zeros(256, dtype=np.int32), np.zeros(256, dtype=np.int32)
        for letter, b in _byte_letters().items():
            self.inner[b], self.last[b] = vocab[letter], vocab[letter + suffix]
        # open addressing from pairs of ids to the rank and the id of what they become
        # and one more slot that never holds a pair
        self.keys = np.full(PAIR_SLOTS + 1, -1, dtype=np.int64)
        self.rank = np.full(PAIR_SLOTS + 1, NO_PAIR, dtype=np.int32)
        self.made = np.zeros(PAIR_SLOTS + 1, dtype=np.int32)
        for i, (a, b) in enumerate(merges):
            key = vocab[a] << 16 | vocab[b]
            slot = self._slot(key)
            while self.keys[slot] >= 0:
                slot = (slot + 1) % PAIR_SLOTS
            self.keys[slot], self.rank[slot], self.made[slot] = key, i, vocab[a + b]

    @staticmethod
    def _slot(key):
        return (key * 2654435761 >> 9) % PAIR_SLOTS

    def _pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Slot of each pair; an empty one where the pair never merges or has no right side (-1)."""
        key = a.astype(np.int64) << 16 | b
        slot = self._slot(key)
        slot[b < 0] = PAIR_SLOTS
        wrong = np.flatnonzero((self.keys[slot] != key) & (self.keys[slot] >= 0))
        while len(wrong):
            slot[wrong] = (slot[wrong] + 1) % PAIR_SLOTS
            found = self.keys[slot[wrong]]
            wrong = wrong[(found != key[wrong]) & (found >= 0)]
        return slot

    def encode(self, utf8: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of ids, ids) of the words ``utf8[start:start + size]``, none longer than the last of ``WIDTHS``."""
        lengths = sizes.astype(np.int64)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        least = 0
        for width in WIDTHS:
            word = np.flatnonzero((sizes > least) & (sizes <= width))
            least = width
            if not len(word):
                continue
            size = sizes[word]
            inside = np.arange(width) < size[:, None]
            letters = utf8[np.where(inside, starts[word][:, None] + np.arange(width), 0)]
            ids = np.where(inside, self.inner[letters], -1)
            ids[np.arange(len(word)), size - 1] = self.last[letters[np.arange(len(word)), size - 1]]
            ids = np.concatenate([ids, np.full((len(word), 1), -1, dtype=ids.dtype)], axis=1)
            pairs = self._pairs(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(word), width)
            while len(word):
                rank = self.rank[pairs]
                at = np.argmin(rank, axis=1)  # the leftmost of the lowest
                row = np.arange(len(word))
                going = rank[row, at] < NO_PAIR
                if not going.all():
                    done.append((word[~going], ids[~going]))
                    word, ids, pairs, at = word[going], ids[going], pairs[going], at[going]
                    row = np.arange(len(word))
                if not len(word):
                    break
                lengths[word] -= 1
                ids[row, at] = self.made[pairs[row, at]]
                # the columns right of the joined one move left; the last is empty again
                moved = np.arange(width) > at[:, None]
                ids[:, :-1] = np.where(moved, ids[:, 1:], ids[:, :-1])
                pairs[:, :-1] = np.where(moved[:, 1:] | (np.arange(width - 1) == at[:, None]), pairs[:, 1:], pairs[:, :-1])
                pairs[:, -1] = PAIR_SLOTS
                # the pairs on both sides of the new id
                for side, has in ((at - 1, at > 0), (at, None)):
                    r = row if has is None else row[has]
                    c = side if has is None else side[has]
                    pairs[r, c] = self._pairs(ids[r, c], ids[r, c + 1])
        at = np.cumsum(lengths) - lengths
        out = np.zeros(int(lengths.sum()), dtype=np.uint16)
        for word, ids in done:
            held = ids >= 0
            out[(at[word][:, None] + np.arange(ids.shape[1]))[held]] = ids[held]
        return lengths, out


class WordIds:
    """Encodes texts in a task."""

    def __init__(self, spec: str, bpe: WordBpe):
        self.library = Tokenizer.from_str(spec)
        self.library.no_truncation()
        self.library.no_padding()
        if self.library.get_vocab_size(with_added_tokens=True) > 1 << 16:
            raise ValueError("ids beyond 16 bits")
        model = json.loads(spec)["model"]
        self.merges = Merges(model["vocab"], [m if isinstance(m, list) else m.split(" ") for m in model["merges"]],
                             model["end_of_word_suffix"])
        self.classes, self.lower, self.specials = bpe.classes, bpe.lower, bpe.specials
        self.odd = re.compile("([" + "".join(map(re.escape, bpe.lower)) + "])") if bpe.lower else None
        self.table = WordTable()

    def _lowered(self, text: str) -> str:
        if text.isascii():
            return text.lower()
        try:
            text.encode("latin-1")  # composed already, and lowered alike by every version of Unicode
            return text.lower()
        except UnicodeEncodeError:
            pass
        # the library lowers each character by itself, by its own version of Unicode
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        if self.odd is None or not self.odd.search(text):
            return text.lower()
        return "".join(self.lower[p] if i % 2 else p.lower() for i, p in enumerate(self.odd.split(text)))

    def _by_library(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype=np.uint16)

    def _learn(self, joined: Joined, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        offsets = joined.byte_offsets()
        begin, size = offsets[starts], offsets[ends] - offsets[starts]
        short = size <= LONG
        self.table.add(hashes[short], *self.merges.encode(
            np.frombuffer(joined.utf8, dtype=np.uint8), begin[short], size[short]))
        if not short.all():
            words = [joined.utf8[a:a + n].decode("utf-8") for a, n in zip(begin[~short].tolist(), size[~short].tolist(), strict=True)]
            found = [self._by_library(w) for w in words]
            self.table.add(hashes[~short], np.array([len(f) for f in found]), np.concatenate(found))

    def _by_words(self, texts: list[str]) -> list[np.ndarray]:
        joined = Joined([self._lowered(t) for t in texts], self.classes)
        starts, ends = joined.bare_pieces()
        hashes = piece_hashes(joined.cp, starts, ends)
        number = self.table.find(hashes)
        if (number < 0).any():
            new, first = np.unique(hashes[number < 0], return_index=True)
            at = np.flatnonzero(number < 0)[first]
            if len(self.table.start) + len(new) > WORDS:
                self.table = WordTable()
                new, at = np.unique(hashes, return_index=True)
            self._learn(joined, new, starts[at], ends[at])
            number = self.table.find(hashes)
        begin = self.table.start[number]
        lengths = self.table.start[number + 1] - begin
        until = np.cumsum(lengths)
        ids = self.table.ids[np.repeat(begin - (until - lengths), lengths) + np.arange(until[-1] if len(until) else 0)]
        # ids of a text: those of the words before its separator
        word = np.searchsorted(starts, joined.sep)
        cut = np.append(0, until)[word]
        return np.split(ids, cut[:-1])

    def _parts(self, text: str) -> Iterator[str]:
        """A text, cut at white space if it is long: no word and no special string reaches over a cut."""
        while len(text) > PIECE_CHARS:
            cut = max(text.rfind(" ", 0, PIECE_CHARS), text.rfind("\n", 0, PIECE_CHARS))
            if cut <= 0:
                break
            yield text[:cut]
            text = text[cut:]
        yield text

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """Ids (uint16) of every text."""
        out: list[np.ndarray] = [np.zeros(0, dtype=np.uint16)] * len(texts)
        plain: list[int] = []
        for i, text in enumerate(texts):
            if any(x in text for x in self.specials):
                out[i] = np.concatenate([self._by_library(p) for p in self._parts(text)])
            elif len(text) > PIECE_CHARS:
                out[i] = np.concatenate([self._by_words([p])[0] for p in self._parts(text)])
            else:
                plain.append(i)
        if plain:
            for i, ids in zip(plain, self._by_words([texts[i] for i in plain]), strict=True):
                out[i] = ids
        return out
