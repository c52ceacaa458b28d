"""Byte-level BPE encoding and decoding with a two-tier lookup.

A text is cut into pre-tokens by the public pattern (``scan.Joined.spaced_pieces``).  Tier one is a minimal
perfect hash over the vocabulary: one probe and one byte comparison say whether
a whole pre-token is a token, and which.  Tier two, for the misses, merges the
pre-token's bytes, kept as a linked list, by a heap of candidate pairs (lowest
rank first, leftmost among equals).  Each distinct
pre-token (by 64-bit hash) of a slice of texts is resolved once and kept in a
memo of at most ``MEMO`` entries per task that is emptied when full, so memory is
bounded and every text is encoded whole.  The memo is a few sorted arrays, some 30 bytes an entry, and a slice
is short: what an executor's workers hold comes on top of a heap that earlier steps of a job have filled.

The vocabulary file is a parameter; the driver reads it once and sends the hash
(a size fixed by the vocabulary) to the tasks.  The work is a narrow map over
Arrow batches: no shuffle, and a lost task is simply run again.

Defined results: a null text is an empty one (no ids); a null id list decodes to
empty bytes; a column already named like the result is replaced.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow, release_memory
from .scan import Joined, code_point_classes, piece_hashes

MEMO = 200_000
SLICE_BYTES = 500_000  # bytes of text looked at at a time
ENCODED_BYTES = 100_000  # bytes of text encoded at a time, which take some 100 bytes each
SLICE_IDS = 100_000  # ids decoded at a time
KEYS_PER_BUCKET = 4


class PerfectHash:
    """Minimal perfect hash of byte strings by hash and displace: ``n`` keys, ``n`` slots.

    A key's bucket holds a displacement that sends all keys of the bucket to free slots; buckets
    of one key hold the slot itself.  ``find`` returns the position of each key in ``keys`` or -1.
    """

    def __init__(self, keys: list[bytes]):
        self.n = max(1, len(keys))
        self.n_buckets = max(1, len(keys) // KEYS_PER_BUCKET)
        h = self._hashes(keys)
        bucket = (h % np.uint64(self.n_buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(self.n_buckets + 1))
        sizes = np.diff(cuts)
        self.shift = np.zeros(self.n_buckets, dtype=np.int64)
        self.item = np.full(self.n, -1, dtype=np.int64)
        for b in np.argsort(-sizes, kind="stable")[:int((sizes > 1).sum())]:
            g = order[cuts[b]:cuts[b + 1]]
            self.shift[b] = self._displace(h[g])
            self.item[self._slots(h[g], self.shift[b])] = g
        alone = np.flatnonzero(sizes == 1)
        slots = np.flatnonzero(self.item < 0)[:len(alone)]
        self.shift[alone] = -1 - slots
        self.item[slots] = order[cuts[alone]]
        self.keys = keys

    def _displace(self, h: np.ndarray) -> int:
        """The first displacement that sends ``h`` to different free slots, tried 256 at a time."""
        tries = np.arange(256, dtype=np.int64)
        while True:
            slots = self._slots(h[:, None], tries[None, :])
            free = (self.item[slots] < 0).all(axis=0)
            if len(h) > 1:
                ordered = np.sort(slots, axis=0)
                free &= (ordered[1:] != ordered[:-1]).all(axis=0)
            if free.any():
                return int(tries[free.argmax()])
            tries += 256

    @staticmethod
    def _hashes(keys: list[bytes]) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), dtype=np.uint64, count=len(keys))

    def _slots(self, h: np.ndarray, shift: np.ndarray | np.int64) -> np.ndarray:
        x = h + (np.atleast_1d(shift).astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(29)
        return (x % np.uint64(self.n)).astype(np.int64)

    def find(self, keys: list[bytes]) -> list[int]:
        if not keys:
            return []
        h = self._hashes(keys)
        shift = self.shift[(h % np.uint64(self.n_buckets)).astype(np.int64)]
        slots = np.where(shift < 0, -1 - shift, self._slots(h, np.maximum(shift, 0)))
        own = self.keys
        return [i if i >= 0 and own[i] == k else -1 for i, k in zip(self.item[slots].tolist(), keys, strict=True)]


class Vocabulary:
    """Tokens by rank with their perfect hash, and the code point classes; ids are ranks."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.hash = PerfectHash(tokens)
        self.classes = code_point_classes()
        self.name = xxhash.xxh3_128_hexdigest(b"".join(len(t).to_bytes(4, "little") + t for t in tokens))

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        """A rank file: one ``base64(token) rank`` per line, ranks 0 .. n-1."""
        with open(path, "rb") as f:
            ranked = [(int(r), base64.b64decode(t)) for t, r in (line.split() for line in f if line.strip())]
        ranked.sort()
        if [r for r, _ in ranked] != list(range(len(ranked))):
            raise ValueError("ranks must be 0 .. n-1")
        return cls([t for _, t in ranked])


def merge_bytes(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: repeatedly join the adjacent pair of lowest rank, leftmost first."""
    n = len(piece)
    end = list(range(1, n + 1))  # of the part that begins here
    before = list(range(-1, n - 1))
    alive = [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i:i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = end[i]
        if not alive[i] or j >= n or end[j] != stop:
            continue  # one of the two parts has changed since
        alive[j] = False
        end[i] = stop
        if stop < n:
            before[stop] = i
            if (r := ranks.get(piece[i:end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (p := before[i]) >= 0 and (r := ranks.get(piece[p:stop])) is not None:
            heapq.heappush(heap, (r, p, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i:end[i]]])
        i = end[i]
    return out


class Encoder:
    """Encodes texts in a task; pre-tokens met before come from a memo of ``memo`` entries at most."""

    def __init__(self, vocab: Vocabulary, memo: int = MEMO):
        self.classes = vocab.classes
        self.hash = vocab.hash
        self.ranks = {t: i for i, t in enumerate(vocab.tokens)}
        self.limit = memo
        self._empty()

    def _empty(self) -> None:
        self.keys = np.zeros(0, dtype=np.uint64)  # hashes of the pre-tokens, ascending
        self.first, self.count = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32)  # their ids in pool
        self.pool = np.zeros(0, dtype=np.int32)

    def _learn(self, keys: np.ndarray, pieces: list[bytes]) -> None:
        """Takes in pre-tokens not met before, with ascending ``keys``."""
        found = [[rank] if rank >= 0 else merge_bytes(piece, self.ranks)
                 for piece, rank in zip(pieces, self.hash.find(pieces), strict=True)]
        counts = np.fromiter(map(len, found), dtype=np.int32, count=len(found))
        firsts = len(self.pool) + np.cumsum(counts, dtype=np.int64) - counts
        at = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, at, keys)
        self.first, self.count = np.insert(self.first, at, firsts), np.insert(self.count, at, counts)
        self.pool = np.append(self.pool, np.fromiter(
            (i for x in found for i in x), dtype=np.int32, count=int(counts.sum())))

    def _unmet(self, keys: np.ndarray) -> np.ndarray:
        """Places in ``keys`` of those that the memo does not hold."""
        if not len(self.keys):
            return np.arange(len(keys))
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.flatnonzero(self.keys[at] != keys)

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and where each text's ids begin (one more: the end)."""
        joined = Joined(texts, self.classes)
        starts, ends = joined.spaced_pieces()
        keys, where, inverse = np.unique(
            piece_hashes(joined.cp, starts, ends), return_index=True, return_inverse=True)
        if len(self.keys) + len(keys) > self.limit:
            self._empty()
        new = self._unmet(keys)
        if len(new):
            offsets = joined.byte_offsets()
            first, last = offsets[starts[where[new]]].tolist(), offsets[ends[where[new]]].tolist()
            raw = joined.utf8
            self._learn(keys[new], [raw[a:b] for a, b in zip(first, last, strict=True)])
        entry = np.searchsorted(self.keys, keys)[inverse]
        ids = gather(self.pool, self.first[entry], self.count[entry])
        per_piece = np.concatenate([[0], np.cumsum(self.count[entry], dtype=np.int64)])
        cuts = per_piece[np.searchsorted(starts, np.concatenate([[0], joined.sep]))]
        return ids, cuts


def gather(pool: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """``pool[f:f + c]`` for each f, c, one after another."""
    before = np.cumsum(count, dtype=np.int64) - count
    return pool[np.repeat(first - before, count) + np.arange(int(count.sum()), dtype=np.int64)]


def slices(batch: pa.RecordBatch, text: str, size: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Consecutive rows with about ``size`` bytes of text (one row at least); null texts are empty."""
    bytes_of = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy()
    for begin, end in cuts_of(bytes_of, size):
        part = batch.slice(begin, end - begin)
        yield part, ["" if t is None else t for t in part.column(text).to_pylist()]


def cuts_of(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive rows whose sizes sum to ``limit`` at most, or of one row."""
    begin = held = 0
    for i, n in enumerate(sizes.tolist()):
        if held and held + n > limit:
            yield begin, i
            begin, held = i, 0
        held += n + 1
    if begin < len(sizes):
        yield begin, len(sizes)


def _replace(df: DataFrame, column: str, kind: T.DataType) -> tuple[list[str], T.StructType]:
    names = [c for c in df.columns if c != column]
    return names, T.StructType([df.schema[c] for c in names] + [T.StructField(column, kind)])


class Decoder:
    """Token bytes as one pool, so that many ids are decoded by one gather."""

    def __init__(self, tokens: list[bytes]):
        self.pool = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        self.size = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens))
        self.first = np.cumsum(self.size) - self.size

    def decode_all(self, lists: pa.Array) -> pa.Array:
        """Bytes of each list of ids; a null list is empty."""
        lists = lists.fill_null([])
        flat = lists.flatten().to_numpy()
        raw = gather(self.pool, self.first[flat], self.size[flat])
        ends = np.concatenate([[0], np.cumsum(self.size[flat])])
        cuts = ends[np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])]
        return pa.Array.from_buffers(pa.large_binary(), len(lists), [
            None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(raw)]).cast(pa.binary())


def _id_lists(encoder: Encoder, texts: list[str]) -> pa.Array:
    flat, cuts = encoder.encode_all(texts)
    return pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(flat))


def encode(df: DataFrame, vocab: Vocabulary, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` with the ids (array<int>) of every whole ``text``."""
    sent = df.sparkSession.sparkContext.broadcast(vocab)
    kept, schema = _replace(df, ids, T.ArrayType(T.IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(sent.value)
        for whole in batches:
            for batch, texts in slices(whole, text, ENCODED_BYTES):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c) for c in kept] + [_id_lists(encoder, texts)], [*kept, ids])
                release_memory()

    return map_arrow(df, run, schema)


def decode(df: DataFrame, vocab: Vocabulary, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the bytes (binary) that ``ids`` stand for."""
    sent = df.sparkSession.sparkContext.broadcast(vocab.tokens)
    kept, schema = _replace(df, out, T.BinaryType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(sent.value)
        for whole in batches:
            lengths = pc.fill_null(pc.list_value_length(whole.column(ids)), 0).to_numpy()
            for begin, end in cuts_of(lengths, SLICE_IDS):
                batch = whole.slice(begin, end - begin)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c) for c in kept] + [decoder.decode_all(batch.column(ids))], [*kept, out])

    return map_arrow(df, run, schema)


def encode_and_decode(df: DataFrame, vocab: Vocabulary, text: str = "text", ids: str = "ids",
                      out: str = "decoded") -> DataFrame:
    """``decode(encode(df))`` in one pass: one worker a task instead of two, and no ids sent between them."""
    sent = df.sparkSession.sparkContext.broadcast(vocab)
    kept = [c for c in df.columns if c not in (ids, out)]
    schema = T.StructType([df.schema[c] for c in kept] + [
        T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(out, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = Encoder(sent.value), Decoder(sent.value.tokens)
        for whole in batches:
            for batch, texts in slices(whole, text, ENCODED_BYTES):
                lists = _id_lists(encoder, texts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c) for c in kept] + [lists, decoder.decode_all(lists)], [*kept, ids, out])
                release_memory()

    return map_arrow(df, run, schema)


def ids_digest(ids: str = "ids"):
    """Lowercase hex sha256 of the decimal ids joined by one space."""
    return F.sha2(F.concat_ws(" ", F.col(ids).cast("array<string>")), 256)
