"""Bounded-space online packing of token sequences into windows of fixed size.

1. Every partition packs its documents as they come (one narrow pass, no shuffle).  ``OPEN`` windows are open at a
   time.  A document's full windows leave at once; its rest goes to the open window that it fills best.  When none
   has room the fullest is topped up with the rest's head and emitted, and the tail is placed anew: documents
   may be cut, so an emitted window has no padding.
2. What stays open, at most ``OPEN`` windows a partition, is merged in rounds: the leftovers of ``FAN_IN`` partitions are
   one group and go through the same packer, which leaves one open window.  A group is bounded, and each
   round leaves a ``FAN_IN``-th of the groups; hot keys play no part, as nothing is dealt by content.
3. The last open window is cut at powers of two, which need no padding either.

The pieces of a window are stored with their ids, so a lost executor costs its own tasks.  Window numbers come from
the partition, the round and a counter.  Defined results: a null or empty text has the end token alone; a null id is carried;
repeated rows are documents of their own; a table without rows has no piece; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import slices
from .common import map_arrow, stored
from .transducer import WordBpe
from .word_ids import WordIds

WINDOW = 2048
OPEN = 64
FAN_IN = 16
ROUND, GROUP = 1 << 56, 1 << 32  # steps of window numbers by round and by partition or group
FLUSH_IDS = 1 << 20  # ids held back before a batch leaves the task

SCHEMA = pa.schema([("doc", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
                    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("open", pa.int32())])
DDL = ("doc long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, open int")


class Piece:
    """Consecutive ids of a document."""

    __slots__ = ("doc", "start", "ids", "doc_tokens")

    def __init__(self, doc: int | None, start: int, ids: np.ndarray, doc_tokens: int):
        self.doc, self.start, self.ids, self.doc_tokens = doc, start, ids, doc_tokens

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return (Piece(self.doc, self.start, self.ids[:n], self.doc_tokens),
                Piece(self.doc, self.start + n, self.ids[n:], self.doc_tokens))


class Packer:
    """A fixed number of open windows; windows that leave it are full."""

    def __init__(self, first_number: int, window: int = WINDOW, n_open: int = OPEN):
        self.window, self.n_open, self.next = window, n_open, first_number
        self.open: list[list[Piece]] = []
        self.filled: list[int] = []
        self.columns: dict[str, list] = {f.name: [] for f in SCHEMA}
        self.held = 0

    def emit(self, pieces: list[Piece], still_open: int | None = None) -> None:
        offset = 0
        for p in pieces:
            row = (p.doc, p.start, len(p.ids), p.ids.astype("<u4").tobytes(), p.doc_tokens, self.next, offset, still_open)
            for name, value in zip(self.columns, row, strict=True):
                self.columns[name].append(value)
            offset += len(p.ids)
        self.held += offset
        self.next += 1

    def put(self, piece: Piece) -> None:
        while len(piece.ids) >= self.window:
            full, piece = piece.cut(self.window)
            self.emit([full])
        while len(piece.ids):
            # best fit: the least room that is enough
            best, least = -1, self.window + 1
            for i, n in enumerate(self.filled):
                room = self.window - n
                if len(piece.ids) <= room < least:
                    best, least = i, room
            if best < 0 and len(self.open) < self.n_open:
                self.open.append([piece])
                self.filled.append(len(piece.ids))
                return
            if best >= 0:
                self.open[best].append(piece)
                self.filled[best] += len(piece.ids)
                if self.filled[best] == self.window:
                    self._close(best)
                return
            fullest = max(range(len(self.filled)), key=self.filled.__getitem__)
            head, piece = piece.cut(self.window - self.filled[fullest])
            self.open[fullest].append(head)
            self._close(fullest)

    def _close(self, i: int) -> None:
        self.emit(self.open.pop(i))
        del self.filled[i]

    def join_open(self) -> None:
        """Merges the open windows until one is left."""
        pieces = [p for _, window in sorted(zip(self.filled, self.open, strict=True), key=lambda w: -w[0]) for p in window]
        self.open, self.filled, self.n_open = [], [], 1
        for p in pieces:
            self.put(p)

    def leave(self) -> None:
        """Emits the open windows as leftovers."""
        for i, window in enumerate(self.open):
            self.emit(window, i)
        self.open, self.filled = [], []

    def cut_at_powers(self) -> None:
        """Emits the ids of the last open window in windows whose sizes are powers of two."""
        self.join_open()
        pieces = [p for window in self.open for p in window]
        self.open, self.filled = [], []
        left = sum(len(p.ids) for p in pieces)
        while left:
            size = 1 << (left.bit_length() - 1)
            left -= size
            window = []
            while size:
                p = pieces.pop(0)
                if len(p.ids) > size:
                    p, rest = p.cut(size)
                    pieces.insert(0, rest)
                window.append(p)
                size -= len(p.ids)
            self.emit(window)

    def batch(self) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(self.columns[f.name], f.type) for f in SCHEMA], schema=SCHEMA)
        self.columns, self.held = {f.name: [] for f in SCHEMA}, 0
        return out


_ENCODERS: dict[str, WordIds] = {}


def _encoder(spec: str, bpe: WordBpe) -> WordIds:
    """The worker's encoder: its table of words serves all tasks of a tokenizer."""
    if bpe.name not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[bpe.name] = WordIds(spec, bpe)
    return _ENCODERS[bpe.name]


def _packed(docs: DataFrame, spec: str, bpe: WordBpe, end_id: int, window: int, n_open: int) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast((spec, bpe))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(*sent.value)
        packer = Packer(TaskContext.get().partitionId() * GROUP, window, n_open)
        end = np.array([end_id], dtype=np.uint32)
        for whole in batches:
            for part, texts in slices(whole, "text"):
                for doc, ids in zip(part.column("doc").to_pylist(), encoder.encode_all(texts), strict=True):
                    packer.put(Piece(doc, 0, np.append(ids, end), len(ids) + 1))
                    if packer.held > FLUSH_IDS:
                        yield packer.batch()
        packer.leave()
        yield packer.batch()

    return map_arrow(docs, run, DDL)


def _left_by() -> Column:
    """The partition or group that a window left, as its number tells."""
    return F.shiftright("sequence_id", 32).bitwiseAND(ROUND // GROUP - 1)


def _merged(leftovers: DataFrame, number: int, last: bool, window: int, n_open: int) -> DataFrame:
    """The leftovers of ``FAN_IN`` groups in one packer each."""
    def run(group: pa.Table) -> pa.Table:
        rows = group.sort_by([("sequence_id", "ascending"), ("offset", "ascending")])
        packer = Packer(number * ROUND + rows.column("group")[0].as_py() * GROUP, window, n_open)
        names = ["doc", "start", "ids", "doc_tokens"]
        for doc, start, ids, tokens in zip(*(rows.column(c).to_pylist() for c in names), strict=True):
            packer.put(Piece(doc, start, np.frombuffer(ids, dtype="<u4"), tokens))
        if last:
            packer.cut_at_powers()
        else:
            packer.join_open()
            packer.leave()
        return pa.Table.from_batches([packer.batch()])

    return leftovers.withColumn("group", F.floor(_left_by() / FAN_IN)).groupBy("group").applyInArrow(run, DDL)


def pack(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text: str = "text", window: int = WINDOW,
         n_open: int = OPEN) -> DataFrame:
    """(id, start, length, ids, doc_tokens, sequence_id, offset): a row per piece of a document.

    ``tokenizer``: path of a tokenizer file of BPE with word ends.  ``ids``: the piece's token ids, little-endian 32 bits
    each; every document ends with ``end_id``.
    """
    with open(tokenizer, encoding="utf-8") as f:
        spec = f.read()
    src = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text).alias("text"))
    pieces = stored(_packed(src, spec, WordBpe.read(tokenizer), end_id, window, n_open), "packed")
    done = [pieces.where("open is null")]
    number = 0
    while True:
        leftovers = pieces.where("open is not null")
        highest = leftovers.agg(F.max(_left_by())).first()[0]
        if highest is None:
            break
        number += 1
        pieces = stored(_merged(leftovers, number, highest < FAN_IN, window, n_open), "merged")
        done.append(pieces.where("open is null"))
    out = done[0]
    for df in done[1:]:
        out = out.unionByName(df)
    return out.drop("open").withColumnRenamed("doc", id_col)
