"""Sum-of-squares packing of token sequences into windows of a fixed length."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routelens.llm.bpe import MergingEncoder, encoder_of, shared
from routelens.llm.common import bound_batches

PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
          "sequence_id long, offset long")
_SCHEMA = pa.schema([(name, pa.int64()) for name in
                     (field.split()[0] for field in PIECES.split(", "))])


class Packer:
    """Places documents one by one; open windows are counted in an array of fill levels.

    A document goes where the sum of the squared counts of the levels grows least: into an
    open window of some level that it fits, or into a new one. Longer documents fill whole
    windows first, and only their rest is placed. When ``most_open`` windows are open, and at
    the end, the open ones are emptied and their pieces laid end to end, cut where a window is
    full; the last such row is cut into windows of powers of two, which need no padding.
    """

    def __init__(self, window: int, first_id: int, most_open: int = 512):
        self.window, self.next_id, self.most_open = window, first_id, most_open
        self.levels = np.zeros(window + 1, np.int64)
        self.open: dict[int, list[list[tuple]]] = {}
        self.n_open = 0
        self.out: list[tuple] = []

    def add(self, doc_id, ids: np.ndarray) -> None:
        whole = len(ids) - len(ids) % self.window
        for start in range(0, whole, self.window):
            self._close([(doc_id, start, ids[start:start + self.window], len(ids))])
        if whole < len(ids):
            self._place((doc_id, whole, ids[whole:], len(ids)))

    def _place(self, piece: tuple) -> None:
        size = len(piece[2])
        levels, window = self.levels, self.window
        # Growth of the sum of squares for the levels 0 (a new window) to window - size.
        after = 2 * levels[size:] + 1
        after[-1] = 0  # a full window is open no more
        before = 1 - 2 * levels[:window - size + 1]
        before[0] = 0
        growth = after + before
        growth[1:][levels[1:window - size + 1] == 0] = np.iinfo(np.int64).max
        level = len(growth) - 1 - int(np.argmin(growth[::-1]))  # of equal ones the fullest
        if level:
            held = self.open[level].pop()
            levels[level] -= 1
            self.n_open -= 1
        else:
            held = []
        held.append(piece)
        if level + size == window:
            self._close(held)
            return
        self.open.setdefault(level + size, []).append(held)
        levels[level + size] += 1
        self.n_open += 1
        if self.n_open >= self.most_open:
            self.flush(last=False)

    def _close(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc_id, start, ids, total in pieces:
            crc = zlib.crc32(ids.astype("<u4").tobytes())
            self.out.append((doc_id, start, len(ids), crc, total, self.next_id, offset))
            offset += len(ids)
        self.next_id += 1

    def flush(self, last: bool = True) -> None:
        """Lay the contents of the open windows end to end and cut them into full ones."""
        row = [piece for level in sorted(self.open, reverse=True)
               for held in self.open[level] for piece in held]
        self.open.clear()
        self.levels[:] = 0
        self.n_open = 0
        held, room = [], self.window
        for doc_id, start, ids, total in row:
            while len(ids) >= room:
                self._close([*held, (doc_id, start, ids[:room], total)])
                start, ids = start + room, ids[room:]
                held, room = [], self.window
            if len(ids):
                held.append((doc_id, start, ids, total))
                room -= len(ids)
        if not held:
            return
        if not last:
            self.open[self.window - room] = [held]
            self.levels[self.window - room] = 1
            self.n_open = 1
            return
        self._cut_to_powers(held)

    def _cut_to_powers(self, held: list[tuple]) -> None:
        left = sum(len(piece[2]) for piece in held)
        while left:
            room = 1 << (left.bit_length() - 1)
            left -= room
            taken, rest = [], []
            for doc_id, start, ids, total in held:
                part, tail = ids[:room], ids[room:]
                if len(part):
                    taken.append((doc_id, start, part, total))
                if len(tail):
                    rest.append((doc_id, start + len(part), tail, total))
                room -= len(part)
            self._close(taken)
            held = rest


def pack_documents(docs: DataFrame, vocabulary: str, window: int = 2048,
                   end_id: int = 1) -> DataFrame:
    """Pieces of documents in windows (see ``PIECES``): no token is lost, and none is padding.

    A document's tokens are its ids by the vocabulary file at that path, then ``end_id``; of
    a NULL or empty text, ``end_id`` alone. Each task packs the documents it reads as they
    come, so nothing is shuffled and a lost task is done again by itself. ``sequence_id`` is
    unique: the number of the task's partition in the upper 31 bits. NULL ids stay NULL, and
    repeated rows are packed each.
    """
    if window & (window - 1):
        raise ValueError("window must be a power of two")
    bound_batches(docs.sparkSession)
    content = shared(docs.sparkSession.sparkContext, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(MergingEncoder, content.value)
        packer = Packer(window, TaskContext.get().partitionId() << 32)
        tail = np.array([end_id], "<u2")
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"),
                                    strict=True):
                packer.add(doc_id, np.concatenate([encoder.ids(text.as_py()), tail]))
                if len(packer.out) >= 20_000:
                    yield _rows(packer)
        packer.flush()
        yield _rows(packer)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)


def _rows(packer: Packer) -> pa.RecordBatch:
    columns = list(zip(*packer.out, strict=True)) or [()] * len(_SCHEMA)
    packer.out = []
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=_SCHEMA)
