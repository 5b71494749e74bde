"""Operator 11: sum-of-squares online packing.

Documents are packed as they are read: each task keeps the number of open
windows at every fill level, in one array, and puts a document where the sum of
the squares of these numbers becomes least. Levels whose windows are not padded
(powers of two) do not count. What is longer than a window fills whole windows
first. Windows still open in the end are closed by cutting: the emptiest fill the
fullest, and the last is cut into powers of two, so that nothing is padded.

There is no shuffle: a task's state is its open windows with their ids.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import read
from .tokens import encoder

SEQUENCE = 1024

#: A piece of a document: what names the document, its first id's place, its ids.
Piece = tuple[object, int, np.ndarray]


class Levels:
    """Numbers of open windows by fill level, and where to put a piece.

    Putting n ids into a window at level h moves it to h + n, which changes the
    sum of squares by (2 N[h+n] + 1) - (2 N[h] - 1); levels that are not padded
    (0, powers of two, full) add nothing."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.open: list[list[list[Piece]]] = [[] for _ in range(capacity)]
        self.padded = np.array([h & (h - 1) > 0 and h < capacity for h in range(capacity + 1)])
        # In units of 1 / scale; the rest of `leave` breaks ties: fullest first.
        self.scale = 2 * capacity
        self.enter = np.where(self.padded, self.scale, 0).astype(np.int64)
        self.leave = np.full(capacity + 1, 1 << 60, np.int64)
        self.leave[0] = 0

    def _count(self, level: int) -> None:
        n = len(self.open[level])
        if self.padded[level]:
            self.enter[level] = (2 * n + 1) * self.scale
        if level:
            self.leave[level] = (-(2 * n - 1) * self.scale if self.padded[level] else 0) - level if n else 1 << 60

    def place(self, piece: Piece) -> list[Piece] | None:
        """Put the piece into a window; the window, if it is full now."""
        n = len(piece[2])
        level = int(np.argmin(self.enter[n:] + self.leave[: self.capacity + 1 - n]))
        window = self.open[level].pop() if level else []
        window.append(piece)
        if level:
            self._count(level)
        if level + n == self.capacity:
            return window
        self.open[level + n].append(window)
        self._count(level + n)
        return None

    def close(self) -> Iterator[list[Piece]]:
        """The windows still open. Those that would be padded are filled up, the
        fullest first, with the pieces of the emptiest, cut where they must be;
        what one window cannot hold whole in the end goes into powers of two."""
        rest = [w for h in range(self.capacity - 1, 0, -1) if self.padded[h] for w in self.open[h]]
        yield from (w for h in range(1, self.capacity) if not self.padded[h] for w in self.open[h])
        first, last, spare = 0, len(rest) - 1, []
        while first <= last:
            window, first = rest[first], first + 1
            gap = self.capacity - sum(len(ids) for _, _, ids in window)
            while gap and (spare or first <= last):
                if not spare:
                    spare, last = rest[last], last - 1
                doc, start, ids = spare.pop()
                window.append((doc, start, ids[:gap]))
                if len(ids) > gap:
                    spare.append((doc, start + gap, ids[gap:]))
                gap -= len(window[-1][2])
            if gap:
                yield from in_powers(window)
            else:
                yield window
        if spare:
            yield from in_powers(spare)


def in_powers(window: list[Piece]) -> Iterator[list[Piece]]:
    """The pieces of a window cut into windows whose sizes are powers of two."""
    left, window = sum(len(ids) for _, _, ids in window), window[::-1]
    while left:
        room = 1 << (left.bit_length() - 1)
        left, part = left - room, []
        while room:
            doc, start, ids = window.pop()
            part.append((doc, start, ids[:room]))
            if len(ids) > room:
                window.append((doc, start + room, ids[room:]))
            room -= len(part[-1][2])
        yield part


def pack(documents: Iterable[tuple[object, np.ndarray]], capacity: int = SEQUENCE) -> Iterator[list[Piece]]:
    """Windows of documents (name, ids), as they fill up and then the rest."""
    levels = Levels(capacity)
    for doc, ids in documents:
        whole = len(ids) - len(ids) % capacity
        for start in range(0, whole, capacity):
            yield [(doc, start, ids[start : start + capacity])]
        if whole < len(ids):
            full = levels.place((doc, whole, ids[whole:]))
            if full:
                yield full
    yield from levels.close()


def pack_online(docs: DataFrame, vocabulary: str = "byte_bpe_50k", sequence: int = SEQUENCE) -> DataFrame:
    """Pack every row of docs (doc_id, text) into sequences of token ids. sequence
    is a power of two.

    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, a
    row for each piece. Each input partition is packed by itself, in one pass.
    Sequences are full or have a power of two of ids.

    Null or empty text: the end id alone. Null and repeated doc_id: each row is
    packed as a document of its own. Very long texts: whole windows and one rest.
    Empty table: empty result. Other columns are ignored.
    """
    if sequence < 2 or sequence & (sequence - 1):
        raise ValueError("sequence must be a power of two")
    fields = docs.select("doc_id").schema.simpleString()[len("struct<") : -1].replace(":", " ", 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode_to_numpy
        kinds: list[pa.DataType] = []

        def documents() -> Iterator[tuple[object, np.ndarray]]:
            for batch in batches:
                kinds[:] = [batch.schema.field("doc_id").type]
                names = batch.column("doc_id").to_pylist()
                for name, text in zip(names, batch.column("text")):
                    ids = np.append(encode(text.as_py() or "", allowed_special="all"), 0).astype("<u4")
                    yield (name, len(ids)), ids

        def rows(found: list[tuple]) -> pa.RecordBatch:
            columns = [pa.array(x, t) for x, t in zip(zip(*found), [*kinds, *[pa.int64()] * 6])]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        found: list[tuple] = []
        number = TaskContext.get().partitionId() << 33
        for number, window in enumerate(pack(documents(), sequence), number):
            offset = 0
            for (name, n), start, ids in window:
                found.append((name, start, len(ids), zlib.crc32(ids.tobytes()), n, number, offset))
                offset += len(ids)
            if len(found) >= 10_000:
                yield rows(found)
                found = []
        if found:
            yield rows(found)

    return docs.select("doc_id", "text").mapInArrow(run, f"{fields}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op11_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_online(read(spark, sf_dir, "documents"))
