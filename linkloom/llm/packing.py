"""Operator 6: pack documents into sequences by bin completion.

Documents are tokenised where they are read; only (id, piece, length) rows are
shuffled, into groups of a bounded number of pieces, and each group is packed by
branch and bound: best-fit decreasing is the incumbent, and a search for fewer
bins goes through undominated fillings around the largest piece left until it
succeeds, has tried them all, or has used up its work, which is the only limit.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from itertools import chain
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, read
from .tokens import ids_of

SEQUENCE = 2048
#: Pieces that are packed together, and the steps of search for each of them;
#: without a limit (None) a group's packing is optimal.
GROUP_PIECES, STEPS_PER_PIECE = 20_000, 50
#: Of the first FIRST_STEPS partial fillings, the best are tried before others.
FIRST_STEPS, FIRST_WAYS = 300, 6
#: Groups are dealt to so many tasks at most.
MAX_TASKS = 8192


def pieces_of(ids: list[int], sequence: int = SEQUENCE) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document with its end id; only longer
    documents are cut, and the first piece takes what the whole ones leave."""
    n = len(ids)
    first = n if n <= sequence else n % sequence
    cuts = [0] if first else []
    cuts += range(first, n, sequence)
    return [(a, b - a) for a, b in zip(cuts, [*cuts[1:], n])]


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing over lengths in descending order: bins of lengths."""
    bins: list[list[int]] = []
    by_room: dict[int, list[int]] = {}
    rooms = 0  # bit r: some bin has room for exactly r
    for n in lengths:
        fits = rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(n)
        if room > n:
            by_room.setdefault(room - n, []).append(b)
            rooms |= 1 << (room - n)
    return bins


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs: the volume bound, and Martello and Toth's
    bound over thresholds of the small lengths."""
    sizes = np.arange(len(counts))
    total = int((counts * sizes).sum())
    best, n, volume = -(-total // capacity), np.cumsum(counts), np.cumsum(counts * sizes)
    half = capacity // 2
    for k in range(0, half + 1):
        large = int(n[capacity] - n[capacity - k])
        middle = int(n[capacity - k] - n[half])
        room = middle * capacity - int(volume[capacity - k] - volume[half])
        small = int(volume[half] - (volume[k - 1] if k else 0))
        best = max(best, large + middle + max(0, -(-(small - room) // capacity)))
    return best


def _dominated(f: tuple[int, ...], g: tuple[int, ...]) -> bool:
    """Whether the lengths of f fit into those of g (first fit, descending)."""
    rooms = list(g)
    for n in f:
        for i, r in enumerate(rooms):
            if n <= r:
                rooms[i] -= n
                break
        else:
            return False
    return True


class Work:
    """Steps of search that are left; None is no limit."""

    def __init__(self, steps: int | None):
        self.left, self.limited = steps, steps is not None

    def step(self) -> None:
        if self.limited:
            self.left -= 1
            if self.left < 0:
                raise TimeoutError


def maximal(sizes: list[int], counts: np.ndarray, largest: int, room: int, slack: int, work: Work) -> Iterator[tuple[int, tuple[int, ...]] | None]:
    """All ways to fill `room` beside one piece of the size `largest` so that no
    piece left over fits as well, with a waste of `slack` at most: (waste, sizes
    down). None for each step without a result."""

    def grow(room: int, top: int, gap: int, chosen: tuple[int, ...]) -> Iterator:
        # gap: a left-over size that must not fit in the end
        ended = True
        for i in range(min(top, bisect_right(sizes, room) - 1), -1, -1):
            work.step()
            n = sizes[i]
            held = int(counts[n]) - (n == largest)
            if held <= 0:
                continue
            ended = False
            most = min(held, room // n)
            for k in range(most, 0, -1):
                yield None
                yield from grow(room - k * n, i - 1, gap if k == held else min(gap, n), (*chosen, *(n,) * k))
            gap = min(gap, n)  # not taken: what is left in the end must be less
        if ended and room < gap and room <= slack:
            yield room, chosen

    return grow(room, len(sizes) - 1, room + largest + 1, ())


def fillings(sizes: list[int], counts: np.ndarray, largest: int, capacity: int, slack: int, work: Work, steps: int | None = FIRST_STEPS, ways: int = FIRST_WAYS) -> Iterator[tuple[int, ...]]:
    """Undominated fillings of a bin around its largest piece, every one of them
    in the end: first those of least waste that the first `steps` steps find,
    then the rest as the search meets them."""
    stream = maximal(sizes, counts, largest, capacity - largest, slack, work)
    early, taken, done = [], 0, True
    for found in stream:
        if found is None:
            taken += 1
            if steps is not None and taken >= steps:
                done = False
                break
        else:
            early.append(found)
            if found[0] == 0 and steps is not None and len(early) >= ways:
                done = False
                break
    early.sort(key=lambda x: (x[0], len(x[1]), [-n for n in x[1]]))
    rest = () if done else (x for x in stream if x is not None)
    given: list[tuple[int, ...]] = []
    for _, f in chain(early, rest):
        for g in given:
            work.step()
            if _dominated(f, g):
                break
        else:
            given.append(f)
            yield f


def complete(lengths: list[int], capacity: int, bins: int, work: Work, steps: int | None = FIRST_STEPS) -> list[list[int]] | None:
    """A packing of descending lengths into `bins` bins or fewer, or None if
    there is none; TimeoutError if the work does not last. Depth-first bin
    completion: around the longest length left, take each undominated filling in
    turn, at first as often as it can repeat, then less often, and go back once
    the waste exceeds what so many bins can waste."""
    counts = np.zeros(capacity + 1, np.int64)
    np.add.at(counts, lengths, 1)
    sizes = sorted(set(lengths))
    slack = bins * capacity - sum(lengths)
    if slack < 0:
        return None
    path: list[list] = []  # [fillings not yet tried, largest, filling taken, its counts, times, waste each]
    largest, forward = len(sizes) - 1, True

    def put(step: list, times: int) -> None:
        nonlocal slack
        for n, k in step[3].items():
            counts[n] -= times * k
        slack -= times * step[5]
        step[4] += times

    while True:
        if forward:
            while largest >= 0 and counts[sizes[largest]] == 0:
                largest -= 1
            if largest < 0:
                return [[sizes[at], *f] for _, at, f, _, times, _ in path for _ in range(times)]
            path.append([fillings(sizes, counts, sizes[largest], capacity, slack, work, steps), largest, None, {}, 0, 0])
        while path:
            work.step()
            step = path[-1]
            if step[4] > 1:  # the same filling once less; the largest left stays the same
                put(step, -1)
                largest, forward = step[1], True
                break
            if step[4] == 1:
                put(step, -1)
            f = next(step[0], None)
            if f is None:
                path.pop()
                continue
            need: dict[int, int] = {}
            for n in (sizes[step[1]], *f):
                need[n] = need.get(n, 0) + 1
            waste = capacity - sizes[step[1]] - sum(f)
            times = min(int(counts[n]) // k for n, k in need.items())
            times = min(times, slack // waste) if waste else times
            step[2:] = [f, need, 0, waste]
            if times > 0:
                put(step, times)
                largest, forward = step[1], True
                break
        else:
            return None


def pack(lengths: np.ndarray, capacity: int = SEQUENCE, steps: int | None = -1, first_steps: int | None = FIRST_STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length, in as few bins as the search finds within
    so many steps (-1: STEPS_PER_PIECE for each; None: to its end, which makes
    the packing optimal)."""
    order = np.argsort(-lengths, kind="stable")
    ordered = [int(x) for x in lengths[order]]
    counts = np.bincount(lengths, minlength=capacity + 1)
    bins = best_fit(ordered, capacity)
    work = Work(STEPS_PER_PIECE * len(ordered) + 100_000 if steps == -1 else steps)
    try:
        for goal in range(lower_bound(counts, capacity), len(bins)):
            better = complete(ordered, capacity, goal, work, first_steps)
            if better is not None:
                bins = better
                break
    except TimeoutError:  # the incumbent stays
        pass
    at: dict[int, list[int]] = {}
    for i in order[::-1]:
        at.setdefault(int(lengths[i]), []).append(int(i))
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for b, content in enumerate(bins):
        start = 0
        for n in content:
            i = at[n].pop()
            where[i], offset[i] = b, start
            start += n
    return where, offset


def tokenized(docs: DataFrame, vocabulary: str, sequence: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of docs."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for doc_id, text in zip(part["doc_id"], part["text"]):
                ids = [*ids_of(vocabulary, text), 0]
                raw = np.array(ids, "<u4").tobytes()
                rows += [(doc_id, p, start, n, zlib.crc32(raw[4 * start : 4 * (start + n)])) for p, (start, n) in enumerate(pieces_of(ids, sequence))]
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            yield out.astype({"doc_id": part["doc_id"].dtype}) if len(out) else out

    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def pack_documents(docs: DataFrame, vocabulary: str = "byte_bpe_50k", sequence: int = SEQUENCE, group_pieces: int = GROUP_PIECES, steps: int | None = -1) -> DataFrame:
    """Pack every row of docs (doc_id, text) into sequences of token ids.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset, a row
    for each piece. Groups are dealt round robin over the written pieces, so
    they are of one size whatever the ids. steps: of search in each group, see
    pack().

    Null or empty text: the end id alone. Null and repeated doc_id: each row is
    packed as a document of its own. Empty table: empty result. Other columns
    are ignored.
    """
    pieces = materialize(tokenized(docs, vocabulary, sequence), "pieces")
    groups = max(1, -(-pieces.count() // group_pieces))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["doc_id", "piece", "ids_crc32"], ignore_index=True)
        where, offset = pack(part["length"].to_numpy(np.int64), sequence, steps)
        return part.assign(sequence_id=where + (part["group"].iat[0] << 32), offset=offset).drop(columns="group")

    row = F.monotonically_increasing_id()  # the file's number above, the row's below
    dealt = pieces.withColumn("group", F.pmod(row + F.shiftright(row, 33) * 7919, F.lit(groups)).cast("long"))
    return dealt.repartitionByRange(min(groups, MAX_TASKS), "group").groupBy("group").applyInPandas(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op6_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"))
