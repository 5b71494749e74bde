"""Operator 3: repeated passages by suffix sorting.

A byte goes if a 50-byte string that covers it also starts in a document of a
smaller id. Suffixes are sorted deep-shallow: multikey quicksort on eight-byte
characters to a shallow depth, then blind tries order the groups that still
share a longer prefix, and strings that end up at one leaf are one string.

Only suffixes that can have a partner get there. Each 50-byte string is owned by
the smallest hash of a 24-byte gram in it, so equal strings have equal grams,
and of the few grams that each document selects only those selected by two
documents are kept. Texts are packed into blocks once. A block sends its grams
to range buckets, learns which are shared, sends the shared strings' contexts
(equal ones once, with the smallest id that has them), and learns the smallest
id for each string. A passage in a third of all documents thus travels once per
block, and equal whole texts are settled by their digests.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, read
from .kernels import byte_codes, mixed, powers

#: Length of the strings and of the grams that own them.
LENGTH, GRAM = 50, 24
#: Text bytes of a block, of an array round, and for each bucket.
BLOCK_BYTES, ROUND_BYTES, BUCKET_BYTES, MIN_BUCKETS = 2 << 20, 1 << 19, 64 << 20, 32
#: Bytes that multikey quicksort compares; the tries take over from there.
SHALLOW = 32
#: Strings sorted at a time.
SORT_STRINGS = 200_000
_ID_BITS = 40
SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,length:long>>"


# ---- grams ----


def owners(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The runs of consecutive LENGTH-byte strings with one owner: the owner's
    hash, the first start, the number of strings. Runs are cut at the number of
    strings that can share one gram, so that periodic texts have no long ones."""
    span = LENGTH - GRAM + 1
    hashes, firsts, counts = [], [], []
    last = len(text) - LENGTH + 1
    for at in range(0, last, ROUND_BYTES):
        n = min(ROUND_BYTES, last - at)  # strings that start here
        part = np.frombuffer(text, np.uint8, n + LENGTH - 1, at)
        bits = int(len(part)).bit_length()
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(byte_codes()[part] * powers(bits)[: len(part)], out=sums[1:])
        grams = mixed((sums[GRAM:] - sums[:-GRAM]) * powers(bits, True)[: len(part) - GRAM + 1])
        padded = np.full(-(-len(grams) // span) * span, np.iinfo(np.uint64).max, np.uint64)
        padded[: len(grams)] = grams
        rows = padded.reshape(-1, span)  # minima of sliding windows, from both ends of each row
        ahead = np.minimum.accumulate(rows, axis=1).ravel()
        back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(back[:n], ahead[span - 1 : span - 1 + n])
        change = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
        size = np.diff(np.append(change, n))
        if (size > span).any():
            more = -(-size // span)
            step = np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more)
            size = np.minimum(span, np.repeat(size, more) - step * span)
            change = np.repeat(change, more) + step * span
        hashes.append(least[change])
        firsts.append(change + at)
        counts.append(size)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(firsts), np.concatenate(counts)


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(_ID_BITS)) % np.uint64(buckets)).astype(np.int64)


# ---- blocks ----


def packed(docs: DataFrame) -> DataFrame:
    """Rows of docs (doc_id, text as binary) packed into compressed blocks.
    Their names are random: blocks are written out before they are used."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, texts, size = [], [], 0
        press = zstandard.ZstdCompressor(level=3)

        def block() -> pd.DataFrame:
            lens = np.array([len(x) for x in texts], np.int64)
            name = int.from_bytes(os.urandom(8), "little") >> 1
            return pd.DataFrame({"block": [name], "ids": [np.array(ids, np.int64).tobytes()], "lens": [lens.tobytes()], "data": [press.compress(b"".join(texts))], "size": [size]})

        for part in parts:
            for doc_id, text in zip(part["doc_id"], part["text"]):
                ids.append(doc_id)
                texts.append(text or b"")
                size += len(texts[-1])
                if size >= BLOCK_BYTES:
                    yield block()
                    ids, texts, size = [], [], 0
        if ids:
            yield block()

    return docs.mapInPandas(run, "block long, ids binary, lens binary, data binary, size long")


class Block:
    """The documents of a block, and what it can tell by itself."""

    def __init__(self, row):
        self.ids = np.frombuffer(row.ids, np.int64)
        lens = np.frombuffer(row.lens, np.int64)
        data = zstandard.ZstdDecompressor().decompress(row.data, max_output_size=int(row.size) + 1)
        ends = np.cumsum(lens).tolist()
        self.texts = [data[b - n : b] for b, n in zip(ends, lens.tolist())]
        # Equal texts: one keeper, the row of the smallest id.
        self.keeper: dict[bytes, int] = {}
        for i, x in enumerate(self.texts):
            j = self.keeper.setdefault(x, i)
            if self.ids[i] < self.ids[j]:
                self.keeper[x] = i

    def runs(self) -> None:
        """Owner hash, document, first string and count of every run."""
        found = [(i, *owners(x)) for x, i in self.keeper.items() if len(x) >= LENGTH]
        if not found:
            self.h, self.doc, self.first, self.count = np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3
            return
        self.h, self.first, self.count = (np.concatenate([x[k] for x in found]) for k in (1, 2, 3))
        self.doc = np.repeat([x[0] for x in found], [len(x[1]) for x in found])

    def digests(self) -> list[tuple[bytes, int]]:
        """Digest and keeper of each text that is long enough to go."""
        return [(hashlib.blake2b(x, digest_size=16).digest(), i) for x, i in self.keeper.items() if len(x) >= LENGTH]

    def grams(self, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct owner hashes by bucket, where each bucket begins, and for
        each run its hash's place."""
        order = np.lexsort((self.h & np.uint64((1 << _ID_BITS) - 1), bucket_of(self.h, buckets)))
        h = self.h[order]
        new = np.concatenate(([True], h[1:] != h[:-1])) if len(h) else np.zeros(0, bool)
        place = np.empty(len(h), np.int64)
        place[order] = np.cumsum(new) - 1
        distinct = h[new]
        return distinct, np.searchsorted(bucket_of(distinct, buckets), np.arange(buckets + 1)), place

    def contexts(self, buckets: int, replies: pd.DataFrame) -> tuple[dict[bytes, list[tuple[int, int]]], list[int]]:
        """The contexts of runs with shared owners, each with the (document,
        first string) of its runs, and their owners' hashes. Texts that have a
        keeper in another block are left out."""
        self.runs()
        distinct, starts, place = self.grams(buckets)
        shared = np.zeros(len(distinct), bool)
        gone = set()
        for r in replies.itertuples():
            a, b = starts[r.bucket], starts[r.bucket + 1]
            if r.shared:
                shared[a:b] = np.unpackbits(np.frombuffer(r.shared, np.uint8), count=b - a).astype(bool)
            if r.copies:
                gone |= {r.copies[k : k + 16] for k in range(0, len(r.copies), 16)}
        self.copies = {i for d, i in self.digests() if d in gone} if gone else set()
        by_place = np.lexsort((self.doc, place))  # owners of two documents in the block itself
        p, d = place[by_place], self.doc[by_place]
        shared[p[1:][(p[1:] == p[:-1]) & (d[1:] != d[:-1])]] = True
        mine = shared[place]
        if self.copies:
            mine &= ~np.isin(self.doc, list(self.copies))
        found: dict[bytes, list[tuple[int, int]]] = {}
        owner: list[int] = []
        for h, i, a, n in zip(self.h[mine].tolist(), self.doc[mine].tolist(), self.first[mine].tolist(), self.count[mine].tolist()):
            members = found.setdefault(self.texts[i][a : a + n + LENGTH - 1], [])
            if not members:
                owner.append(h)
            members.append((i, a))
        return found, owner


def send_grams(rows: Iterator[pd.DataFrame], buckets: int) -> Iterator[pd.DataFrame]:
    """bucket, block, the ids of distinct owners in it, and digests with ids of
    the texts whose digests fall into it."""
    for part in rows:
        for row in part.itertuples():
            block = Block(row)
            block.runs()
            distinct, starts, _ = block.grams(buckets)
            short = distinct.view(np.uint8).reshape(-1, 8)[:, : _ID_BITS // 8]
            texts: dict[int, list[tuple[bytes, int]]] = {}
            for digest, i in block.digests():
                texts.setdefault(int.from_bytes(digest[:4], "little") % buckets, []).append((digest, i))
            out = []
            for b in sorted({*bucket_of(distinct, buckets).tolist(), *texts}):
                grams, mine = short[starts[b] : starts[b + 1]], texts.get(b, [])
                out.append((b, row.block, grams.tobytes(), b"".join(d for d, _ in mine), block.ids[[i for _, i in mine]].tobytes() if mine else b""))
            yield pd.DataFrame(out, columns=["bucket", "block", "grams", "digests", "ids"])


def find_shared(part: pd.DataFrame) -> pd.DataFrame:
    """Which owners of a bucket two blocks have, and which texts have a keeper
    of a smaller id in another block."""
    wide = []
    for g in part["grams"]:
        ids = np.zeros((len(g) // 5, 8), np.uint8)
        ids[:, :5] = np.frombuffer(g, np.uint8).reshape(-1, 5)
        wide.append(ids.view("<u8").ravel())
    every = np.sort(np.concatenate(wide))
    twice = np.unique(every[1:][every[1:] == every[:-1]])
    least: dict[bytes, int] = {}
    listed = [([d[k : k + 16] for k in range(0, len(d), 16)], np.frombuffer(i, np.int64).tolist()) for d, i in zip(part["digests"], part["ids"])]
    for digests, ids in listed:
        for d, i in zip(digests, ids):
            least[d] = min(i, least.get(d, i))
    out = []
    for bucket, block, grams, (digests, ids) in zip(part["bucket"], part["block"], wide, listed):
        at = np.minimum(np.searchsorted(twice, grams), max(0, len(twice) - 1))
        shared = twice[at] == grams if len(twice) else np.zeros(len(grams), bool)
        copies = b"".join(d for d, i in zip(digests, ids) if least[d] < i)
        if shared.any() or copies:
            out.append((bucket, block, np.packbits(shared).tobytes() if shared.any() else b"", copies))
    return pd.DataFrame(out, columns=["bucket", "block", "shared", "copies"])


def send_contexts(blocks: pd.DataFrame, replies: pd.DataFrame, buckets: int) -> pd.DataFrame:
    """bucket, block, and of the block's contexts there: numbers, owners (32
    bits), lengths, bytes, and the smallest id that has them."""
    out = []
    press = zstandard.ZstdCompressor(level=1)
    for row in blocks.itertuples():
        block = Block(row)
        found, owner = block.contexts(buckets, replies)
        if not found:
            continue
        texts, h = list(found), np.array(owner, np.uint64)
        lens = np.array([len(x) for x in texts], np.uint8)
        least = np.array([min(block.ids[i] for i, _ in m) for m in found.values()], np.int64)
        bucket = bucket_of(h, buckets)
        order = np.argsort(bucket, kind="stable")
        filled, starts = np.unique(bucket[order], return_index=True)
        for b, mine in zip(filled.tolist(), np.split(order, starts[1:])):
            if len(mine):
                out.append((b, row.block, mine.astype(np.uint32).tobytes(), (h[mine] & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes(), lens[mine].tobytes(), press.compress(b"".join(texts[k] for k in mine)), least[mine].tobytes()))
    return pd.DataFrame(out, columns=["bucket", "block", "numbers", "owners", "lens", "data", "ids"])


# ---- deep-shallow sorting ----


def multikey(words: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows of words by their first `depth` characters (columns),
    and the group of rows that tie there. After each character only rows that
    still tie are sorted on."""
    order = np.argsort(words[:, 0], kind="stable")
    first = words[order, 0]
    group = np.cumsum(np.concatenate(([0], first[1:] != first[:-1])))
    for d in range(1, depth):
        sizes = np.bincount(group)
        open_ = np.flatnonzero(sizes[group] > 1)
        if not len(open_):
            break
        rows = order[open_]
        again = np.lexsort((words[rows, d], group[open_]))
        order[open_] = rows[again]
        key = words[order[open_], d]
        g = group[open_]
        step = np.zeros(len(group), np.int64)
        step[open_[1:]] = (g[1:] == g[:-1]) & (key[1:] != key[:-1])
        first_of = np.concatenate(([0], group[1:] != group[:-1]))
        group = np.cumsum(first_of + step)
    return order, group


def blind_trie(keys: list[int]) -> list[list[int]]:
    """The places of equal keys, in the order of the keys. Inner nodes know only
    the bit at which their two sides part; a key goes down blindly and is then
    compared with the one leaf that it reaches."""
    root: list = [keys[0], [0]]  # a leaf: key, places; an inner node: bit, zero side, one side
    for i in range(1, len(keys)):
        key, node = keys[i], root
        while len(node) == 3:
            node = node[1 + (key >> node[0] & 1)]
        differ = key ^ node[0]
        if not differ:
            node[1].append(i)
            continue
        bit, node = differ.bit_length() - 1, root
        while len(node) == 3 and node[0] > bit:
            node = node[1 + (key >> node[0] & 1)]
        old, new = node[:], [key, [i]]
        node[:] = [bit, old, new] if key >> bit & 1 else [bit, new, old]
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if len(node) == 3:
            stack += (node[2], node[1])
        else:
            out.append(node[1])
    return out


def smallest_ids(strings: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each LENGTH-byte string (a row) the smallest id of an equal one."""
    out = ids.copy()
    words = np.zeros((len(strings), -(-LENGTH // 8) * 8), np.uint8)
    words[:, :LENGTH] = strings
    order, group = multikey(words.view(">u8").astype(np.uint64), SHALLOW // 8)
    starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    ends = np.append(starts[1:], len(group))
    many = ends - starts > 1
    for a, b in zip(starts[many].tolist(), ends[many].tolist()):
        rows = order[a:b]
        tails = strings[rows, SHALLOW:].tobytes()
        width = LENGTH - SHALLOW
        for places in blind_trie([int.from_bytes(tails[k : k + width], "big") for k in range(0, len(tails), width)]):
            if len(places) > 1:
                same = rows[places]
                out[same] = ids[same].min()
    return out


def sort_bucket(part: pd.DataFrame) -> pd.DataFrame:
    """For each block the runs of its contexts' strings that a smaller id than
    its own has: context number, first string, number of strings, that id."""
    unpress = zstandard.ZstdDecompressor()
    classes: dict[bytes, int] = {}
    owner: list[int] = []
    of_entry, ids, lens = [], [], []
    for row in part.itertuples():
        n, at = np.frombuffer(row.lens, np.uint8).tolist(), 0
        data = unpress.decompress(row.data, max_output_size=sum(n) + 1)
        for size, h in zip(n, np.frombuffer(row.owners, np.uint32).tolist()):
            k = classes.setdefault(data[at : at + size], len(classes))
            if k == len(owner):
                owner.append(h)
            of_entry.append(k)
            at += size
        ids.append(np.frombuffer(row.ids, np.int64))
    of_entry, entry_ids = np.array(of_entry), np.concatenate(ids)
    texts = list(classes)
    least = np.full(len(texts), np.iinfo(np.int64).max)
    np.minimum.at(least, of_entry, entry_ids)
    count = np.array([len(x) for x in texts]) - LENGTH + 1  # strings of each class
    begin = np.cumsum(count) - count
    best = np.repeat(least, count)
    # Classes alone under their owner need no sorting; the others' strings do.
    by_owner = np.argsort(owner, kind="stable")
    sorted_owner = np.array(owner)[by_owner]
    sizes = np.bincount(np.cumsum(np.concatenate(([0], sorted_owner[1:] != sorted_owner[:-1]))))
    several = by_owner[np.repeat(sizes > 1, sizes)]
    cut = np.cumsum(np.concatenate(([0], np.array(owner)[several][1:] != np.array(owner)[several][:-1]))) if len(several) else np.zeros(0, int)
    total = np.cumsum(count[several])
    at = 0
    while at < len(several):  # whole groups of one owner at a time
        end = int(np.searchsorted(total, (total[at - 1] if at else 0) + SORT_STRINGS, "right"))
        end = min(max(end, at + 1), len(several))
        end = int(np.searchsorted(cut, cut[end - 1], "right"))
        mine = several[at:end]
        joined = np.frombuffer(b"".join(texts[k] for k in mine), np.uint8)
        n = count[mine]
        size = n + LENGTH - 1
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        start = np.repeat(np.cumsum(size) - size, n) + step
        where = np.repeat(begin[mine], n) + step
        best[where] = smallest_ids(np.lib.stride_tricks.sliding_window_view(joined, LENGTH)[start], np.repeat(least[mine], n))
        at = end
    # Back to the blocks: only what a smaller id than the block's own has.
    out, e = [], 0
    for row in part.itertuples():
        numbers = np.frombuffer(row.numbers, np.uint32)
        k = of_entry[e : e + len(numbers)]
        n = count[k]
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        value, entry = best[np.repeat(begin[k], n) + step], np.repeat(np.arange(len(k)), n)
        hit = value < np.repeat(entry_ids[e : e + len(numbers)], n)
        e += len(numbers)
        value, entry, step = value[hit], entry[hit], step[hit]
        if len(value):
            new = np.concatenate(([True], (entry[1:] != entry[:-1]) | (value[1:] != value[:-1]) | (step[1:] != step[:-1] + 1)))
            first = np.flatnonzero(new)
            size = np.diff(np.append(first, len(value)))
            out.append((row.block, numbers[entry[first]].tobytes(), step[first].astype(np.uint8).tobytes(), size.astype(np.uint8).tobytes(), value[first].tobytes()))
    return pd.DataFrame(out, columns=["block", "numbers", "firsts", "counts", "ids"])


# ---- what is left ----


def spans_of(starts: list[int], ends: list[int]) -> list[tuple[int, int]]:
    """Maximal runs (start, length) of a union of intervals."""
    if not starts:
        return []
    a, b = np.array(starts), np.array(ends)
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order])
    new = np.concatenate(([True], a[1:] > b[:-1]))
    first = np.flatnonzero(new)
    last = np.append(first[1:] - 1, len(a) - 1)
    return list(zip(a[first].tolist(), (b[last] - a[first]).tolist()))


def remove(blocks: pd.DataFrame, replies: pd.DataFrame, buckets: int) -> pd.DataFrame:
    """The result rows of a block, from all its replies."""
    out = []
    for row in blocks.itertuples():
        block = Block(row)
        shared = replies[replies["numbers"].isna()].astype({"bucket": "int64"})
        found, _ = block.contexts(buckets, shared)
        members = list(found.values())
        starts: dict[int, list[int]] = {}
        ends: dict[int, list[int]] = {}

        def mark(i: int, a: int, n: int) -> None:
            starts.setdefault(i, []).append(a)
            ends.setdefault(i, []).append(a + n + LENGTH - 1)

        ids = block.ids.tolist()
        for text, runs in found.items():
            if len(runs) > 1:
                least = min(ids[i] for i, _ in runs)
                for i, a in runs:
                    if least < ids[i]:
                        mark(i, a, len(text) - LENGTH + 1)
        for r in replies[replies["numbers"].notna()].itertuples():
            for k, j, n, least in zip(np.frombuffer(r.numbers, np.uint32).tolist(), np.frombuffer(r.firsts, np.uint8).tolist(), np.frombuffer(r.counts, np.uint8).tolist(), np.frombuffer(r.ids, np.int64).tolist()):
                for i, a in members[k]:
                    if least < ids[i]:
                        mark(i, a + j, n)
        for i, text in enumerate(block.texts):
            keeper = block.keeper[text]
            if len(text) >= LENGTH and (keeper in block.copies or ids[keeper] < ids[i]):
                spans = [(0, len(text))]
            else:
                spans = spans_of(starts.get(keeper, []), ends.get(keeper, []))
            kept, at = [], 0
            for a, n in spans:
                kept.append(text[at:a])
                at = a + n
            kept.append(text[at:])
            left = b"".join(kept)
            out.append((ids[i], len(text), len(text) - len(left), len(spans), hashlib.sha256(left).hexdigest(), [{"start": a, "length": n} for a, n in spans]))
    return pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])


def repeated_passages(docs: DataFrame) -> DataFrame:
    """What goes from each row of docs (doc_id long, text), its UTF-8 bytes.

    Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256 (of the bytes left)
    and spans (start, length). All strings are judged on the input.

    Null or empty text: no bytes. Texts under 50 bytes: nothing goes. Equal
    texts: all but those of the smallest id go whole. Null doc_id: takes no part,
    nothing goes. Rows that repeat a doc_id do not touch each other. Empty
    table: empty result. Other columns are ignored.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    blocks = materialize(packed(texts.where("doc_id IS NOT NULL")), "blocks", "none")
    total = blocks.agg(F.sum("size")).first()[0] or 0
    buckets = max(MIN_BUCKETS, total // BUCKET_BYTES)
    by_block = blocks.groupBy("block")

    grams = blocks.mapInPandas(lambda rows: send_grams(rows, buckets), "bucket int, block long, grams binary, digests binary, ids binary")
    shared = grams.groupBy("bucket").applyInPandas(find_shared, "bucket int, block long, shared binary, copies binary")
    shared = materialize(shared, "shared")
    contexts = by_block.cogroup(shared.groupBy("block")).applyInPandas(lambda b, r: send_contexts(b, r, buckets), "bucket int, block long, numbers binary, owners binary, lens binary, data binary, ids binary")
    smaller = contexts.groupBy("bucket").applyInPandas(sort_bucket, "block long, numbers binary, firsts binary, counts binary, ids binary")
    replies = shared.unionByName(smaller, allowMissingColumns=True)
    result = by_block.cogroup(replies.groupBy("block")).applyInPandas(lambda b, r: remove(b, r, buckets), SCHEMA)

    unnamed = texts.where("doc_id IS NULL")
    n = F.octet_length("text").cast("long")
    none = F.lit(0).cast("long")
    return result.union(unnamed.select("doc_id", n, none, none, F.sha2("text", 256), F.array().cast("array<struct<start:bigint,length:bigint>>")))


def op3_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(read(spark, sf_dir, "documents")).drop("spans")
