import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from linkloom.llm import online_packing as op


@pytest.fixture(scope="module")
def reference():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def slow_place(levels, n, capacity):
    """The level with the least sum of squares over padded levels, the fullest of
    several, from counts alone."""
    padded = [h for h in range(1, capacity) if h & (h - 1)]
    best = None
    for h in [0, *[h for h in range(1, capacity) if levels[h]]]:
        if h + n <= capacity:
            after = dict(levels)
            after[h] = after.get(h, 0) - (h > 0)
            after[h + n] = after.get(h + n, 0) + 1
            cost = sum(after.get(x, 0) ** 2 for x in padded)
            if best is None or (cost, -h) < best[0]:
                best = (cost, -h), h
    return best[1]


@pytest.mark.parametrize("seed", range(6))
def test_each_placement_is_the_least(seed):
    r, capacity = random.Random(seed), 32
    levels, counts = op.Levels(capacity), defaultdict(int)
    for i in range(400):
        n = r.choice([r.randint(1, capacity - 1), r.randint(1, 7)])
        h = slow_place(counts, n, capacity)
        full = levels.place((i, 0, np.zeros(n, "<u4")))
        counts[h] -= h > 0
        assert (full is not None) == (h + n == capacity)
        counts[h + n] += h + n < capacity
        assert {x: len(w) for x, w in enumerate(levels.open) if w} == {x: c for x, c in counts.items() if c and x}


def check_windows(windows, docs, capacity):
    """Every id in one piece, every window full or a power of two."""
    seen = defaultdict(list)
    for w in windows:
        n = sum(len(ids) for _, _, ids in w)
        assert 0 < n <= capacity and n & (n - 1) == 0
        for doc, start, ids in w:
            assert len(ids)
            seen[doc].append((start, ids.tolist()))
    assert {k: [x for _, part in sorted(v) for x in part] for k, v in seen.items()} == {k: ids.tolist() for k, ids in docs}
    assert all(s == sum(len(p) for _, p in sorted(v)[:i]) for v in seen.values() for i, (s, _) in enumerate(sorted(v)))


@pytest.mark.parametrize("seed", range(20))
def test_windows(seed):
    r, capacity = random.Random(seed), 64
    docs = [(i, np.arange(r.choice([1, 5, 33, r.randint(1, 63), r.randint(1, 500)]), dtype="<u4")) for i in range(r.choice([0, 1, 2, 3, 200]))]
    check_windows(op.pack(docs, capacity), docs, capacity)


def test_few_documents_are_cut():
    r = random.Random(1)
    docs = [(i, np.zeros(int(min(1023, r.lognormvariate(5, 1) + 1)), "<u4")) for i in range(20_000)]
    windows = list(op.pack(docs, 1024))
    total = sum(len(ids) for _, ids in docs)
    assert sum(len(w) for w in windows) < 1.05 * len(docs)
    assert len(windows) < 1.05 * -(-total // 1024)


def check(got, docs, reference, sequence=1024):
    """Rows against ids of the reference tokenizer; docs by distinct doc_id."""
    texts, place, of = dict(docs), defaultdict(list), defaultdict(list)
    for x in got:
        of[x.doc_id].append(x)
        place[x.sequence_id].append((x.offset, x.length))
    assert set(of) == set(texts)
    for i, pieces in of.items():
        ids = [*reference.encode(texts[i] or "", add_special_tokens=False).ids, 0]
        at = 0
        for x in sorted(pieces, key=lambda x: x.start):
            assert x.start == at and x.doc_tokens == len(ids)
            assert x.ids_crc32 == zlib.crc32(np.array(ids[at : at + x.length], "<u4").tobytes())
            at += x.length
        assert at == len(ids)
    padding = 0
    for x in place.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at and length > 0
            at += length
        assert at <= sequence
        padding += 0 if at & (at - 1) == 0 else sequence - at
    return padding


def test_table(spark, sf, reference):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert check(op.op11_sum_of_squares_packing(spark, sf).collect(), docs, reference) == 0


def test_edges(spark, make, reference):
    docs = [(1, None), (2, ""), (3, "a b <|endoftext|> c"), (None, "no id"), (5, "very long " * 30_000), (6, "\x00 é 𝄞")]
    got = op.pack_online(make([(i, t, "s") for i, t in docs]).repartition(2)).collect()
    assert check(got, docs, reference) == 0
    again = op.pack_online(make([(7, "same", "s")] * 3 + [(None, "x", None)] * 2)).collect()
    assert sorted((str(x.doc_id), x.doc_tokens) for x in again if x.start == 0)[:3] == [("7", 2)] * 3
    assert sum(x.length for x in again) == 10
    assert op.pack_online(make([])).count() == 0
    assert op.pack_online(make([])).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    small = op.pack_online(make([(i, t, "s") for i, t in docs]), sequence=8).collect()
    assert check(small, docs, reference, 8) == 0
    with pytest.raises(ValueError):
        op.pack_online(make([]), sequence=1000)


def test_other_kinds_of_ids(spark):
    df = spark.createDataFrame([("x", "one two"), (None, "three")], "doc_id string, text string")
    assert {x.doc_id for x in op.pack_online(df).collect()} == {"x", None}
