import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from linkloom.llm import packing
from linkloom.llm.tokens import encoder, ids_of


@pytest.fixture(scope="module")
def reference():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def check(got, docs, reference, sequence=2048):
    want = defaultdict(int)
    for i, t in docs:
        want[i] += len(reference.encode(t or "", add_special_tokens=False).ids) + 1
    bins, n = defaultdict(list), defaultdict(int)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
        n[r.doc_id] += r.length
        assert 0 < r.length <= sequence
    assert n == want
    for x in bins.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= sequence
    return len(bins)


def test_table(spark, sf, reference):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = packing.op6_pack_sequences(spark, sf).collect()
    used = check(got, [(r.doc_id, r.text) for r in docs], reference)
    assert used <= -(-sum(r.length for r in got) // 2048) + 1
    texts = {r.doc_id: r.text for r in docs}
    for r in got:
        ids = [*reference.encode(texts[r.doc_id], add_special_tokens=False).ids, 0]
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
        if len(ids) <= 2048:
            assert r.piece == 0 and r.start == 0
        elif r.piece:
            assert r.length == 2048


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80))
def test_same_ids_as_tokenizers(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    global _T
    try:
        t = _T
    except NameError:
        t = _T = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert ids_of("byte_bpe_50k", text) == t.encode(text, add_special_tokens=False).ids


def test_odd_texts(reference):
    for text in ("<|endoftext|> a<|endoftext|>", "   \t\n\r x", "a" * 5000, "\u0085᠎﻿ 1١²", "\x00\x1c\x1d ", "it's I'LL 'sx", "\U0001f600" * 50):
        assert ids_of("byte_bpe_50k", text) == reference.encode(text, add_special_tokens=False).ids
    assert encoder("byte_bpe_50k") is encoder("byte_bpe_50k")


def test_edges(spark, make, reference):
    docs = [(1, None), (2, ""), (None, "a b"), (3, "w " * 5000), (3, "w " * 5000), (4, "x")]
    got = packing.pack_documents(make([(i, t, "s") for i, t in docs])).collect()
    check(got, docs, reference)
    assert packing.pack_documents(make([])).count() == 0


def test_groups(spark, make, reference):
    docs = [(i, "word " * (i * 37 % 900)) for i in range(120)]
    got = packing.pack_documents(make([(i, t, "s") for i, t in docs]), group_pieces=30).collect()
    used = check(got, docs, reference)
    assert used <= -(-sum(r.length for r in got) // 2048) + 4


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_small_instances_are_optimal(lengths):
    def fits(rest, bins):
        if not rest:
            return True
        for b in range(len(bins)):
            if bins[b] >= rest[0] and bins[b] not in bins[:b]:
                if fits(rest[1:], [*bins[:b], bins[b] - rest[0], *bins[b + 1 :]]):
                    return True
        return False

    least = next(n for n in range(1, 10) if fits(sorted(lengths, reverse=True), [20] * n))
    where, offset = packing.pack(np.array(lengths), 20, None)
    assert len(set(where.tolist())) == least
    assert packing.lower_bound(np.bincount(lengths, minlength=21), 20) <= least


def test_search_beats_best_fit():
    lengths = [9, 6, 5, 4, 4, 3, 3, 3, 2]  # best fit needs one bin more
    assert len(packing.best_fit(sorted(lengths, reverse=True), 10)) > 4
    assert len(set(packing.pack(np.array(lengths), 10)[0].tolist())) == 4


def test_dominance():
    assert packing._dominated((3, 2), (5,)) and not packing._dominated((5,), (3, 2))


def test_pieces():
    assert packing.pieces_of([1] * 2048) == [(0, 2048)]
    assert packing.pieces_of([1] * 4096) == [(0, 2048), (2048, 2048)]
    assert packing.pieces_of([1] * 2050) == [(0, 2), (2, 2048)]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 12), min_size=1, max_size=8), st.integers(1, 5))
def test_fillings_are_the_undominated_ones(lengths, first):
    """Against all subsets: whatever is not yielded fits into what is."""
    capacity, largest = 16, max(lengths)
    counts = np.bincount(lengths, minlength=capacity + 1)
    rest = sorted(lengths)
    rest.remove(largest)
    every = {()}
    for n in rest:
        every |= {tuple(sorted((*f, n), reverse=True)) for f in every if sum(f) + n <= capacity - largest}
    for steps in (None, first):
        got = list(packing.fillings(sorted(set(lengths)), counts, largest, capacity, capacity, packing.Work(None), steps))
        assert len(got) == len(set(got)) and set(got) <= every
        assert all(any(packing._dominated(f, g) for g in got) for f in every)


def test_one_size_and_tiny_pieces():
    where, _ = packing.pack(np.ones(5000, np.int64), 2048)
    assert len(set(where.tolist())) == 3
    mixed = np.array([1] * 3000 + [1500] * 9 + [547] * 9)
    assert len(set(packing.pack(mixed)[0].tolist())) == -(-int(mixed.sum()) // 2048)


def test_work_is_the_limit():
    r = np.random.default_rng(3)
    lengths = r.integers(600, 800, 3000)
    few = len(set(packing.pack(lengths, 2048, 0)[0].tolist()))
    assert few == len(packing.best_fit(sorted(lengths.tolist(), reverse=True), 2048)) >= len(set(packing.pack(lengths)[0].tolist()))
