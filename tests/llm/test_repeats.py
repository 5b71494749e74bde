import hashlib
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from linkloom.llm import repeats


def brute(docs, n=50):
    first = {}
    texts = [(i, (t or "").encode()) for i, t in docs]
    for i, x in sorted((d for d in texts if d[0] is not None), key=lambda d: d[0]):
        for p in range(len(x) - n + 1):
            first.setdefault(x[p : p + n], i)
    out = []
    for i, x in texts:
        gone = bytearray(len(x))
        if i is not None:
            for p in range(len(x) - n + 1):
                if first[x[p : p + n]] < i:
                    gone[p : p + n] = b"\1" * n
        kept = bytes(c for c, g in zip(x, gone) if not g)
        spans = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(x), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def run(make, docs):
    got = repeats.repeated_passages(make([(i, t, "s") for i, t in docs]))
    rows = got.collect()
    for r in rows:
        assert sum(s.length for s in r.spans) == r.n_removed and len(r.spans) == r.n_spans
    return sorted((tuple(r)[:5] for r in rows), key=repr)


def test_table(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted((tuple(r) for r in repeats.op3_suffix_repeats(spark, sf).collect()), key=repr)
    assert got == brute(docs)


def test_planted(spark, make):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdé") for _ in range(r.randint(1, 8)))
    passages = [" ".join(word() for _ in range(r.randint(8, 60))) for _ in range(6)]
    docs = []
    for i in range(80):
        parts = [" ".join(word() for _ in range(r.randint(0, 30))) for _ in range(3)]
        parts.insert(1, r.choice(passages)[: r.randint(20, 400)])
        docs.append((i, " ".join(parts)))
    docs += [(200, "ab" * 400), (201, "ab" * 300), (202, "b" + "ab" * 100), (203, "a" * 3000), (204, "a" * 60), (205, "a" * 49)]
    docs += [(5, passages[0] * 2), (5, passages[0] * 2), (None, passages[0] * 2), (300, None), (301, ""), (302, "中文" * 40), (303, "x" + "中文" * 40)]
    r.shuffle(docs)
    assert run(make, docs) == brute(docs)


def test_blocks_and_rounds(spark, make, monkeypatch):
    """The same over many small blocks and array rounds."""
    r = random.Random(5)
    base = "".join(r.choice("ab ") for _ in range(4000))
    docs = [(i, base[r.randint(0, 3000) :][: r.randint(0, 900)] + str(i) + base[r.randint(0, 3900) :]) for i in range(40)]
    monkeypatch.setattr(repeats, "BLOCK_BYTES", 5000)
    assert run(make, docs) == brute(docs)


def test_empty(spark, make):
    assert repeats.repeated_passages(make([])).count() == 0
    assert run(make, [(1, None), (None, "x" * 80)]) == brute([(1, None), (None, "x" * 80)])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=400), st.integers(7, 60))
def test_owners_depend_on_the_string_alone(values, round_bytes):
    text = bytes(values) * 2
    old = repeats.ROUND_BYTES
    try:
        repeats.ROUND_BYTES = round_bytes
        h, first, count = repeats.owners(text)
    finally:
        repeats.ROUND_BYTES = old
    assert int(count.sum()) == max(0, len(text) - 49)
    seen = {}
    for a, n, k in zip(first.tolist(), count.tolist(), h.tolist()):
        assert 1 <= n <= 27
        for p in range(a, a + n):
            assert seen.setdefault(text[p : p + 50], k) == k


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**40), min_size=1, max_size=80))
def test_blind_trie_sorts(keys):
    groups = repeats.blind_trie(keys)
    assert [keys[g[0]] for g in groups] == sorted(set(keys))
    assert sorted(i for g in groups for i in g) == list(range(len(keys))) and all(len({keys[i] for i in g}) == 1 for g in groups)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 2), st.integers(0, 2)), min_size=1, max_size=80), st.integers(1, 3))
def test_multikey_sorts(rows, depth):
    words = np.array(rows, np.uint64)
    order, group = repeats.multikey(words, depth)
    keys = [rows[i][:depth] for i in order]
    assert keys == sorted(keys)
    assert all((keys[k] == keys[k - 1]) == (group[k] == group[k - 1]) for k in range(1, len(keys)))
