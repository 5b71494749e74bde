import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from linkloom.llm import components, kernels, neardup
from pyspark.sql import GroupedData

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)]) if w else frozenset()


def brute(docs):
    """Rows by all pairs of texts; documents with an id, by their texts."""
    rows = [(i, shingles(t)) for i, t in docs]
    nodes = [(i, s) for i, s in rows if i is not None and s]
    root = list(range(len(nodes)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(nodes)):
        for b in range(a):
            x, y = nodes[a][1], nodes[b][1]
            n = len(x & y)
            if 100 * n >= 75 * (len(x) + len(y) - n):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(nodes):
        least[find(k)] = min(i, least.get(find(k), i))
    comp, k = [], 0
    for i, s in rows:
        if i is None:
            comp.append((None, len(s), None, True))
        elif not s:
            comp.append((i, 0, i, True))
        else:
            c = least[find(k)]
            k += 1
            comp.append((i, len(s), c, i == c))
    return sorted(comp, key=repr)


def run(make, docs):
    return sorted((tuple(r) for r in neardup.link(make([(i, t, "s") for i, t in docs])).collect()), key=repr)


def test_table(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted((tuple(r) for r in neardup.op8_minhash_neardup(spark, sf).collect()), key=repr) == brute(docs)


def group(r, n, words=60, edits=8):
    base = [f"w{r.randint(0, 500)}" for _ in range(words)]
    out = []
    for _ in range(n):
        t = list(base)
        for _ in range(r.randint(0, edits)):
            t[r.randint(0, words - 1)] = f"e{r.randint(0, 10**6)}"
        out.append(" ".join(t))
    return out


def test_chained_groups(spark, make):
    """Groups of copies so far from one another that their bucket's smallest
    member does not link them all."""
    r = random.Random(11)
    docs = [(i, t) for i, t in enumerate(t for n in (120, 40, 9, 2) for t in group(r, n))]
    docs += [(1000 + i, t.upper().replace(" ", "\n\t ")) for i, (_, t) in enumerate(docs[:20])]
    r.shuffle(docs)
    assert run(make, docs) == brute(docs)


def test_blocks(spark, make, monkeypatch):
    """The same with buckets cut into many small blocks."""
    monkeypatch.setattr(neardup, "BLOCK", 7)
    r = random.Random(12)
    docs = list(enumerate(group(r, 90)))
    assert run(make, docs) == brute(docs)


def test_further_centres(spark, make, monkeypatch):
    """The same with rounds of further centres before the blocks."""
    turns, pairs = [], neardup.star_pairs
    monkeypatch.setattr(neardup, "star_pairs", lambda members, turn: turns.append(turn) or pairs(members, turn))
    monkeypatch.setattr(neardup, "COPIES", 0)
    r = random.Random(12)
    docs = list(enumerate(group(r, 60)))
    assert run(make, docs) == brute(docs)
    assert turns


def test_few_asking_members_do_not_copy_their_bucket(spark, make, monkeypatch):
    """A bucket of linked copies with one member that none of them is near
    enough to goes to its comparison about once, not once for each block."""
    sent, apply = [], GroupedData.applyInPandas

    def counted(self, *args, **kwargs):
        sent.append(self._df.count())
        return apply(self, *args, **kwargs)

    monkeypatch.setattr(GroupedData, "applyInPandas", counted)
    monkeypatch.setattr(neardup, "BLOCK", 7)
    r = random.Random(14)
    base = [f"w{i}" for i in range(60)]
    far = base[:41] + [f"f{i}" for i in range(19)]
    docs = [(i, " ".join(base + [f"c{i}"])) for i in range(90)] + [(500, " ".join(far))]
    r.shuffle(docs)
    assert run(make, docs) == brute(docs)
    assert sent and sum(sent) < 1000  # 5315 rows if the bucket is copied to all its 13 blocks


def test_edges(spark, make):
    docs = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE "), (6, "a b c d e"), (7, "A b\nc d e"), (None, "a b c d e"), (7, "other text of its own here"), (8, "other text of its own here"), (8, "other text of its own here"), (9, "É b"), (10, "é b"), (11, "w " * 20000), (12, "w " * 7)]
    assert run(make, docs) == brute(docs)
    assert neardup.link(make([])).count() == 0
    assert run(make, [(None, "x"), (None, None)]) == [(None, 0, None, True), (None, 1, None, True)]


def test_kept_documents(spark, make):
    r = random.Random(13)
    docs = [(i, t) for i, t in enumerate(group(r, 12, edits=1) + group(r, 5, edits=1))] + [(50, None), (51, ""), (None, "x"), (0, "second text under one id")]
    df = make([(i, t, "s") for i, t in docs + docs[:3]])
    out = neardup.kept_documents(df)
    assert out.columns == df.columns
    got = sorted((repr(x.doc_id), x.text) for x in out.collect() if x.text)
    want = sorted({(repr(i), t) for (i, t), (_, _, _, keep) in zip(docs, [b for d in docs for b in [next(x for x in brute(docs) if x[0] == d[0] and x[1] == len(shingles(d[1])))]]) if keep and t})
    assert got == want
    assert sorted(repr(x.doc_id) for x in out.collect() if not x.text) == ["50", "51"]


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1060)] + [(5, 5), (None, 3)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            root[max(find(a), find(b))] = min(find(a), find(b))
    got = {x.node: x.component for x in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in root}
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="aB é\n\t\x0b\x85 ", max_size=40), max_size=6))
def test_shingle_sets(texts):
    lines = [kernels.normal_words(t.encode()) for t in texts]
    assert [len(x) for x in kernels.shingle_sets(lines)] == [len(shingles(t)) for t in texts]
    sets = list(kernels.shingle_sets(lines))
    for a, x in zip(texts, sets):
        for b, y in zip(texts, sets):
            assert len(np.intersect1d(x, y)) == len(shingles(a) & shingles(b))


def test_long_lines_hash_in_parts(monkeypatch):
    line = " ".join(f"word{i}" for i in range(5000)).encode()
    want = kernels.word_hashes(line)
    monkeypatch.setattr(kernels, "SLICE_BYTES", 100)
    assert (kernels.word_hashes(line) == want).all()


def test_signature_estimates_similarity():
    r = np.random.default_rng(1)
    x = r.integers(0, 2**64, 1000, np.uint64)
    y = np.concatenate((x[:800], r.integers(0, 2**64, 200, np.uint64)))
    agree = (kernels.signature(x, 512) == kernels.signature(y, 512)).mean()
    assert abs(agree - 800 / 1200) < 0.08
