import re
from collections import Counter, defaultdict

import corpus_pipeline
from linkloom.llm import mixing, quality
from linkloom.llm.common import materialize
from linkloom.llm.tokens import ids_of
from test_neardup import brute as near_brute

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_stages(spark, sf):
    """Each stage against a brute-force version on its own input."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "source_mix", "best_fit_packing"]
    steps = dict(corpus_pipeline.STAGES)

    good = steps["quality_rules"](spark, docs, sf).cache()
    kept = {r.doc_id for r in quality.judge(docs).collect() if r.kept}
    assert good.columns == names and sorted(r.doc_id for r in good.collect()) == sorted(kept)

    lined = steps["line_dedup"](spark, good, sf).cache()
    strip = lambda x: x.strip(" \t\n\x0b\x0c\r")
    sites, keeper = defaultdict(set), {}
    for r in good.collect():
        for x in map(strip, r.text.split("\n")):
            if len(WORD.findall(x)) >= 3:
                sites[x].add(r.source)
                keeper[x] = min(r.doc_id, keeper.get(x, r.doc_id))
    want = {}
    for r in good.collect():
        left = [x for x in r.text.split("\n") if len(sites.get(strip(x), ())) < 5 or keeper[strip(x)] == r.doc_id]
        if len(left) == len(r.text.split("\n")) or strip("\n".join(left)):
            want[r.doc_id] = "\n".join(left)
    assert lined.columns == names and {r.doc_id: r.text for r in lined.collect()} == want

    near = steps["near_dedup"](spark, lined, sf).cache()
    keep = {i for i, _, _, k in near_brute([(r.doc_id, r.text) for r in lined.collect()]) if k}
    assert near.columns == names and sorted(r.doc_id for r in near.collect()) == sorted(keep)

    mixed = steps["source_mix"](spark, near, sf).cache()
    taken = {r.doc_id: r.taken for r in mixing.mix(near).collect() if r.taken}
    words = Counter()
    for r in mixed.collect():
        words[r.doc_id] += len(WORD.findall(r.text))
    assert mixed.columns == names and dict(words) == taken

    packed = steps["best_fit_packing"](spark, mixed, sf).collect()
    tokens = sum(len(ids_of("byte_bpe_50k", r.text)) + 1 for r in mixed.collect())
    assert sum(r.length for r in packed) == tokens
    assert len({r.sequence_id for r in packed}) <= -(-tokens // 2048) + 1


def pieces(df):
    return sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in df.collect())


def test_run(spark, sf):
    """run() is the stages, one after another."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, sf), "stage")
    got = corpus_pipeline.run(spark, sf)
    rows = got.collect()
    assert pieces(got) == pieces(docs) and rows
    ends = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 2048
    assert corpus_pipeline.ORACLE_SQL is None


def test_stage_edges(spark, sf, make):
    """Nulls in every column, empty and very long texts, repeated rows, ties,
    clashing columns, and an empty table, through every stage."""
    plain = lambda k: " ".join(f"word{k}x{j}" for j in range(30))
    long = " ".join(f"long{j}" for j in range(60_000))
    rows = [(1, plain(1), "a"), (1, plain(1), "a"), (2, plain(1), "b"), (3, None, "a"), (4, "", None), (None, plain(5), "a"), (None, plain(6), None), (7, long, "c"), (8, "too short", "a"), (None, None, None), (9, plain(9), None)]
    want = {
        "quality_rules": [(1, plain(1)), (1, plain(1)), (2, plain(1)), (None, plain(5)), (None, plain(6)), (7, long), (9, plain(9))],
        "line_dedup": [(1, plain(1)), (1, plain(1)), (2, plain(1)), (None, plain(5)), (None, plain(6)), (7, long), (9, plain(9))],
        "near_dedup": [(1, plain(1)), (None, plain(5)), (None, plain(6)), (7, long), (9, plain(9))],
    }
    docs, order = make(rows), lambda found: sorted(found, key=repr)
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, make([]), sf)
        assert empty.count() == 0
        docs = materialize(stage(spark, docs, sf), "stage")
        if name != "best_fit_packing":
            assert docs.columns == empty.columns == names
        if name in want:
            assert order((r.doc_id, r.text) for r in docs.collect()) == order(want[name])
        if name == "source_mix":
            before = Counter(w for _, t in want["near_dedup"] for w in WORD.findall(t))
            taken = Counter(w for r in docs.collect() for w in WORD.findall(r.text))
            assert taken and set(taken) <= set(before) and max(taken.values()) <= 3
            mixed = sum(len(ids_of("byte_bpe_50k", r.text)) + 1 for r in docs.collect())
    assert sum(r.length for r in docs.collect()) == mixed
    # A stage meets null and empty texts too where the one before leaves them.
    raw = make(rows)
    assert len([r for r in corpus_pipeline.line_dedup(spark, raw, sf).collect() if not r.text]) == 3
    assert len([r for r in corpus_pipeline.near_dedup(spark, raw, sf).collect() if not r.text]) == 3
    assert corpus_pipeline.best_fit_packing(spark, raw.where("text IS NULL OR text = ''"), sf).count() == 3
