from collections import defaultdict

from linkloom.llm import mixing, registry
from oracle import duck, rows


def test_sql(spark, sf):
    assert rows(mixing.op1_mix_sources(spark, sf).toPandas()) == rows(duck(sf, mixing.OP1_SQL))


def test_targets_and_bounds(spark, make):
    docs = make([(i, "w " * (i % 7), f"s{i % 5 if i % 3 else 0}") for i in range(300)])
    got = mixing.mix(docs).collect()
    taken, target = defaultdict(int), {}
    by_id = {r.doc_id: r for r in docs.collect()}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        taken[by_id[r.doc_id].source] += r.taken
        target[by_id[r.doc_id].source] = r.target
    assert all(taken[s] == int(target[s]) for s in target)
    total = sum(r.size for r in got)
    assert abs(sum(target.values()) - total) < 1e-6
    assert sorted(mixing.mix(docs.repartition(7)).collect()) == sorted(got)


def test_cap_and_reshare(spark, make):
    # s0 small: stops at 3 times its size; the rest goes by weight.
    docs = make([(1, "a", "s0"), (2, "w " * 100, "s1"), (3, "w " * 100, "s2")])
    t = {r.doc_id: r.target for r in mixing.mix(docs).collect()}
    assert t[1] == 3.0 and abs(t[2] - 198 * 2 / 5) < 1e-9 and abs(t[3] - 198 * 3 / 5) < 1e-9


def test_edges(spark, make):
    got = {(r.doc_id, r.size): r.taken for r in mixing.mix(make([(None, "a b", None), (1, None, "s"), (2, "", "s"), (3, "x " * 9, "s"), (3, "x " * 9, "s"), (4, "y", None)])).collect()}
    assert got[(1, 0)] == 0 and got[(2, 0)] == 0
    assert mixing.mix(make([])).count() == 0
    assert mixing.mixed_documents(make([])).count() == 0


def test_mixed_documents_take_what_the_plan_says(spark, make):
    docs = make([(i, " ".join(f"w{i}_{k}" for k in range(i % 9 + 1)), f"s{i % 3}") for i in range(60)])
    plan = {r.doc_id: r.taken for r in mixing.mix(docs).collect()}
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    got = defaultdict(int)
    for r in out.collect():
        got[r.doc_id] += len(r.text.split())
        assert r.n_chars == len(r.text)
    assert {k: v for k, v in plan.items() if v} == dict(got)


def test_registered():
    assert "op1_mix_sources" in registry.queries()
