from collections import Counter

import pytest
from linkloom.llm import rollup
from linkloom.llm.common import new_path
from linkloom.llm.tokens import ids_of


def brute(docs, gone, versions=rollup.VERSIONS):
    n, t = Counter(), Counter()
    for r in docs:
        if r.doc_id in gone:
            continue
        for v in versions:
            text = rollup.without_repeated_lines(r.text) if r.text else r.text
            n[(r.source, r.lang, v)] += 1
            t[(r.source, r.lang, v)] += len(ids_of(v, text))
    return {k: (n[k], t[k]) for k in n if n[k] or t[k]}


def test_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    gone = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("toxic = 1").collect()}
    got = {(r.source, r.lang, r.tokenizer_version): (r.n_docs, r.n_tokens) for r in rollup.op2_token_rollup(spark, sf).collect()}
    assert got == brute(docs, gone)


def test_commits_are_idempotent(spark):
    store = rollup.TokenRollup(spark, new_path(spark, "test"))
    ev = spark.createDataFrame([("insert", "s", "en", "v", 5, None), ("insert", "s", None, "v", 7, None), ("revise", "s", "en", "v", 4, 5)], "kind string, source string, lang string, tokenizer_version string, tokens long, old_tokens long")
    assert store.commit("a", ev) and not store.commit("a", ev)
    assert store.committed() == ["a"]
    assert sorted((r.lang or "", r.n_docs, r.n_tokens) for r in store.totals().collect()) == [("", 1, 7), ("en", 1, 4)]
    assert store.commit("b", ev.where("kind = 'insert'").selectExpr("'delete' AS kind", "source", "lang", "tokenizer_version", "CAST(NULL AS long) AS tokens", "CASE lang WHEN 'en' THEN 4 ELSE 7 END AS old_tokens"))
    assert store.totals().count() == 0
    with pytest.raises(ValueError):
        store.commit("../x", ev)
    with pytest.raises(Exception):
        store.commit("c", ev.selectExpr("'other' AS kind", "source", "lang", "tokenizer_version", "tokens", "old_tokens"))
    assert store.committed() == ["a", "b"]


def test_folds_and_races(spark):
    """Folded totals are the unfolded ones; of two writers of a batch one counts."""
    folder = new_path(spark, "test")
    store, other = rollup.TokenRollup(spark, folder, fold_after=3), rollup.TokenRollup(spark, folder, fold_after=100)
    one = spark.createDataFrame([("insert", "s", "en", "v", 5, None)], "kind string, source string, lang string, tokenizer_version string, tokens long, old_tokens long")
    for n in range(7):
        assert store.commit(f"b{n}", one) and not other.commit(f"b{n}", one)
        assert [tuple(r) for r in other.totals().select("n_docs", "n_tokens").collect()] == [(n + 1, 5 * n + 5)]
    assert len(store._listed("folds")) == 2 and len(store._open()) == 1
    assert not store._claim("commits", "b3", "late") and store._content("commits", "b3") != "late"
    assert other.fold() and not other.fold()
    assert [tuple(r) for r in store.totals().select("n_docs", "n_tokens").collect()] == [(7, 35)]


def test_edges(spark, make):
    docs = make([(1, None, "s"), (2, "", None), (3, "x\nx\ny", "s"), (3, "x\nx\ny", "s"), (None, "z", "s")])
    gone = spark.createDataFrame([(1,), (None,)], "doc_id long")
    got = {(r.source, r.lang, r.tokenizer_version): (r.n_docs, r.n_tokens) for r in rollup.maintain(docs, gone, new_path(spark, "t")).collect()}
    assert got == brute(docs.collect(), {1})
    assert rollup.maintain(make([]), gone, new_path(spark, "t")).count() == 0
