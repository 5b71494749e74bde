import random
import re

from linkloom.llm import quality
from oracle import duck, rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow(text):
    w = WORD.findall(text or "")
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    hit = {p for i, g in enumerate(grams) if grams.count(g) > 1 for p in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), sum(x in lines[:i] for i, x in enumerate(lines)), len(hit), len(lines)


def test_sql(spark, sf):
    assert rows(quality.op10_host_quality(spark, sf).toPandas()) == rows(duck(sf, quality.OP10_SQL))


def test_measures(spark, make):
    r = random.Random(7)
    texts = [None, "", " ", "\n", "a\n\na\na \n#", "\x0b\x0c"] + ["".join(r.choice("ab#é𝄞 \n\t\r\x0b\u2003&") for _ in range(r.randint(0, 120))) for _ in range(400)]
    got = {x.doc_id: tuple(x[c] for c in quality.MEASURES) for x in quality.judge(make([(i, t, "s") for i, t in enumerate(texts)])).collect()}
    assert got == {i: slow(t) for i, t in enumerate(texts)}


def test_long_texts_count_the_same(monkeypatch):
    r = random.Random(1)
    for _ in range(30):
        words = [r.choice("abc") for _ in range(r.randint(0, 200))]
        want = quality.repeated_words(words)
        monkeypatch.setattr(quality, "_LONG", 5)
        assert quality.repeated_words(words) == want
        monkeypatch.undo()


def clean(k):
    return " ".join(f"word{k}x{j}" for j in range(30))


def test_hosts(spark, make):
    bad = "# * $ % & | < > short words here only some more text of it"
    docs = [(i, clean(i), "good") for i in range(40)] + [(100 + i, bad if i < 35 else clean(i), "bad") for i in range(40)] + [(200, bad, "tiny")] + [(300 + i, clean(i), f"h{i}") for i in range(30)]
    got = {r.doc_id: r for r in quality.judge(make(docs)).collect()}
    assert all(got[i].kept for i in range(40)) and all(got[300 + i].kept for i in range(30))
    assert not any(got[100 + i].kept for i in range(40))
    assert got[100].host_rejected and not got[100].base_failed


def test_shrinking(spark, make):
    """One bad document says less of a host than many."""
    hosts = spark.createDataFrame([(f"h{k}", 1, False) for k in range(50)], "h string, n int, f boolean")
    docs = [(i, clean(i), f"h{i % 50}") for i in range(500)] + [(1000, "a " * 30, "new")]
    got = {r.doc_id: r for r in quality.judge(make(docs)).collect()}
    assert hosts.count() == 50 and got[1000].base_failed and not got[1000].kept
    assert all(got[i].kept for i in range(500))


def test_verdicts_follow_the_prior(spark, make):
    """Hosts that differ by chance alone all stay, whatever their sizes; a host
    that is three times worse goes whole, and its good documents with it."""
    r = random.Random(5)
    bad = "# * $ % & | < > short words here only some more text of it"
    even = [(i, bad if r.random() < 0.1 else clean(i), f"h{i % 40}") for i in range(2000)] + [(5000 + i, bad if i < 2 else clean(i), "small") for i in range(3)]
    assert not any(x.host_rejected for x in quality.judge(make(even)).collect())
    worse = even + [(9000 + i, bad if i % 2 else clean(i), "worse") for i in range(200)]
    got = quality.judge(make(worse)).collect()
    assert {x.doc_id >= 9000 for x in got if x.host_rejected} == {True}
    fallen = [x for x in got if x.doc_id >= 9000]
    assert all(x.host_rejected and not x.kept and not x.base_failed for x in fallen) and len(fallen) == 200
    want = duck_verdict(worse)
    assert {x.doc_id for x in got if x.host_rejected} == want


def duck_verdict(docs):
    """The SQL's verdict on the same rows."""
    import duckdb
    import pandas as pd

    con = duckdb.connect()
    con.register("documents", pd.DataFrame(docs, columns=["doc_id", "text", "source"]))
    return {i for (i,) in con.execute(f"SELECT doc_id FROM ({quality.OP10_SQL}) WHERE host_rejected").fetchall()}


def test_edges(spark, make):
    docs = [(1, None, None), (2, "", "s"), (None, clean(1), None), (3, clean(3), "s"), (3, clean(3), "s"), (4, "x " * 50000, "s")]
    got = quality.judge(make(docs)).collect()
    assert len(got) == 6
    assert {(r.doc_id, r.n_words) for r in got} == {(1, 0), (2, 0), (None, 30), (3, 30), (4, 50000)}
    assert quality.judge(make([])).count() == 0
    out = quality.kept_documents(make(docs))
    assert out.columns == make(docs).columns
    assert sorted(repr(r.doc_id) for r in out.collect()) == sorted(repr(r.doc_id) for r in got if r.kept)
    assert quality.kept_documents(make([])).count() == 0
