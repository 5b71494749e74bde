import random
import re
from collections import Counter, defaultdict

import pytest
from linkloom.llm import collocations as op
from oracle import duck, rows

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def slow(docs, least, top):
    """By the definition: every phrase counted, every longer candidate looked at."""
    out, counts = [], defaultdict(Counter)
    for text, lang in docs:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            for k in range(1, 5):
                counts[lang if lang is not None else "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    for lang, f in counts.items():
        cands = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in cands.items():
            longer = [b for q, b in cands.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if any(100 * b >= 80 * a for b in longer):
                continue
            score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        n = sum(a for p, a in f.items() if len(p) == 1)
        out += [(lang, i, x[2].decode(), -x[1], x[3], x[4], n, -x[0]) for i, x in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def frame(spark, docs):
    df = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(docs)], "doc_id long, text string, lang string")
    for name in ("block", "range", "seq", "id", "left", "right", "a", "rank", "score", "word", "n", "phrase"):
        df = df.selectExpr("*", f"'x' AS `{name}`")
    return df


def run(spark, docs, least, top, block=1 << 20, range_bytes=8 << 20, parts=1):
    got = op.collocations(frame(spark, docs).repartition(parts), least, top, block, range_bytes)
    assert got.columns == COLUMNS
    return sorted(tuple(x) for x in got.collect())


@pytest.mark.parametrize("seed", range(4))
def test_brute_force(spark, seed):
    r = random.Random(seed)
    words = ["a", "B", "b", "é", "É", "𝄞", "cc", "\x00", " x", "d-d"]
    text = lambda: "".join(r.choice(words) + r.choice([" ", " ", " ", "\t", "  ", ". ", "\n", "\x0b", ", a "]) for _ in range(r.randint(0, 60)))
    docs = [(text(), r.choice(["en", "en", "fr", None, "und"])) for _ in range(60)] + [(None, "en"), ("", "fr"), (".,;", None)]
    want = slow(docs, 3, 40)
    assert want and {x[0] for x in want} == {"en", "fr", "und"}
    assert run(spark, docs, 3, 40, block=50, range_bytes=200, parts=3) == want


def test_blocks_and_ranges_do_not_matter(spark):
    r = random.Random(9)
    docs = [(" ".join(r.choice("abcd") for _ in range(80)), "en") for _ in range(20)]
    assert run(spark, docs, 5, 2000) == run(spark, docs, 5, 2000, block=7, range_bytes=64, parts=4) == slow(docs, 5, 2000)


def test_subsumed_at_eighty_percent(spark):
    """A phrase goes exactly from 80 % on, whichever side the longer one takes."""
    docs = [("x y z", "en")] * 8 + [("x y", "en")] * 2 + [("p q r", "en")] * 79 + [("q r", "en")] * 21
    got = {x[2] for x in run(spark, docs, 2, 100)}
    assert got == {"x y z", "p q r", "q r"}
    assert got == {x[2] for x in slow(docs, 2, 100)}


def test_hot_words_long_texts_and_ties(spark):
    docs = [("a " * 50_000 + "b c " * 40, "en")] + [("w%d v%d " % (i, i) * 30 + ".", "fr") for i in range(30)] + [("y" * 100_000 + " " + "z" * 50_000, "de")] * 31
    assert run(spark, docs, 30, 10, block=1000, range_bytes=100_000) == slow(docs, 30, 10)


def test_ranking_in_shares(spark, monkeypatch):
    """Large candidate tables are cut in shares and give the same ranks."""
    monkeypatch.setattr(op, "RANKED", 20)
    found = spark.createDataFrame([("en" if i % 3 else "fr", i % 7, i % 5, f"p{i}") for i in range(500)], "lang string, score long, a long, phrase string")
    got = {(x.lang, x["rank"]): x.phrase for x in op.ranked(found, 6).collect()}
    for lang in ("en", "fr"):
        want = sorted(((-(i % 7), -(i % 5), f"p{i}") for i in range(500) if (i % 3 != 0) == (lang == "en")))[:6]
        assert [got[lang, k] for k in range(1, 7)] == [p for _, _, p in want]


def test_wide_numbers(spark):
    """Products beyond 64 bits."""
    a, l, r = 9_000_000_000_000_000_001, 9_000_000_000_000_000_003, 9_100_000_000_000_000_007
    got = spark.createDataFrame([(a, l, r)], "a long, l long, r long").select(op.score_of(*[op.F.col(c) for c in "alr"]).alias("s")).first().s
    assert got == 2_000_000 * a // (l + r)


def test_empty(spark):
    assert run(spark, [], 30, 10) == []
    assert run(spark, [(None, None), ("", "en"), ("few words", "en")], 30, 10) == []


def test_sql(spark, sf):
    assert rows(op.op12_pair_naming(spark, sf).toPandas()) == rows(duck(sf, op.OP12_SQL))
