"""Public suffixes by rules: wildcards, exceptions, private registries."""

import pytest
from linkloom.operators import suffixes as S
from pyspark.sql import functions as F

FILE = """// comment
com
co.uk
uk  // the rest of a line is none
// ===BEGIN ICANN DOMAINS===
*.ck
!www.ck
jp
*.kawasaki.jp
!city.kawasaki.jp
gov.il
il
// ===END ICANN DOMAINS===
// ===BEGIN PRIVATE DOMAINS===
blog.com
*.host.com
// ===END PRIVATE DOMAINS===
net
"""


@pytest.fixture(scope="module")
def rules(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("rules") / "suffixes.dat"
    path.write_text(FILE)
    return S.read_rules(spark, str(path)).cache()


def test_rules(rules):
    got = {(r.suffix, r.rule): r.private for r in rules.collect()}
    assert got["blog.com", "plain"] and got["host.com", "wildcard"] and not got["net", "plain"] and not got["ck", "wildcard"] and not got["uk", "plain"]
    assert got["city.kawasaki.jp", "exception"] is False and len(got) == 13


CASES = {
    "a.com": ("a.com", "a.com"), "x.a.com": ("a.com", "a.com"), "com": (None, None), "news.bbc.co.uk": ("bbc.co.uk",) * 2, "co.uk": (None, None), "a.b.other.uk": ("other.uk",) * 2,
    "a.ck": (None, None), "b.a.ck": ("b.a.ck",) * 2, "x.b.a.ck": ("b.a.ck",) * 2, "www.ck": ("www.ck",) * 2, "x.www.ck": ("www.ck",) * 2, "ck": (None, None),
    "city.kawasaki.jp": ("city.kawasaki.jp",) * 2, "x.city.kawasaki.jp": ("city.kawasaki.jp",) * 2, "a.b.kawasaki.jp": ("a.b.kawasaki.jp",) * 2, "b.kawasaki.jp": (None, None), "kawasaki.jp": ("kawasaki.jp",) * 2,
    "me.blog.com": ("me.blog.com", "blog.com"), "x.me.blog.com": ("me.blog.com", "blog.com"), "blog.com": (None, "blog.com"), "s.eu.host.com": ("s.eu.host.com", "host.com"), "eu.host.com": (None, "host.com"), "host.com": ("host.com", "host.com"),
    "a.unknown": ("a.unknown",) * 2, "x.a.unknown": ("a.unknown",) * 2, "unknown": (None, None), "10.0.0.1": (None, None), "2001:db8::1": (None, None), "": (None, None), "a..com": (None, None), None: (None, None),
    "*.A.COM.": ("a.com",) * 2, "ministry.gov.il": ("ministry.gov.il",) * 2,
}


@pytest.mark.parametrize("private", [True, False])
def test_cases(spark, rules, private):
    rows = spark.createDataFrame([(i, h) for i, h in enumerate(CASES)] * 2, "id int, h string")
    got = {r.h: r.rd for r in S.registrable(rows, "h", rules, private=private).collect()}
    assert got == {h: want[0 if private else 1] for h, want in CASES.items()}
    assert S.registrable(rows, "h", rules).count() == 2 * len(CASES)


def test_apexes_and_clashing_names(spark, rules):
    rows = spark.createDataFrame([("a.b.gov.il", "x", 1), ("gov.il", "y", 2), ("a.il", "z", 3)], "h string, host string, n int")
    got = {r.h: (r.rd, r.host, r.n) for r in S.registrable(rows, "h", rules, apexes=["gov.il"]).collect()}
    assert got == {"a.b.gov.il": ("gov.il", "x", 1), "gov.il": ("gov.il", "y", 2), "a.il": ("a.il", "z", 3)}


def test_entities(spark, rules):
    e = spark.createDataFrame([("domain", "b.kawasaki.jp", "kawasaki.jp", "2024"), ("subdomain", "me.blog.com", "blog.com", "2024"), ("ip", "10.0.0.1", None, "2024")], "kind string, value string, rd string, first_seen string")
    assert sorted(map(tuple, S.reentered(e, rules).collect())) == [("domain", "me.blog.com", "me.blog.com", "2024"), ("ip", "10.0.0.1", None, "2024"), ("subdomain", "b.kawasaki.jp", None, "2024")]


def test_no_rules_and_no_rows(spark, rules):
    rows = spark.createDataFrame([("x.a.com",)], "h string")
    assert S.registrable(rows, "h", rules.limit(0)).first().rd == "a.com"
    assert S.registrable(rows.limit(0), "h", rules).count() == 0


def test_labels_beyond_the_limit(spark, rules):
    long = ".".join("abcdefghijklmnopqrstuvwxyz")
    row = spark.createDataFrame([(f"{long}.co.uk",)], "h string")
    assert S.registrable(row, "h", rules).select(F.col("rd")).first().rd == "z.co.uk"
