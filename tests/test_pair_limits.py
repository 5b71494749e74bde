"""Pair joins whose groups are bounded."""

from pyspark.sql import functions as F

from linkloom.operators import identifiers as I


def test_timing_is_looked_for_in_pairs_that_are_asked_for(spark):
    certs = spark.range(3000).select(F.concat(F.lit("d"), "id").alias("domain"), F.lit("ca").alias("issuer"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 60).alias("issued"))
    pairs = spark.createDataFrame([("d1", "d3"), ("d1", "d3"), ("d5", "d5"), ("d0", "d2999"), ("d7", "gone"), (None, "d1")], "a string, b string")
    got = sorted(map(tuple, I.issuance_timing(certs, pairs).collect()))
    assert got == [("d0", "d2999", "ca", "7d", 2999 * 60), ("d1", "d3", "ca", "24h", 120)]


def test_timing_against_all_pairs(spark):
    import random

    rng = random.Random(3)
    rows = [(f"d{rng.randrange(12)}", rng.choice("xy"), 1_700_000_000 + rng.randrange(20) * 50_000) for _ in range(80)] + [("d1", None, 1_700_000_000), ("d2", "x", None)]
    certs = spark.createDataFrame(rows, "domain string, issuer string, s long").select("domain", "issuer", F.timestamp_seconds("s").alias("issued"))
    names = sorted({r[0] for r in rows})
    want = {}
    for d, i, s in rows:
        for e, j, t in rows:
            if d < e and i and i == j and s and t and 0 < abs(s - t) <= 7 * 86_400:
                key = (d, e, i, "24h" if abs(s - t) <= 86_400 else "7d")
                want[key] = min(want.get(key, 10**9), abs(s - t))
    pairs = spark.createDataFrame([(a, b) for a in names for b in names if a < b], "a string, b string")
    assert {tuple(r)[:4]: r.seconds for r in I.issuance_timing(certs, pairs).collect()} == want


def test_common_values_are_left_out_and_listed(spark):
    facts = spark.createDataFrame([(f"x{i}", "p", "many") for i in range(6)] + [("x0", "p", "few"), ("x1", "p", "few"), ("x1", "p", "few"), ("x0", "p", "none"), ("x1", "p", None)], "doc string, path string, value string")
    assert [tuple(r) for r in I.path_matches(facts, most=5).collect()] == [("x0", "x1", "p", 1)]
    assert I.path_matches(facts, most=None).count() == 15 and I.path_matches(facts).count() == 15
    assert [tuple(r) for r in I.common_values(facts, most=5).collect()] == [("p", "many", 6)]
    labels = facts.select(F.col("doc").alias("owner"), F.col("value").alias("label"))
    assert [tuple(r)[:3] for r in I.label_overlap(labels, ("none",), most=5).collect()] == [("x0", "x1", 1)]
    assert I.label_overlap(labels, ("none",), most=None).count() == 15
    assert [tuple(r) for r in I.common_labels(labels, most=5).collect()] == [("many", 6)]
