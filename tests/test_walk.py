"""Walks over compared domains against the walk over all their pairs."""

import random

from pyspark.sql import functions as F

from linkloom.operators import components as C
from linkloom.operators import identifiers as I


def tables(spark, seed):
    draw = random.Random(seed)
    kinds = [("part_day", "tier_1", "tls"), ("supp_day", "tier_2", "tracking"), ("part", "tier_3", "social")]
    ids = [(f"d{d:03d}", *draw.choice(kinds), f"v{draw.randint(0, 150)}") for d in range(20, 200) for _ in range(2)]
    certs = [(f"d{d:03d}", f"i{draw.randint(0, 6)}", draw.choice([draw.randint(0, 40) * 604_800, draw.randint(0, 40 * 604_800)])) for d in range(18, 160, 2)] + [("d000", "i0", 40 * 700_000), (None, "i1", 5)]
    found = spark.createDataFrame(ids, "domain string, type string, tier string, category string, value string")
    return found, spark.createDataFrame(certs, "domain string, issuer string, t long").select("domain", "issuer", F.timestamp_seconds("t").alias("issued"))


def test_walk_is_the_walk_over_all_pairs(spark):
    sizes = set()
    for seed in range(2):
        found, certs = tables(spark, seed)
        freq = I.frequency(found)
        pairs = I.compared(I.evidence(I.shared_points(found, freq), certs)).where("score >= 20").select("a", "b", "score")
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "score")).cache()
        want = sorted(C.traverse(both, both.agg(F.min("a").alias("node")), 3).collect())
        assert sorted(I.walk(I.telling(found, freq), certs, depth=3).collect()) == want
        assert want[0][0] > "d016"  # the first domains have no pair
        sizes.add(len(want))
    assert max(sizes) > 10


def test_walk_of_nothing(spark):
    found, certs = tables(spark, 1)
    freq = I.frequency(found)
    assert I.walk(I.telling(found, freq).limit(0), certs.limit(0)).collect() == []


def test_walk_makes_no_pairs_of_certificates(spark):
    """4,000 domains in one week of one issuer: eight million pairs, two steps."""
    certs = spark.range(4000).select(F.format_string("d%04d", "id").alias("domain"), F.lit("i").alias("issuer"), F.timestamp_seconds(F.col("id") * 300).alias("issued"))
    none = spark.createDataFrame([], "domain string, type string, tier string, category string, value string, multiplier double")
    reached = {r.node: r.hop_distance for r in I.walk(none, certs).collect()}
    assert len(reached) == 4000
    assert reached["d2016"] == 1 and reached["d2017"] == 2
