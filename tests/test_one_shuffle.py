"""Pairs are made within a selector's row and shuffled once, to be summed."""

import random

from pyspark.sql import functions as F

from linkloom.operators import graph_build as G
from linkloom.operators import identifiers as I
from linkloom.operators import links as L

AS_OF = "2002-01-01"


def shuffles(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning"), plan.count("Join")


def observed(spark):
    """Hosts of 40 domains, some of none, with selectors of every commonness."""
    draw, rows = random.Random(5), []
    for h in range(300):
        rd = None if h % 19 == 0 else f"d{h % 40}"
        for kind, many in (("tls_san", 90), ("tracking_id", 700), ("asn", 3), ("dns_txt_token", 40), ("site_verification", 40), ("shared_ip", 60)):
            for _ in range(2):
                day = f"2001-{draw.randint(1, 12):02d}-{draw.randint(1, 28):02d}"
                rows.append((f"h{h}", rd, kind, f"v{draw.randint(0, many)}", "s", day, day))
    return spark.createDataFrame(rows, "entity string, rd string, kind string, value string, source string, first_seen string, last_seen string")


def test_owned_sides_are_the_sides(spark):
    rows = observed(spark)
    noisy = spark.createDataFrame([("v1",), ("v2",)], "value string")
    owners = rows.select(F.lit("host").alias("kind"), F.col("entity").alias("value"), "rd").distinct()
    merged = G.merge_observations(rows)
    old = L.sides(merged, owners, G.selectors(merged, owners=owners, noisy=noisy))
    columns = ["kind", "value", "rd", "degree", "first", "last", "n_hosts"]
    several = old.join(old.groupBy("kind", "value").count().where("count > 1").drop("count"), ["kind", "value"], "left_semi")
    assert sorted(L.owned_sides(rows, noisy).select(columns).collect()) == sorted(several.select(columns).collect()) != []
    weights = {"tls_san": 40.0, "shared_ip": 85.0}
    links = lambda side: sorted(L.assemble(L.evidence(side, AS_OF, weights)).collect())
    assert links(L.grouped(L.owned_sides(rows, noisy))) == links(old) != []
    turned = sorted(L.assemble(L.evidence(old, AS_OF, weights), turned=True).collect())
    assert turned == sorted(L.both_ways(L.assemble(L.evidence(old, AS_OF, weights))).collect())


def test_pairs_of_domains_are_not_joined(spark):
    side = L.owned_sides(observed(spark))
    assert shuffles(L.shared(L.grouped(side))) == (1, 0)
    assert shuffles(L.ranked(L.assemble(L.factors(L.shared(side), AS_OF), turned=True))) == (2, 0)


def test_pairs_of_documents_are_not_joined(spark):
    facts = spark.createDataFrame([(f"d{i}", f"p{i % 3}", f"v{i % 7}") for i in range(80)] * 2, "doc string, path string, value string")
    found = I.path_matches(facts)
    assert shuffles(found.groupBy("a", "b").agg(F.count(F.lit(1)))) == (2, 0)
    assert sorted(found.collect()) == sorted(I.path_matches(facts, None).collect()) != []


def test_line_items_are_dealt_before_they_become_rows(spark, sf):
    from linkloom.plans import graph_queries

    plan = graph_queries.observations(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.index("Generate")]


def test_documents_are_put_together_from_plain_lines(spark, sf):
    from linkloom.plans import source_queries

    plan = source_queries.order_documents(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "sha2" not in plan[plan.index("Exchange") :]
