"""Certificates issued close together, of all pairs of domains."""

import pytest
from oracle import duck

from linkloom.operators import identifiers as I
from linkloom.plans import registry

registry.load()

DAY = 86_400


@pytest.fixture(scope="module")
def close(sf):
    """(a, b): its gaps in seconds by (issuer, within), from the orders by a plain loop."""
    by = {}
    for o in duck(sf, "SELECT CAST(o_custkey AS VARCHAR) AS d, o_orderpriority AS i, CAST(epoch(o_orderdate) AS BIGINT) + o_orderkey % 86400 AS t FROM orders").itertuples(index=False):
        by.setdefault(o.i, []).append((o.t, o.d))
    found = {}
    for issuer, rows in by.items():
        rows.sort()
        for n, (t, d) in enumerate(rows):
            for u, e in rows[n + 1 :]:
                if u - t > 7 * DAY:
                    break
                if u > t and d != e:
                    gaps = found.setdefault((min(d, e), max(d, e)), {})
                    key = issuer, "24h" if u - t <= DAY else "7d"
                    gaps[key] = min(gaps.get(key, u - t), u - t)
    return found


@pytest.mark.parametrize("cell_pairs", (20, 4_000_000))
def test_all_pairs_against_a_loop(spark, monkeypatch, cell_pairs):
    import random

    from pyspark.sql import functions as F

    monkeypatch.setattr(I, "CELL_PAIRS", cell_pairs)
    rng = random.Random(5)
    rows = [(f"d{rng.randrange(12)}", rng.choice("xy"), 1_700_000_000 + rng.randrange(20) * 50_000) for _ in range(80)] + [("d1", None, 1_700_000_000), ("d2", "x", None), (None, "x", 1_700_000_000)]
    certs = spark.createDataFrame(rows, "domain string, issuer string, s long").select("domain", "issuer", F.timestamp_seconds("s").alias("issued"))
    want = {}
    for d, i, s in rows:
        for e, j, t in rows:
            if d and e and d < e and i and i == j and s and t and 0 < abs(s - t) <= 7 * DAY:
                key = (d, e, i, "24h" if abs(s - t) <= DAY else "7d")
                want[key] = min(want.get(key, 10**9), abs(s - t))
    got = [tuple(r) for r in I.issuance_timing(certs).select("a", "b", "issuer", "within", "seconds").collect()]
    assert len(got) == len(want) and {r[:4]: r[4] for r in got} == want


def test_a_large_issuer_keeps_every_pair(spark):
    from pyspark.sql import functions as F

    certs = spark.range(3000).select(F.concat(F.lit("d"), "id").alias("domain"), F.lit("ca").alias("issuer"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 60).alias("issued"))
    assert I.issuance_timing(certs).count() == 3000 * 2999 // 2


def test_evidence_of_cells_adds_up(spark):
    """Shared identifiers and timing of one pair meet; either alone stays."""
    from pyspark.sql import functions as F

    shared = spark.createDataFrame([("a", "b", "tier_1", "tls", 92.0), ("a", "b", "tier_3", "social", 8.0), ("b", "z", "tier_3", None, 6.0)], "a string, b string, tier string, category string, points double")
    certs = spark.createDataFrame([("a", "x", 0), ("b", "x", 60), ("c", "x", 3 * DAY)], "domain string, issuer string, s long").select("domain", "issuer", F.timestamp_seconds("s").alias("issued"))
    points = I.evidence(shared, certs)
    got = {(r.a, r.b): (r.n_shared, r.score) for r in I.compared(points).collect()}
    assert got == {("a", "b"): (3, 100.0), ("a", "c"): (1, 30.0), ("b", "c"): (1, 30.0), ("b", "z"): (1, 2.0)}
    assert {(r.a, r.b, r.tier): (r.score, r.n_evidence) for r in I.tier_sums(points).collect()} == {("a", "b", "tier_1"): (92.0, 1), ("a", "b", "tier_3"): (56.0, 2), ("a", "c", "tier_4"): (30.0, 1), ("b", "c", "tier_4"): (30.0, 1), ("b", "z", "tier_3"): (6.0, 1)}
    assert sorted(map(tuple, I.compared(points.drop("cell")).collect())) == sorted(map(tuple, I.compared(points).collect()))


def test_domain_compare_has_pairs_of_timing_alone(spark, sf, close):
    got = {(r.a, r.b): r for r in registry.QUERIES["domain_compare"](spark, sf).collect()}
    assert close and set(close) <= set(got)
    assert all(got[pair].n_shared >= len(gaps) and got[pair].score >= 30 for pair, gaps in close.items())


def test_tiers_have_pairs_of_timing_alone(spark, sf, close):
    got = {(r.a, r.b, r.tier): r.n_evidence for r in registry.QUERIES["domain_compare_tiers"](spark, sf).collect()}
    for within, tier in (("24h", "tier_3"), ("7d", "tier_4")):
        want = {(*pair, tier): n for pair, gaps in close.items() if (n := sum(w == within for _, w in gaps))}
        assert want and all(got.get(key, 0) >= n for key, n in want.items())


def test_traversal_goes_over_pairs_of_timing_alone(spark, sf, close):
    got = {r.node: r.hop_distance for r in registry.QUERIES["traverse_depth2"](spark, sf).collect()}
    seed, near = next(n for n, h in got.items() if h == 0), {}
    for a, b in close:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    assert near[seed] and all(got.get(n) == 1 for n in near[seed])
    assert {n for one in near[seed] for n in near[one]} <= set(got)


def test_timing_query_has_all_pairs(spark, sf, close):
    got = {(r.a, r.b, r.issuer, r.within): r.seconds for r in registry.QUERIES["issuance_timing"](spark, sf).collect()}
    assert got == {(*pair, *key): gap for pair, gaps in close.items() for key, gap in gaps.items()}
