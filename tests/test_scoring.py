"""Scoring factors, denylist, links and paths on small graphs."""

import math

import pytest
from pyspark.sql import functions as F

from linkloom.constants import Config
from linkloom.functions import scoring as S
from linkloom.operators import components as C
from linkloom.operators import graph_build as G
from linkloom.operators import links as L
from linkloom.operators import identifiers as I

AS_OF = "2024-06-01"


def one(spark, *cols):
    return list(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first())


def test_rarity(spark):
    got = one(spark, *[S.rarity(F.lit(d)) for d in (0, 1, 2, 3, 8, 40000)], S.rarity(F.lit(None).cast("int")))
    assert got[:3] == [1.0, 1.0, 1.0] and got[6] == 1.0
    assert math.isclose(got[3], 1 / math.log2(3)) and math.isclose(got[4], 1 / 3) and math.isclose(got[5], max(0.04, 1 / math.log2(40000)))


def test_overlap(spark):
    t = lambda x: S.instant(F.lit(x).cast("string"))
    over = lambda *x: S.overlap(*map(t, x))
    got = one(spark, over("2024-01-01", "2024-02-01", "2024-01-15", "2024-03-01"), over("2020-01-01", "2020-02-01", "2024-01-01", "2024-02-01"), over(None, "2024-01-01", "2020-01-01", "2020-02-01"),
              over("2024-02-01", "2024-01-01", "2024-01-15", "2024-01-16"), over("2024-01-01", "2024-01-01", "2024-03-14", "2024-03-15"))
    assert got[:4] == [1.0, 0.25, 1.0, 1.0] and math.isclose(got[4], 1 - 73 / 365)


def test_recency_and_instants(spark):
    got = one(spark, *[S.recency(S.instant(F.lit(x).cast("string")), S.instant(F.lit(AS_OF))) for x in ("2024-05-01", "2023-12-04", "2023-06-02", "2000-01-01", None)])
    assert got[0] == got[1] == got[4] == 1.0 and math.isclose(got[2], 1 - (365 - 180) / 730) and got[3] == 0.3
    times = one(spark, *[F.unix_timestamp(S.instant(F.lit(x))) for x in ("2024-01-01", "2024-01-01T00:00:00", "2024-01-01 00:00:00", "2024-01-01T01:00:00+01:00", "2024-01-01T00:00:00Z", "2024-01-01T00:00:00.123456", "junk", "")])
    assert len(set(times[:6])) == 1 and times[6] is None and times[7] is None


def test_weights_and_strength(spark):
    w = lambda k, v: S.base_weight(F.lit(k), F.lit(v))
    assert one(spark, w("tls_cert_sha256", "x"), w("tracking_id", "adsense_publisher|1"), w("tracking_id", "odd|1"), w("never heard of", "x")) == [200.0, 190.0, 70.0, 40.0]
    s = lambda x, d: S.strength(F.lit(x), F.lit(d))
    assert one(spark, s(65.0, False), s(64.9, False), s(30.0, False), s(29.9, False), s(1.0, True)) == ["strong", "moderate", "moderate", "weak", "strong"]
    assert one(spark, S.confidence(F.lit(0.0)), S.confidence(F.lit(65.0)), S.confidence(F.lit(None).cast("double")), S.confidence(F.lit(-5.0))) == [0, 50, 0, 0]
    status = lambda a, b: S.certificate_status(*[S.instant(F.lit(x)) for x in (a, b, AS_OF)])
    assert one(spark, status("2020-01-01", "2021-01-01"), status("2025-01-01", "2026-01-01"), status("2024-01-01", "2025-01-01")) == ["expired", "not yet valid", "valid"]


def obs(spark, rows):
    return spark.createDataFrame([(e, k, v, "scan", a, b) for e, k, v, a, b in rows], "entity string, kind string, value string, source string, first_seen string, last_seen string")


def nodes(spark, names):
    return spark.createDataFrame([("domain", n, n if "." in n else None) for n in names], "kind string, value string, rd string")


def certs(spark, n):
    return obs(spark, [(f"d{i}.test", "tls_cert_sha256", "f" * 8, "2024-05-01", "2024-05-20") for i in range(n)])


def linked(spark, o, names):
    return {(r.a, r.b): r for r in L.links(o, nodes(spark, names), G.selectors(o), AS_OF).collect()}


def test_shared_certificate(spark):
    got = linked(spark, certs(spark, 2), ["d0.test", "d1.test"])
    link = got[("d0.test", "d1.test")]
    assert link.score == 200.0 and link.strength == "strong" and link.n_shared == 1
    assert got[("d1.test", "d0.test")].score == 200.0
    third = linked(spark, certs(spark, 3), [f"d{i}.test" for i in range(3)])
    assert third[("d0.test", "d1.test")].score == round(200 / math.log2(3), 2)


def test_noise_makes_no_link(spark):
    o = obs(spark, [(f"d{i}.test", "nameserver", "ns1.cloudflare.com", None, None) for i in range(2)] + [(f"d{i}.test", "asn", "13335", None, None) for i in range(2)] + [(f"d{i}.test", "tls_san", "localhost", None, None) for i in range(2)])
    assert linked(spark, o, ["d0.test", "d1.test"]) == {}
    # An address has no registrable domain: what is seen on it links nothing.
    o = obs(spark, [("10.0.0.1", "ssh_fp", "k", None, None), ("10.0.0.2", "ssh_fp", "k", None, None)])
    assert linked(spark, o, ["d0.test"]) == {}


def test_ceilings(spark):
    many = lambda n, kind, value: obs(spark, [(f"d{i}.test", kind, value, None, None) for i in range(n)])
    good = lambda o: {r.attributing for r in G.selectors(o).collect()}
    assert good(many(50, "html_hash", "x")) == {True} and good(many(51, "html_hash", "x")) == {False}
    assert good(many(51, "site_verification", "x")) == {True} and good(many(501, "site_verification", "x")) == {False}
    assert good(many(51, "tracking_id", "ga_property|x")) == {True} and good(many(51, "tracking_id", "gtm_container|x")) == {False}


def test_bundles(spark):
    sans = lambda rows: spark.createDataFrame(rows, "sha256 string, san string")
    owners = [("a", f"c{i}.test") for i in range(16)]
    assert {(r.kind, r.value) for r in G.bundled_selectors(sans(owners)).collect()} == {("tls_cert_sha256", "a"), *(("tls_san", f"c{i}.test") for i in range(16))}
    assert G.bundled_selectors(sans([("b", f"h{i}.one.test") for i in range(30)])).count() == 0
    assert G.bundled_selectors(sans([("p", "firebaseapp.com"), ("p", "*.firebaseapp.com")])).count() == 2


def test_order_does_not_matter(spark):
    o = obs(spark, [(f"d{i % 5}.test", "html_hash", f"v{i % 3}", f"2024-0{i % 9 + 1}-01", None) for i in range(40)])
    want = sorted(map(tuple, G.merge_observations(o).collect()), key=repr)
    assert sorted(map(tuple, G.merge_observations(o.orderBy(F.rand(3)).repartition(3)).collect()), key=repr) == want


def test_widening(spark):
    a, b = obs(spark, [("d", "k", "v", "2024-02-01", "2024-03-01")]), obs(spark, [("d", "k", "v", "2024-01-01", None), ("d", "k", "v", None, "2024-05-01")])
    assert [tuple(r)[4:] for r in G.widened(a, b).collect()] == [("2024-01-01", "2024-05-01")]


def test_networks(spark):
    side = spark.createDataFrame([(f"d{i}", "1.1.1.1", None, None, ["dns_a"]) for i in range(3)] + [(f"d{i}", "9.9.9.9", None, None, ["dns_a"]) for i in range(51)] + [("d0", "8.8.8.8", None, None, ["x"]), ("d1", "8.8.8.8", None, None, ["y"])], "rd string, value string, first string, last string, sources array<string>")
    noisy = spark.createDataFrame([("1.1.1.1",)], "value string")
    got = L.shared_ips(L.timed(side), noisy, AS_OF).collect()
    assert [(r.a, r.b, r.value, r.degree, r.weight, r.sources) for r in got] == [("d0", "d1", "8.8.8.8", 2, 85.0, ["x", "y"])]
    flags = F.create_map(F.lit("vpn"), F.lit(True))
    assert one(spark, L.says_shared(flags, F.array(F.lit("x"))), L.says_shared(F.create_map(F.lit("x"), F.lit(True)), F.array(F.lit("CDN"))), L.says_shared(F.create_map(F.lit("x"), F.lit(True)), F.lit(None).cast("array<string>"))) == [True, True, False]


def both(spark, rows):
    return L.both_ways(spark.createDataFrame(rows, "a string, b string, score double"))


def test_paths(spark):
    e = both(spark, [("a", "b", 90.0), ("b", "c", 50.0), ("c", "d", 70.0), ("x", "y", 10.0)])
    got = {(r.source, r.target): r for r in C.paths(e).collect()}
    assert got[("a", "c")].hops == 2 and got[("a", "c")].min_hop_score == 50.0 and [h["to"] for h in got[("a", "d")].chain] == ["b", "c", "d"]
    assert ("a", "x") not in got and ("a", "a") not in got
    assert not [r for r in C.paths(e, cfg=Config(path_hops=1)).collect() if r.hops > 1]
    assert max(sum(1 for s, _ in got if s == x) for x in "abcd") == 3
    few = C.paths(e, cfg=Config(path_nodes=1)).collect()
    assert len(few) == len({r.source for r in few})
    back = C.path_between(C.paths(e).where("source = 'a'"), "d", "a").first()
    assert back.turned and [(h["from"], h["to"]) for h in back.chain] == [("d", "c"), ("c", "b"), ("b", "a")]


def test_clusters(spark):
    m = spark.createDataFrame([("a", "1"), ("b", "1"), ("b", "2"), ("c", "2"), ("e", "3"), ("f", "3"), ("z", "9")] + [(f"n{i}", "big") for i in range(26)], "rd string, value string")
    labels, named = C.clusters(m, ["value"])
    assert {r.rd: r.cluster_id for r in labels.collect()} == {"a": "a", "b": "a", "c": "a", "e": "e", "f": "e"}
    assert {(r.cluster_id, r.value) for r in named.collect()} == {("a", "1"), ("a", "2"), ("e", "3")}


@pytest.mark.parametrize("n, band", [(None, 1), (0, 3), (1, 3), (2, 0), (500, 0), (501, 2)])
def test_bands(spark, n, band):
    c = spark.createDataFrame([("c", "v", 1, n)], "class string, value string, prior int, hits int")
    assert I.selector_rank(c).first().band == band
