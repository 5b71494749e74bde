"""The engine's reads, related targets and proxy families on small data."""

import json

from linkloom.api import Engine
from linkloom.operators import projection as P
from linkloom.operators import related as Rel


def engine(spark):
    cert = lambda k, ip: {"sha256": k, "ip": ip, "not_before": "2024-01-01", "not_after": "2024-12-31", "sans": []}
    scan = lambda h, *keys: (h, json.dumps({"input": h, "type": "domain", "timestamp": "2024-05-01", "tls_certs": {"probes": [cert(k, f"10.0.0.{ord(h[-6])}") for k in keys]}}))
    docs = P.parsed(spark.createDataFrame([scan("www.a.test", "k1"), scan("b.test", "k1", "k2"), scan("c.test", "k2"), scan("d.test", "k9")], "run string, json string"))
    o, e = P.observations(docs), P.edges(docs)
    tiers = spark.createDataFrame([("a.test", 2)], "rd string, tier int")
    return Engine(o, e, P.entities(o, e), tiers, "2024-06-01", P.certificate_names(docs))


def test_reads(spark):
    x = engine(spark)
    assert [(r.b, r.score) for r in x.links("b.test").orderBy("rank").collect()] == [("a.test", 200.0), ("c.test", 200.0)]
    assert x.link("a.test", "b.test").first().strength == "strong" and x.link("a.test", "a.test").count() == 0 and x.link("a.test", "d.test").count() == 0
    path = x.path("a.test", "c.test").first()
    assert path.hops == 2 and [h["to"] for h in path.chain] == ["b.test", "c.test"] and x.path("a.test", "d.test").count() == 0
    assert [r.target for r in x.related("a.test").collect()] == ["b.test", "c.test"]
    page = {r.rd: r for r in x.pool().collect()}
    assert set(page) == {"a.test", "b.test", "c.test", "d.test"} and page["b.test"].connections == 2 and page["a.test"].tier == 2 and page["d.test"].cluster_id is None and page["a.test"].total == 4
    assert [r.rd for r in x.pool(min_links=1, order="name", limit=2, offset=1).collect()] == ["b.test", "c.test"]
    assert [(r.cluster_id, r["size"]) for r in x.clusters().collect()] == [("a.test", 3)] and {r.rd for r in x.cluster("c.test").collect()} == {"a.test", "b.test", "c.test"}
    assert [(r.kind, r.groups) for r in x.selector_kinds().collect()] == [("tls_cert_sha256", 2)]
    assert [tuple(r) for r in x.by_selector("tls_cert_sha256").collect()] == [("k1", 2, "a.test"), ("k1", 2, "b.test"), ("k2", 2, "b.test"), ("k2", 2, "c.test")]
    assert [r.value for r in x.search("K").collect()] == ["k1", "k2", "k9"] and [r.value for r in x.search("b.t").collect()] == ["b.test"]
    assert [(r.entity, r.selectors) for r in x.domain("a.test").collect()] == [("a.test", 1)]
    assert Engine.evidence_catalog()[0] == {"kind": "tls_cert_sha256", "weight": 200.0, "label": "tls cert sha256"}


def test_related_targets(spark):
    doc = {"input": "a.test", "type": "domain", "timestamp": "t", "dns": {"A": ["10.0.0.1"], "NS": ["ns.other.test."]}, "tls_certs": {"probes": [{"cn": "a.test", "sans": ["www.b.test", "x.github.io"]}]}, "subdomains": ["m.a.test"], "ip_details": {"10.0.0.1": {"other_domains_on_ip": ["c.test"]}}}
    docs = P.parsed(spark.createDataFrame([("1", json.dumps(doc))], "run string, json string"))
    found = Rel.related_targets(docs)
    assert {(r.target, r.target_type, r.relation, r.score) for r in found.collect()} == {("10.0.0.1", "ip", "dns_a", 10), ("ns.other.test", "domain", "nameserver", 3), ("b.test", "domain", "tls_san", 7), ("x.github.io", "domain", "tls_san", 7), ("m.a.test", "domain", "subdomain", 7), ("c.test", "domain", "reverse_ip", 9)}
    summary = {r.target: (r.strength, r.auto_expand) for r in Rel.related_summary(found).collect()}
    assert summary == {"10.0.0.1": ("hard", True), "ns.other.test": ("weak", False), "b.test": ("supporting", True), "x.github.io": ("supporting", False), "m.a.test": ("supporting", True), "c.test": ("hard", True)}
    assert [(r.target, r["rank"], r.total) for r in Rel.hard_connections(Rel.related_summary(found), 1).collect()] == [("10.0.0.1", 1, 2)]


def test_proxy_families(spark):
    rules = spark.createDataFrame([(1, "edge", "asn", "13335"), (2, "edge", "ptr", "edge."), (3, "shield", "ptr", "edge."), (4, "soft", "text", "soft")], "seq int, family string, field string, pattern string")
    rows = spark.createDataFrame([("1", "AS13335", "a.edge.test", None, None, None), ("2", None, "x.edge.test", None, None, "soft"), ("3", None, None, None, None, "soft"), ("4", "AS1", "", None, None, None)], "ip string, asn string, ptr string, cert string, network string, text string")
    assert sorted(map(tuple, Rel.proxy_families(rows, rules).collect())) == [("1", "edge", 0.98), ("2", "edge", 0.52)]
