"""Projection of scan documents, sources and incremental maintenance."""

import json
import uuid

import pytest
from pyspark.sql import functions as F

from linkloom.constants import Config
from linkloom.operators import graph_build as G
from linkloom.operators import links as L
from linkloom.operators import projection as P
from linkloom.sources import documents as Docs
from linkloom.sources import targets as T
from linkloom.storage import shared_folder
from linkloom.streaming import maintenance as M

AS_OF = "2024-06-01"
CERT = {"ip": "10.1.1.1", "sans": ["*.own.test"], "not_before": "2024-01-01", "not_after": "2024-12-31", "sha256": "AA:BB", "spki_sha256": "CC"}


def parse(spark, *docs):
    return P.parsed(spark.createDataFrame([(str(i), json.dumps(d)) for i, d in enumerate(docs)], "run string, json string"))


def scan(host, **more):
    return {"input": host, "type": "domain", "timestamp": "2024-05-01T00:00:00", **more}


def graph(spark, *docs):
    d = parse(spark, *docs)
    o, e = P.observations(d), P.edges(d)
    return o, e, P.entities(o, e), P.certificate_names(d)


def test_certificate_on_two_domains(spark):
    o, _, n, sans = graph(spark, scan("a.test", non_cf_tls_certs=[CERT]), scan("b.test", tls_certs={"probes": [CERT]}))
    links = {(r.a, r.b): r for r in L.links(o, n, G.selectors(o, sans), AS_OF).collect()}
    link = links[("a.test", "b.test")]
    assert link.strength == "strong" and link.n_shared == 3
    assert [r.value for r in o.where("kind = 'tls_cert_sha256'").collect()] == ["aabb"] * 2


def test_certificate_on_subdomains_links_the_apexes(spark):
    nested = lambda h: scan(h, subdomain_followups=[{"subdomain": f"x.{h}", "status": "ok", "result": scan(f"x.{h}", tls_cert=CERT)}])
    o, e, n, _ = graph(spark, nested("a.test"), nested("b.test"))
    assert {(r.a, r.b) for r in L.links(o, n, G.selectors(o), AS_OF).collect()} == {("a.test", "b.test"), ("b.test", "a.test")}
    assert ("x.a.test", "a.test") in {(r.src, r.dst) for r in e.where("kind = 'subdomain_of'").collect()}


def test_addresses(spark):
    doc = lambda h: scan(h, dns={"A": ["10.2.2.2"], "NS": ["NS1.cloudflare.com."]}, ip_details={"10.2.2.2": {"sources": ["dns_a"], "asn_info": {"asn": "AS13335", "network_cidr": "10.2.0.0/16"}}})
    o, e, n, _ = graph(spark, doc("a.test"), doc("b.test"), doc("c.test"))
    kept = G.selectors(o)
    assert not kept.where("attributing AND kind IN ('asn', 'nameserver')").count()
    assert L.links(o, n, kept, AS_OF).count() == 0  # what is on an address links no domains
    side = L.ip_sides(e, n)
    assert L.shared_ips(side, side.select("value"), AS_OF).count() == 0
    assert {(r.degree, r.value) for r in L.shared_ips(side, side.select("value").limit(0), AS_OF).collect()} == {(3, "10.2.2.2")}


def test_every_block(spark):
    page = {"google_analytics": ["UA-1-1"], "adsense_publisher_ids": ["ca-pub-1"], "favicon_md5": "m", "homepage_html_hash": "h", "social_handles": {"x": ["me"]}, "site_verifications": {"google": ["g"]}, "phone_numbers": ["+4930901820"], "crypto_wallets": {"bitcoin": ["1A"]}}
    legal = {"pages": [{"url": "https://a.test/imprint", "entity_names": ["Own GmbH"], "registration_ids": ["HRB 1"], "emails": ["Me@a.test", "x@godaddy.com"]}, {"url": "https://a.test/privacy", "entity_names": ["Vendor"]}]}
    doc = scan("a.test", page_metadata=page, legal_pages=legal, whois={"emails": ["Owner@a.test", "redacted for privacy"], "name": ["N/A", "Ada"], "nameservers": ["NS1.a.test."]}, spf_origins=[{"ip": "10.0.0.1"}, {"cidr": "10.0.0.0/8"}],
               historical_dns={"records": [{"rrtype": "A", "rdata": "10.9.9.9", "first_seen": "2020", "last_seen": "2021"}, {"rrtype": "MX", "rdata": "x"}]}, ssh_host_keys={"probes": [{"ip": "10.1.1.1", "fingerprint_sha256": "k"}]},
               cert_transparency={"certs": [{"id": "1", "sans": ["s.a.test"]}], "cross_domain_sans": ["other.test"]}, subdomains=["mail.a.test"], tls_certs={"probes": [{**CERT, "error": "refused"}]})
    o, e, n, _ = graph(spark, doc)
    got = {(r.entity, r.kind, r.value, r.source) for r in o.collect()}
    want = {("tracking_id", "ga_property|UA-1-1"), ("tracking_id", "adsense_publisher|pub-1"), ("favicon_md5", "m"), ("html_hash", "h"), ("social_handle", "x|me"), ("site_verification", "google|g"), ("contact_phone", "+4930901820"), ("crypto_wallet", "bitcoin|1A"), ("legal_entity", "own gmbh"), ("legal_registration", "hrb 1"), ("contact_email", "me@a.test")}
    assert {("a.test", k, v, "self_scan") for k, v in want} <= got
    assert {("a.test", "contact_email", "owner@a.test", "whois"), ("a.test", "legal_entity", "Ada", "whois"), ("a.test", "nameserver", "ns1.a.test", "whois"), ("a.test", "spf_origin", "10.0.0.1", "spf"), ("a.test", "spf_origin", "10.0.0.0/8", "spf"), ("10.1.1.1", "ssh_fp", "k", "self_scan"), ("a.test", "tls_san", "s.a.test", "crtsh"), ("a.test", "tls_san", "other.test", "crtsh")} <= got
    assert not [x for x in got if x[2] in ("Vendor", "vendor", "x@godaddy.com", "redacted for privacy", "N/A") or x[1] == "tls_cert_sha256"]
    assert ("a.test", "10.9.9.9", "historical_dns", "2020", "2021") in {(r.src, r.dst, r.source, r.first_seen, r.last_seen) for r in e.collect()}
    assert {r.value: r.kind for r in n.collect()}["mail.a.test"] == "subdomain"


def test_other_shapes_give_no_rows(spark):
    o, e, _, _ = graph(spark, scan("a.test", dns=[1, 2], page_metadata="x", ip_details=None), {"type": "domain"}, scan("b.test"))
    assert o.count() == 0 and e.count() == 0
    bad = P.parsed(spark.createDataFrame([("1", "not json"), ("2", None)], "run string, json string"))
    assert bad.count() == 0


def test_child_tables(spark):
    d = parse(spark, scan("a.test", tls_certs={"probes": [CERT, CERT]}, dns={"A": ["1.1.1.1", "1.1.1.1"], "TXT": ["x"]}, page_metadata={"gtm_ids": ["GTM-1"]}, crt_sh={"subdomains": ["x.a.test"], "cross_domain_sans": ["o.test"]}))
    t = P.child_tables(d)
    assert t["tls_certs"].count() == 1 and t["subdomains"].count() == 1 and t["cross_sans"].count() == 1
    assert {tuple(r)[1:] for r in t["dns_records"].collect()} == {("A", "1.1.1.1"), ("TXT", "x")}
    assert {tuple(r)[1:] for r in t["tracking_ids"].collect()} == {("gtm_container", "GTM-1")}


# ---- sources ----


def test_target_files(spark, tmp_path):
    (tmp_path / "t.csv").write_text("﻿https://www.A.test/x,1\nb.test,2\n\nA.test,3\n10.0.0.1,4\nnot a host,5\n", encoding="utf-8")
    rows = T.read_csv(spark, str(tmp_path))
    assert [r.target for r in rows.orderBy("row").collect()] == ["A.test", "b.test", "A.test", "10.0.0.1", "not a host"]
    assert [tuple(r) for r in T.normalized(rows).orderBy("upload_row").collect()] == [(1, "a.test", "domain"), (2, "b.test", "domain"), (3, "10.0.0.1", "ip")]
    assert T.first_seen(rows).count() == 4


def test_documents_in_a_folder(spark, tmp_path):
    (tmp_path / "one.json").write_text(json.dumps(scan("a.test"), indent=1))
    got = Docs.read_directory(spark, str(tmp_path)).collect()
    assert [r.run for r in got] == ["one"] and P.parsed(spark.createDataFrame(got)).first().d.input == "a.test"
    fields = spark.createDataFrame([("r", 'ke"y', "1", 1), ("r", "input", '"x.test"', 1), ("r", "input", '"y.test"', 2)], "run string, key string, value string, seq int")
    assert json.loads(Docs.from_fields(fields).first().json) == {'ke"y': 1, "input": "y.test"}


def test_sinks(spark, tmp_path):
    a = spark.createDataFrame([("1", "x"), ("2", "y")], "run string, v string")
    b = spark.createDataFrame([("2", "z"), ("3", "w"), ("3", "w")], "run string, v string")
    assert sorted(map(tuple, Docs.replace_runs(a, b).collect())) == [("1", "x"), ("2", "z"), ("3", "w"), ("3", "w")]
    assert sorted(map(tuple, Docs.append_once(a, b, ["run"]).collect())) == [("1", "x"), ("2", "y"), ("3", "w")]
    edges = spark.createDataFrame([("a", "b<", 400.0)], "a string, b string, score double")
    nodes = spark.createDataFrame([("a", "domain")], "node string, kind string")
    assert [r.value for r in Docs.graph_elements(nodes, edges).collect()] == ['<node id="a" label="a" kind="domain"/>', '<edge id="a--b&lt;" source="a" target="b&lt;" weight="8"/>']
    Docs.write_pairs(edges.withColumn("strength", F.lit("strong")), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out" / "summary")).first().pairs == 1


# ---- maintenance ----


@pytest.mark.parametrize("state, step", [((None, None, False, 0), "reconcile"), ((100000.0, None, True, 0), "clusters"), ((100000.0, 100500.0, True, 3), "incremental"), ((100000.0, 100500.0, True, 0), "idle"), ((1.0, 100500.0, False, 3), "reconcile"), ((100000.0, 99000.0, True, 3), "clusters")])
def test_next_step(state, step):
    assert M.next_step(M.MaintenanceState(101000.0, *state)) == step


def rows(spark, *items):
    return spark.createDataFrame([(e, e.split(".", e.count(".") - 1)[-1], k, v, "s", a, b) for e, k, v, a, b in items], M.OBSERVED)


def test_store(spark):
    store = M.GraphStore(spark, f"{shared_folder(spark)}/{uuid.uuid4().hex}", Config(queue=3))
    one = rows(spark, ("a.test", "tls_cert_sha256", "c", "2024-05-02", "2024-05-03"), ("b.test", "tls_cert_sha256", "c", "2024-05-02", "2024-05-03"))
    assert store.queue().count() == 0 and store.observations().count() == 0
    store.apply(one, 0)
    store.apply(one, 0)
    assert sorted(r.domain for r in store.queue().collect()) == ["a.test", "b.test"] and store.observations().count() == 2
    links = M.all_links(store, AS_OF, {"tls_cert_sha256": 200.0})
    links = spark.createDataFrame(links.collect(), links.schema)
    store.cover(0)
    assert store.queue().count() == 0
    store.apply(rows(spark, ("c.test", "tls_cert_sha256", "c", "2024-01-01", None), ("a.test", "tls_cert_sha256", "c", "2024-05-01", "2024-05-09")), 1)
    again = sorted(map(tuple, M.rescore(links, store, store.queue(), AS_OF, {"tls_cert_sha256": 200.0}).collect()))
    assert again == sorted(map(tuple, M.all_links(store, AS_OF, {"tls_cert_sha256": 200.0}).collect())) and len(again) == 6
    assert [(r.first_seen, r.last_seen) for r in store.observations().where("entity = 'a.test'").collect()] == [("2024-05-01", "2024-05-09")]
    store.apply(rows(spark, *[(f"n{i}.test", "tls_cert_sha256", "d", None, None) for i in range(5)]), 2)
    # More than the queue is meant for: none is left out, and a reconcile is due.
    assert {r.domain for r in store.queue().collect()} == {"a.test", "b.test", "c.test", *(f"n{i}.test" for i in range(5))}
    assert M.next_step(store.state(10.0, 0.0, 0.0), store.cfg) == "reconcile"
