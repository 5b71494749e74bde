"""The walk over nested JSON, and identifiers from documents."""

import json

import pytest
from linkloom.operators import document_walk as W
from linkloom.operators import identifiers as I


def docs(spark, *bodies):
    return spark.createDataFrame([(str(i), b if isinstance(b, str) or b is None else json.dumps(b)) for i, b in enumerate(bodies)], "run string, json string")


def slow(x, path="", place="", left=99):
    """Leaves by recursion."""
    if isinstance(x, (dict, list)):
        if not left:
            return []
        items = x.items() if isinstance(x, dict) else ((None, v) for v in x)
        out = []
        for n, (k, v) in enumerate(items):
            key = k.replace("/", "~1") if k is not None else None
            out += slow(v, f"{path}/{key or '[]'}".lstrip("/"), f"{place}/{key if key is not None else n}".lstrip("/"), left - 1)
        return out
    if x is None:
        return []
    return [(path, place, str(x).lower() if isinstance(x, bool) else str(x))]


BODY = {"a": {"b": [1, {"c": "x", "d/e": True}, [], {}, None, "{}", "null"], "k.x": "y"}, "z": "t", "deep": [[[[["bottom"]]]]], "n": -2}


def test_walk(spark):
    got = sorted((r.path, r.place, r.value) for r in W.walk(docs(spark, BODY, None, "no json", "{}", "[]")).collect())
    assert got == sorted(slow(BODY))


def test_depth(spark):
    for depth in (1, 2, 3):
        got = sorted((r.path, r.place, r.value) for r in W.walk(docs(spark, BODY), depth).collect())
        assert got == sorted(slow(BODY, left=depth))


CASES = [
    ({"dns": {"A": ["8.8.8.8", "10.0.0.1", "not an ip"], "CNAME": "Alias.Own.Test.", "MX": [{"exchange": "mx.own.test"}], "TXT": ["v=spf1", "MS=ms42 google-site-verification=Ab_1"]}},
     {("resolved_ip", "8.8.8.8"), ("dns_alias", "alias.own.test"), ("mx_host", "mx.own.test"), ("dns_txt_token", "microsoft|ms42"), ("dns_txt_token", "google_site_verification|ab_1")}),
    ({"dns": {"A": ["8.8.8.8", "9.9.9.9", "1.1.1.1"]}, "ip_details": {"8.8.8.8": {"cloudflare": True}, "9.9.9.9": {"proxy_family": "front"}, "1.1.1.1": {"cloudflare": False, "proxy_family": ""}}}, {("resolved_ip", "1.1.1.1")}),
    ({"page_metadata": {"gtm_ids": ["GTM-AB12"], "fb_app_id": "77", "social_handles": {"X": ["@Me", "you"]}, "crypto_wallets": {"ETH": ["0xAbC"]}, "phone_numbers": ["+49 30 9182736"], "favicon_mmh3": -12}},
     {("gtm_container", "gtm-ab12"), ("fb_app_id", "77"), ("social_handle", "x|me"), ("social_handle", "x|you"), ("crypto_wallet", "eth|0xAbC"), ("contact_phone", "+49309182736"), ("favicon_mmh3", "-12")}),
    ({"page_metadata": {"meta_tags": {"og:url": "https://A.test/x?q", "twitter:site": "@Us", "other": "no"}, "source_map_leaks": [{"url": "https://cdn.test/a.map"}, "https://b.test/c.map"], "script_assets": ["https://s.test/x.js"]}},
     {("social_url", "https://a.test/x"), ("meta_social_handle", "us"), ("source_map_url", "https://cdn.test/a.map"), ("source_map_host", "cdn.test"), ("source_map_url", "https://b.test/c.map"), ("source_map_host", "b.test"), ("script_asset_url", "https://s.test/x.js"), ("script_asset_host", "s.test")}),
    ({"whois": {"emails": ["Own@er.test", "REDACTED FOR PRIVACY"], "name": "Redacted for Privacy", "nameservers": ["NS1.x.test"]}}, {("registrant_email", "own@er.test"), ("nameserver", "ns1.x.test")}),
    ({"well_known": {"assetlinks": [{"target": {"package_name": "com.own.app", "sha256_cert_fingerprints": ["AA:" * 31 + "AA"]}}], "apple_app_site_association": {"applinks": {"details": [{"appID": "T.com.own"}]}}, "security_txt": {"contact": ["mailto:sec@own.test"]}, "openid_configuration": {"issuer": "https://id.own.test/"}}},
     {("android_package", "com.own.app"), ("android_cert_sha256", "aa" * 32), ("apple_app_id", "t.com.own"), ("contact_email", "sec@own.test"), ("openid_issuer", "https://id.own.test")}),
    ({"email_security": {"bimi": {"record": {"url": "https://b.test/l.svg"}}, "dmarc_report_uris": {"rua": ["mailto:d@r.test"]}, "spf_includes": ["_spf.x.test"]}, "microsoft_tenant": {"tenant_id": "{0a1b2c3d-1111-2222-3333-444455556666}"}},
     {("bimi", "https://b.test/l.svg"), ("dmarc_rua", "d@r.test"), ("spf_include", "_spf.x.test"), ("microsoft_tenant_guid", "0a1b2c3d-1111-2222-3333-444455556666")}),
    ({"mail_client_config": {"autoconfig": [{"parsed": {"incoming": {"hostname": "imap.m.test"}, "domain": "m.test"}, "url": "https://m.test/conf"}]}}, {("mail_client_server", "imap.m.test"), ("mail_client_domain", "m.test"), ("mail_client_url", "https://m.test/conf")}),
    ({"legal_pages": {"pages": [{"url": "/x", "entity_names": ["Own  GmbH"], "vat_ids": ["DE 1"], "normalized_text_hash": "f" * 32, "contact": {"phone": "+4930998877"}}]}}, {("legal_entity", "own gmbh"), ("legal_registration", "de 1"), ("legal_text_hash", "f" * 32), ("legal_phone", "+4930998877")}),
    ({"subdomain_followups": [{"subdomain": "m.own.test", "result": {"dns": {"NS": ["ns.f.test"]}}}], "origin_candidates": {"shodan": {"hits": [{"ip": "9.9.9.9", "hostnames": ["h.x.test"]}]}, "scan": {"hits": [{"ip": "1.1.1.1"}]}}},
     {("subdomain_name", "m.own.test"), ("nameserver", "ns.f.test"), ("provider_ip", "9.9.9.9"), ("provider_hostname", "h.x.test"), ("scan_ip", "1.1.1.1")}),
]


def test_identifiers_of_each_branch(spark):
    found = {}
    for r in W.identifiers(docs(spark, *[b for b, _ in CASES])).collect():
        found.setdefault(int(r.run), set()).add((r.type, r.value))
    for i, (_, want) in enumerate(CASES):
        assert found[i] == want, i


def test_certificates(spark):
    cert = {"sha256": "A" * 64, "spki_sha256": "b" * 64, "sans": ["*.San.test", "x.test"], "issuer_cn": "Some CA", "not_before": "2024-01-01T00:00:00Z", "not_after": "2024-04-01T00:00:00Z"}
    body = {"tls_certs": {"probes": [cert, {"sha256": "c" * 64, "error": "timeout"}, {"sha256": "d" * 64}]}, "crt_sh": {"certs": [{"issuer": "CT CA", "not_before": "2023-01-01"}]}}
    got = {(r.type, r.value, r.source, r.first_seen) for r in W.identifiers(docs(spark, body)).collect()}
    day = "2024-01-01T00:00:00Z"
    assert got == {
        ("tls_sha256", "a" * 64, "tls_certs", day), ("tls_spki_sha256", "b" * 64, "tls_certs", day), ("certificate_san", "san.test", "tls_certs", day), ("certificate_san", "x.test", "tls_certs", day),
        ("cert_issuer_not_before", f"some ca|{day.lower()}", "tls_certs", day), ("tls_sha256", "d" * 64, "tls_certs", None), ("cert_issuer_not_before", "ct ca|2023-01-01", "crt_sh", "2023-01-01"),
    }


def test_state_feeds_comparison(spark):
    page = lambda host, ts, *ids: {"input": host, "timestamp": ts, "page_metadata": {"gtm_ids": list(ids), "ga_ids": ["UA-1"]}}
    d = docs(spark, page("www.A.test", "2024-01-01", "GTM-OLD"), page("a.test", "2024-02-01", "GTM-X"), page("b.test", "2024-01-05", "GTM-X", "GTM-OLD"), {"timestamp": "2024"})
    state = W.identifier_state(d)
    assert {(r.domain, r.type, r.value) for r in state.collect()} == {("a.test", "gtm_container", "gtm-x"), ("a.test", "ga_property", "ua-1"), ("b.test", "gtm_container", "gtm-x"), ("b.test", "gtm_container", "gtm-old"), ("b.test", "ga_property", "ua-1")}
    freq = I.frequency(state)
    assert {(r.value, r.domains) for r in freq.collect()} == {("gtm-x", 2), ("ua-1", 2), ("gtm-old", 1)}
    pair = I.compare(state, freq).collect()
    assert [(r.a, r.b, r.n_shared) for r in pair] == [("a.test", "b.test", 2)]


def test_issuance(spark):
    cert = lambda when: {"tls_certs": {"probes": [{"sha256": "e" * 64, "issuer_cn": "CA|x", "not_before": when}]}}
    got = W.issuance(docs(spark, {"input": "a.test", **cert("2024-01-01T10:00:00Z")}, {"input": "b.test", **cert("nonsense")})).collect()
    assert [(r.domain, r.issuer, str(r.issued)) for r in got] == [("a.test", "ca|x", "2024-01-01 10:00:00")]


@pytest.mark.parametrize("rows", [[], [None, "[1, 2]", "7"]])
def test_nothing_to_find(spark, rows):
    assert W.identifiers(docs(spark, *rows)).count() == 0
    assert W.identifier_state(docs(spark, *rows)).count() == 0
