"""Hosts, text, DNS, identifiers and wallets on literal cases."""

import base64
import hashlib

import pytest
from pyspark.sql import functions as F

from linkloom.functions import dns as N
from linkloom.functions import host as H
from linkloom.functions import identifiers as I
from linkloom.functions import text as X
from linkloom.functions import wallets as W


def values(spark, f, items):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(items)], "i int, x string")
    return [r.y for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_hosts(spark):
    raw = ["https://www.Shop.Example.co.uk/x?y#z", "*.a.b.test", "user@host.test:8080/p", "[2001:db8::1]:443", "10.0.0.1", "localhost", "nobody.github.io", None]
    host = ["shop.example.co.uk", "a.b.test", "host.test", "2001:db8::1", "10.0.0.1", "localhost", "nobody.github.io", None]
    assert values(spark, H.host_of, raw) == host
    assert values(spark, H.target_kind, host) == ["domain", "domain", "domain", "ip", "ip", None, "domain", None]
    assert values(spark, H.registrable_domain, host) == ["example.co.uk", "b.test", "host.test", None, None, None, "nobody.github.io", None]
    assert values(spark, H.entity_kind, host) == ["subdomain", "subdomain", "domain", "ip", "ip", None, "domain", None]
    assert values(spark, H.naive_apex, host)[:3] == ["co.uk", "b.test", "host.test"]
    assert values(spark, H.clean_target, ['"https://WWW.a.test/b"', " b.test "]) == ["a.test", "b.test"]


def test_networks(spark):
    ips = ["104.16.0.1", "104.32.0.1", "2606:4700::1", "2607::1", "not an address", "999.1.1.1"]
    df = spark.createDataFrame([(x,) for x in ips], "ip string")
    assert sorted((r.ip, r.net) for r in H.in_networks(df, "ip", H.networks(spark)).collect()) == [("104.16.0.1", "104.16.0.0/13"), ("2606:4700::1", "2606:4700::/32")]
    hosts = spark.range(1).select(F.transform(H.cidr_hosts(F.lit("10.0.0.6/30")), H.ip_text).alias("h")).first().h
    assert hosts == ["10.0.0.4", "10.0.0.5", "10.0.0.6", "10.0.0.7"]


def test_lists(spark):
    assert values(spark, H.generic_email, ["x@godaddy.com", "x@sub.ovh.net", "x@whoisagent.test", "me@own.test", "none", "x@notgodaddy.com"]) == [True, True, True, False, False, False]
    assert values(spark, H.redacted, [None, "", "N/A", "Redacted for Privacy", "Contact Privacy Inc", "Ada L."]) == [True, True, True, True, True, False]
    assert values(spark, H.low_signal_tls, ["*.localhost", "Kubernetes Ingress Controller Fake Certificate", "own.test"]) == [True, True, False]
    assert values(spark, lambda x: H.tier_from_labels(F.split(x, ";")), ["Tier 1", "tier-2;TIER_3", "tier9", "x"]) == [1, 2, None, None]
    assert values(spark, H.noisy_suffix, ["a.github.io", "github.io", "agithub.io"]) == [True, True, False]


def test_markup(spark):
    page = "<html lang='EN-us'><head><title> A &amp; B </title><style>x</style><script>var p='<p>no</p>'</script></head><body><p>One<br>two</p><!-- no --><div>three&nbsp;&lt;4&gt;</div></body></html>"
    assert values(spark, X.html_text, [page]) == ["A & B One two three <4>"]
    assert values(spark, X.html_lang, [page]) == ["en-us"] and values(spark, X.html_title, [page]) == ["A &amp; B"]
    assert values(spark, X.text_hash, ["A  b\n", "a b"]) == [hashlib.sha256(b"a b").hexdigest()] * 2
    named = "caf&eacute; &#8364;5 &hellip; &amp;lt; &NotEqualTilde; &nope; &#x41;&nbsp;z"
    assert values(spark, X.html_text, [named, None, "plain"]) == ["café €5 … &lt; ≂̸ &nope; A z", None, "plain"]


def test_phones(spark):
    assert values(spark, X.normal_phone, ["+49 (30) 901820", "0049 30 901820", "+1 212 555 0123", "+11111111111", "+1234567890", "901820", "+12"]) == ["+4930901820", "+4930901820", None, None, None, None, None]
    assert values(spark, X.phones_in, ["call +49 30 901820 or +49-30-901820, not 12 34 56"]) == [["+4930901820"]]


def test_dns(spark):
    s = values(spark, N.spf, ['"v=spf1 ip4:10.0.0.0/8 ip6:2001:db8::/32 " "include:a.test -include:b.test redirect=c.test ~all"', "v=spf10 x", "hello"])
    assert (s[0].ip4, s[0].ip6, s[0].includes, s[0].redirect, s[0].policy) == (["10.0.0.0/8"], ["2001:db8::/32"], ["a.test", "b.test"], "c.test", "~all") and s[1:] == [None, None]
    d = values(spark, N.dmarc, ["v=DMARC1; p=none; rua=mailto:A@b.test!10m, https://x.test, mailto:c@d.test", "v=DMARC2"])
    assert (d[0].policy, d[0].rua, d[0].ruf) == ("none", ["a@b.test", "c@d.test"], []) and d[1] is None
    c = values(spark, N.caa, ['0 issue "ca.test; account=1; x=2"', "nothing"])
    assert (c[0].flag, c[0].tag, c[0].issuer, c[0].parameters) == (0, "issue", "ca.test", ["account=1", "x=2"]) and c[1] is None
    assert values(spark, N.tenancy_tokens, ["google-site-verification=Abc", "MS=ms1", "x"]) == [["google_site_verification|Abc"], ["microsoft|ms1"], []]
    records = spark.createDataFrame([("a", "v=spf1 include:b include:c -all"), ("b", "v=spf1 include:c include:a -all"), ("c", "v=spf1 redirect=d"), ("d", "v=spf1 include:e"), ("e", "v=spf1 include:f"), ("f", "v=spf1 include:g")], "name string, text string")
    start = spark.createDataFrame([("a",)], "domain string")
    assert {r.name: r.depth for r in N.spf_walk(records, start).collect()} == {"b": 1, "c": 1, "d": 2, "e": 3, "f": 4, "g": 5}
    assert N.spf_walk(records, start, lookups=3).count() == 3 and N.spf_walk(records, start, depth=1).count() == 2
    assert [r.name for r in N.dkim_names(start, ("s1",)).collect()] == ["s1._domainkey.a"]


def test_identifiers(spark):
    digest = hashlib.sha256(b"key").digest()
    b64 = base64.b64encode(digest).decode().rstrip("=")
    assert values(spark, I.normal_hash, [f"SHA256:{b64}", digest.hex().upper(), ":".join(digest.hex()[k : k + 2] for k in range(0, 64, 2))]) == [digest.hex()] * 3
    assert values(spark, I.normal_email, ["mailto:A@B.test?x", "no"]) == ["a@b.test", None]
    assert values(spark, I.normal_guid, ["{12345678-ABCD-1234-abcd-1234567890AB}", "x"]) == ["12345678-abcd-1234-abcd-1234567890ab", None]
    assert values(spark, I.normal_url, ["HTTP://U@H.test:80/", "https://h.test:8443/a?b#c", "h.test"]) == ["http://h.test", "https://h.test:8443/a", None]
    key = base64.b64encode(b"key").decode()
    assert values(spark, I.ssh_fingerprint, [key]) == [f"SHA256:{b64}"]


GOOD = ["1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa", "bc1qw508d6qejxtdg4y5r3zarvary0c5xw7kv8f3t4", "bitcoincash:qpm2qsznhks23z7629mms6s4cwef74vcwvy22gdx6a", "0x5aAeb6053F3E94C9b9A09f33669435E7Ef1BeAed"]


@pytest.mark.parametrize("address", GOOD)
def test_wallet_checksums(address):
    assert W.chain_of(address)
    for k in (len(address) // 2, len(address) - 2):
        flipped = address[:k] + ("q" if address[k] != "q" else "p") + address[k + 1 :]
        assert W.chain_of(flipped) is None


def test_wallets(spark):
    got = values(spark, W.wallets_in, ["pay " + " or ".join(GOOD) + ".", None, "nothing here"])
    assert len(got[0]) == 4 and got[1] == got[2] == []
    assert W.keccak256(b"").hex() == "c5d2460186f7233c927e7db2dcc703c0e500b653ca82273b7bfad8045d85a470"
    df = spark.createDataFrame([(bytearray(b"icon"),)], "b binary")
    assert df.select(W.favicon_mmh3(F.col("b")).alias("h")).first().h == W.murmur3_32(base64.encodebytes(b"icon"))
    assert W.murmur3_32(b"hello, world") == 345750399
