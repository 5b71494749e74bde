"""Sources, sinks, projection and identifier spelling over the test tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dns as N
from ..functions import identifiers as I
from ..operators import document_walk as W
from ..operators import identifiers as Ids
from ..operators import projection as P
from ..sources import documents as Docs
from ..sources import finalize as Fin
from ..sources import targets as T
from ..storage import new_path
from . import driver_graph as D
from .registry import query

_HOST = r"regexp_replace(regexp_replace(regexp_replace(lower(url), '^[a-z][a-z0-9+.-]*://', ''), '[/?#].*$', ''), '^www\.', '')"


@query(f"SELECT CAST(row_number() OVER (ORDER BY r, target) AS BIGINT) AS upload_row, target, 'domain' AS target_type FROM (SELECT {_HOST} AS target, min(page_id) AS r FROM pages GROUP BY 1)")
def target_list(spark, sf):
    return T.normalized(D.table(spark, sf, "pages").select(F.col("page_id").alias("row"), F.col("url").alias("target")))


@query("SELECT target, CASE WHEN c_acctbal > 9000 THEN 1 WHEN c_acctbal > 8000 THEN 2 ELSE 0 END AS tier, CAST((row_number() OVER (ORDER BY CASE WHEN c_acctbal > 9000 THEN 1 WHEN c_acctbal > 8000 THEN 2 END NULLS LAST, target) - 1) // 250 AS INTEGER) AS batch FROM (SELECT c_name AS target, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 10 = 0))")
def sweep_batches(spark, sf):
    c = D.table(spark, sf, "customer")
    known = c.join(D.table(spark, sf, "orders").where("o_orderkey % 10 = 0"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select(F.col("c_name").alias("target"))
    tiers = c.where("c_acctbal > 8000").select(F.col("c_name").alias("target"), F.when(F.col("c_acctbal") > 9000, 1).otherwise(2).alias("tier"))
    return T.batches(c.select(F.col("c_name").alias("target")), known, tiers).fillna(0, ["tier"])


@query(f"WITH p AS (SELECT page_id, {_HOST} AS h, page_id % 4 AS k FROM pages) SELECT h AS domain, array_to_string(list_sort(list_distinct(flatten(list(['tier ' || (1 + page_id % 3), 'news'])))), ',') AS labels, CAST(min(1 + page_id % 3) AS INTEGER) AS tier FROM p WHERE k <> 0 GROUP BY h")
def channel_feed(spark, sf):
    p = D.table(spark, sf, "pages")
    k = F.col("page_id") % 4
    channels = p.select(
        F.col("page_id").alias("id"), F.when(k == 0, F.array(F.lit("Group"))).otherwise(F.array(F.lit("x"), F.lit("Website"))).alias("types"), F.col("url").alias("name"), F.array(F.lit("not a host")).alias("aliases"),
        F.array(F.lit("https://www.youtube.com/c/1"), F.col("url")).alias("refs"), F.array(F.concat(F.lit("tier "), (F.col("page_id") % 3 + 1).cast("string")), F.lit("news")).alias("labels"),
    )
    return T.channel_domains(channels).withColumn("labels", F.array_join("labels", ","))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS run, o_orderstatus AS input, 'domain' AS type, o_orderpriority AS timestamp FROM orders")
def documents_from_fields(spark, sf):
    o = D.table(spark, sf, "orders")
    field = lambda key, value, seq: F.struct(F.lit(key).alias("key"), value.alias("value"), F.lit(seq).alias("seq"))
    quoted = F.concat(F.lit('"'), "o_orderstatus", F.lit('"'))
    each = F.explode(F.array(field("input", F.lit('"old"'), 1), field("input", quoted, 2), field("size", F.lit("3"), 1)))
    rows = o.select(F.col("o_orderkey").cast("string").alias("run"), each.alias("f")).select("run", "f.*")
    heads = o.select(F.col("o_orderkey").cast("string").alias("run"), F.lit("none").alias("input"), F.lit("domain").alias("type"), F.col("o_orderpriority").alias("timestamp"))
    return Docs.hydrated(Docs.from_fields(rows), heads).select("run", "input", "type", "timestamp")


@query("SELECT CAST(o_custkey AS VARCHAR) AS run, o_orderkey AS seq, o_totalprice AS value FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1")
def field_upsert(spark, sf):
    o = D.table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("run"), F.col("o_orderkey").alias("seq"), F.col("o_totalprice").alias("value"))
    return Docs.upsert(o.where("seq % 2 = 0"), o.where("seq % 2 <> 0"), ["run"], "seq")


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'new' ELSE 'old' END AS a, 'kept' AS b FROM customer")
def payload_merge(spark, sf):
    old = F.create_map(F.lit("a"), F.lit("old"), F.lit("b"), F.lit("kept"))
    new = F.when(F.col("c_custkey") % 2 == 0, F.create_map(F.lit("a"), F.lit("new"))).otherwise(F.create_map(F.lit("c"), F.lit("x")))
    return D.table(spark, sf, "customer").select("c_custkey", Docs.merged_payload(old, new).alias("m")).select("c_custkey", F.element_at("m", "a").alias("a"), F.element_at("m", "b").alias("b"))


def order_documents(spark, sf):
    """A scan document for each order: its lines as addresses, certificates and
    tags of the host o<order>.c<customer>.test. Lines are dealt by order as they
    are, before certificates are written out."""
    lines = D.lines(spark, sf).repartition("entity")
    ip = F.concat_ws(".", F.lit("10"), (F.col("l_suppkey") % 250).cast("string"), F.substring("day", 6, 2).cast("int").cast("string"), F.lit("1"))
    cert = F.struct(ip.alias("ip"), F.sha2(F.concat_ws("|", "l_partkey", F.substring("day", 1, 7)), 256).alias("sha256"), F.array(F.concat(F.lit("*.p"), F.col("l_partkey").cast("string"), F.lit(".test"))).alias("sans"), F.col("day").alias("not_before"), F.col("day").alias("not_after"))
    host = F.concat(F.lit("o"), F.col("entity"), F.lit(".c"), F.col("rd"), F.lit(".test"))
    doc = lines.groupBy("entity", "rd").agg(F.array_sort(F.collect_set(ip)).alias("A"), F.collect_list(cert).alias("probes"), F.array_sort(F.collect_set(F.concat(F.lit("GTM-"), F.col("l_suppkey").cast("string")))).alias("gtm"), F.max("day").alias("ts"))
    body = F.struct(host.alias("input"), F.lit("domain").alias("type"), F.col("ts").alias("timestamp"), F.struct("A", F.array(F.lit("NS1.own.test.")).alias("NS")).alias("dns"), F.struct("probes").alias("tls_certs"), F.struct(F.col("gtm").alias("gtm_ids")).alias("page_metadata"))
    return doc.select(F.col("entity").alias("run"), F.to_json(body).alias("json"))


_DOCS = f"""{D.SQL_LINES}, ln AS (SELECT *, 'o' || entity || '.c' || rd || '.test' AS host, '10.' || CAST(s AS BIGINT) % 250 || '.' || CAST(substr(day, 6, 2) AS INTEGER) || '.1' AS ip, max(day) OVER (PARTITION BY entity) AS ts FROM li)"""


@query(f"""WITH {_DOCS} SELECT host AS entity, kind, value, source, min(f) AS first_seen, max(l) AS last_seen FROM (
 SELECT host, 'tls_cert_sha256' AS kind, sha256(p || '|' || substr(day, 1, 7)) AS value, 'self_scan' AS source, day AS f, day AS l FROM ln UNION ALL SELECT host, 'tls_san', 'p' || p || '.test', 'self_scan', day, day FROM ln
 UNION ALL SELECT host, 'tracking_id', 'gtm_container|GTM-' || s, 'self_scan', ts, ts FROM ln UNION ALL SELECT host, 'nameserver', 'ns1.own.test', 'dns', ts, ts FROM ln) GROUP BY ALL""")
def document_observations(spark, sf):
    return P.observations(P.parsed(order_documents(spark, sf))).select("entity", "kind", "value", "source", "first_seen", "last_seen")


@query(f"""WITH {_DOCS} SELECT host AS src, ip AS dst, 'resolves_to' AS kind, min(source) AS source, min(ts) AS first_seen, max(ts) AS last_seen FROM (SELECT host, ip, ts, unnest(['dns_a', 'tls']) AS source FROM ln) GROUP BY host, ip
 UNION ALL SELECT host, 'c' || rd || '.test', 'subdomain_of', 'dns', min(ts), max(ts) FROM ln GROUP BY host, rd""")
def document_edges(spark, sf):
    return P.edges(P.parsed(order_documents(spark, sf)))


@query(f"WITH {_DOCS} SELECT DISTINCT entity AS run, sha256(p || '|' || substr(day, 1, 7)) AS sha256, ip FROM ln")
def document_certificates(spark, sf):
    return P.child_tables(P.parsed(order_documents(spark, sf)))["tls_certs"].select("run", "sha256", "ip").distinct()


def registered_documents(spark, sf):
    """A document for each order: what is registered, seen in the past and found
    by scans for the host o<order>.c<customer>.test."""
    key, cust = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    day, at = F.col("o_orderdate").cast("string"), lambda first: F.concat(F.lit(first), (F.col("o_custkey") % 200).cast("string"))
    hit = lambda ip, **more: F.struct(F.array(F.struct(ip.alias("ip"), *[v.alias(k) for k, v in more.items()])).alias("hits"))
    body = F.struct(
        F.concat(F.lit("o"), key, F.lit(".c"), cust, F.lit(".test")).alias("input"), F.lit("domain").alias("type"), day.alias("timestamp"),
        F.struct(F.array(F.struct(F.lit("A").alias("rrtype"), at("8.8.1.").alias("rdata"), day.alias("first_seen"), day.alias("last_seen"))).alias("records")).alias("historical_dns"),
        F.array(F.struct(at("9.9.9.").alias("ip"))).alias("spf_origins"),
        F.struct(F.lit("Registrar").alias("registrar"), F.array(F.concat(F.lit(" Owner"), cust, F.lit("@x.test"))).alias("emails"), F.array(F.concat(F.lit("Name "), cust)).alias("name"), F.array(F.lit("NS1.own.test."), F.lit("ns1.own.test")).alias("nameservers")).alias("whois"),
        F.struct(F.md5(cust).alias("favicon_md5"), F.lit("en").alias("html_lang"), F.col("o_orderpriority").alias("cms_generator")).alias("page_metadata"), F.struct(F.lit("v=DMARC1").alias("dmarc")).alias("email_security"),
        F.struct(hit(at("7.7.7."), cn=F.lit("x.test"), sha256=F.sha2(key, 256)).alias("scan"), hit(at("6.6.6."), port=F.lit(8443), asn=F.lit("AS64500"), org=F.col("o_clerk")).alias("censys")).alias("origin_candidates"),
    )
    clerk = F.concat(F.lit("Clerk#"), (F.col("o_orderkey") % 37).cast("string"))
    return D.table(spark, sf, "orders").withColumn("o_clerk", clerk).select(key.alias("run"), F.to_json(body).alias("json"))


@query("""WITH o AS (SELECT CAST(o_orderkey AS VARCHAR) AS run, CAST(o_custkey AS VARCHAR) AS c, CAST(o_custkey % 200 AS VARCHAR) AS i, 'Clerk#' || (o_orderkey % 37) AS clerk, o_orderpriority AS p FROM orders)
 SELECT 'scan_hits' AS fact, run, 'gcp|7.7.7.' || i || '|443|' || sha256(run) AS value FROM o UNION ALL SELECT 'provider_hits', run, 'censys|6.6.6.' || i || '|8443|64500|' || clerk FROM o
 UNION ALL SELECT 'historical_dns', run, 'A|8.8.1.' || i FROM o UNION ALL SELECT 'spf_origins', run, '9.9.9.' || i FROM o UNION ALL SELECT 'registrant_emails', run, 'owner' || c || '@x.test' FROM o
 UNION ALL SELECT 'registrant_names', run, 'Name ' || c FROM o UNION ALL SELECT 'nameservers', run, 'ns1.own.test' FROM o UNION ALL SELECT 'favicons', run, md5(c) FROM o UNION ALL SELECT 'page_metadata', run, 'en|' || p || '|v=DMARC1' FROM o
 UNION ALL SELECT 'discovered_targets', run, unnest(['historical_dns|8.8.1.' || i || '|8', 'whois_nameserver|ns1.own.test|3', 'spf|9.9.9.' || i || '|4', 'provider_hit|6.6.6.' || i || '|8', 'scan_hit|7.7.7.' || i || '|9']) FROM o""")
def finalized_documents(spark, sf):
    """All documents in two batches: the first delivered twice, and some runs of
    it again in the second, which then counts for them."""
    store = Fin.DocumentStore(spark, new_path(spark, "documents"))
    docs = registered_documents(spark, sf)
    store.save(docs.where("CAST(run AS BIGINT) % 3 < 2"), 0)
    store.save(docs.where("CAST(run AS BIGINT) % 3 < 2"), 0)
    store.save(docs.where("CAST(run AS BIGINT) % 3 > 0"), 1)
    shown = {
        "scan_hits": ("scan_type", "ip", "port", "sha256"), "provider_hits": ("provider", "ip", "port", "asn", "org"), "historical_dns": ("rrtype", "rdata"), "spf_origins": ("ip",), "registrant_emails": ("email",), "registrant_names": ("name",),
        "nameservers": ("nameserver",), "favicons": ("md5",), "page_metadata": ("html_lang", "cms_generator", "dmarc"), "discovered_targets": ("relation", "target", "score"),
    }
    facts = [store.read(t).select(F.lit(t).alias("fact"), "run", F.concat_ws("|", *[F.col(c).cast("string") for c in cols]).alias("value")) for t, cols in shown.items()]
    return reduce(DataFrame.unionByName, facts)


def nested_documents(spark, sf):
    """order_documents, one or more for a customer, with more branches: handles,
    wallets, app links inside lists of objects, a follow-up, legal pages."""
    docs = order_documents(spark, sf).join(D.table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("run"), "o_custkey", "o_orderpriority", F.concat(F.lit("Clerk#"), (F.col("o_orderkey") % 37).cast("string")).alias("o_clerk")), "run")
    cust, clerk = F.col("o_custkey").cast("string"), F.col("o_clerk")
    more = F.struct(
        F.concat(F.lit("www.c"), cust, F.lit(".test")).alias("input"),
        F.struct(F.array(F.concat(F.lit("8.8."), (F.col("o_custkey") % 200).cast("string"), F.lit(".8")), F.lit("10.0.0.1")).alias("A"), F.array(F.concat(F.lit("google-site-verification="), clerk)).alias("TXT")).alias("dns"),
        F.struct(F.create_map(F.lit("Mastodon"), F.array(F.concat(F.lit("@"), clerk))).alias("social_handles"), F.create_map(F.lit("BTC"), F.concat(F.lit("bc1"), clerk)).alias("crypto_wallets")).alias("page_metadata"),
        F.struct(F.array(F.struct(F.struct(F.concat(F.lit("app."), F.lower(F.substring("o_orderpriority", 3, 20))).alias("package_name"), F.array(F.upper(F.sha2(clerk, 256))).alias("sha256_cert_fingerprints")).alias("target"))).alias("assetlinks")).alias("well_known"),
        F.struct(F.array(F.struct(F.lit("/imprint").alias("url"), F.struct(F.array(clerk).alias("company_names")).alias("owner"))).alias("pages")).alias("legal_pages"),
        F.array(F.struct(F.concat(F.lit("mail.c"), cust, F.lit(".test")).alias("subdomain"), F.struct(F.struct(F.array(F.concat(F.lit("MX.c"), cust, F.lit(".test."))).alias("NS")).alias("dns")).alias("result"))).alias("subdomain_followups"),
    )
    merged = F.concat(F.regexp_replace(F.to_json(more), r"\}$", ","), F.lit('"timestamp":"'), F.get_json_object("json", "$.timestamp"), F.lit('","tls_certs":'), F.get_json_object("json", "$.tls_certs"), F.lit("}"))
    return docs.select("run", merged.alias("json"))


_STATE = f"""{D.SQL_LINES}, last AS (SELECT entity, rd, max(day) AS ts FROM li GROUP BY entity, rd QUALIFY row_number() OVER (PARTITION BY rd ORDER BY max(day) DESC, entity DESC) = 1),
 o AS (SELECT last.*, 'c' || rd || '.test' AS domain, 'Clerk#' || (o_orderkey % 37) AS k, CAST(rd AS BIGINT) AS n, lower(substr(o_orderpriority, 3, 20)) AS p FROM last JOIN orders ON CAST(o_orderkey AS VARCHAR) = entity),
 st AS (SELECT DISTINCT domain, type, tier, category, value FROM (
  SELECT domain, 'resolved_ip' AS type, 'tier_2' AS tier, 'infrastructure' AS category, '8.8.' || (n % 200) || '.8' AS value FROM o
  UNION ALL SELECT domain, 'dns_txt_token', 'tier_3', 'dns', 'google_site_verification|' || regexp_extract(lower(k), '^[a-z0-9._-]+') FROM o
  UNION ALL SELECT domain, 'social_handle', 'tier_3', 'social', 'mastodon|' || lower(k) FROM o UNION ALL SELECT domain, 'crypto_wallet', 'tier_1', 'identity', 'btc|bc1' || k FROM o
  UNION ALL SELECT domain, 'android_package', 'tier_2', 'identity', 'app.' || p FROM o UNION ALL SELECT domain, 'android_cert_sha256', 'tier_1', 'identity', sha256(k) FROM o
  UNION ALL SELECT domain, 'legal_entity', 'tier_4', 'legal', lower(k) FROM o UNION ALL SELECT domain, 'subdomain_name', 'tier_4', 'dns', 'mail.c' || rd || '.test' FROM o
  UNION ALL SELECT domain, 'nameserver', 'tier_4', 'nameserver', 'mx.c' || rd || '.test' FROM o
  UNION ALL SELECT domain, 'tls_sha256', 'tier_1', 'tls', sha256(li.p || '|' || substr(day, 1, 7)) FROM o JOIN li USING (entity) UNION ALL SELECT domain, 'certificate_san', 'tier_4', 'tls', 'p' || li.p || '.test' FROM o JOIN li USING (entity)))"""


@query(f"WITH {_STATE} SELECT domain, type, tier, category, value FROM st")
def document_identifiers(spark, sf):
    """Identifiers of the newest document of every customer."""
    return W.identifier_state(nested_documents(spark, sf)).select("domain", "type", "tier", "category", "value")


@query(f"WITH {_STATE}, f AS (SELECT type, category, value, count(DISTINCT domain) AS domains FROM st GROUP BY type, category, value) SELECT type, value, domains FROM f WHERE domains > 1")
def document_frequency(spark, sf):
    """How many customers hold each identifier of their newest documents."""
    found = Ids.frequency(W.identifier_state(nested_documents(spark, sf)))
    return found.where("domains > 1").select("type", "value", "domains")


@query("""SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'ab12ab12ab12ab12' WHEN 1 THEN 'me@own.test' WHEN 2 THEN '+4930123' || (1000 + c_custkey) WHEN 3 THEN 'https://host.test:8443/a/b' WHEN 4 THEN 'mx.own.test' ELSE 'some value' END AS value FROM customer""")
def identifier_spelling(spark, sf):
    k, key = F.col("c_custkey") % 6, (F.col("c_custkey") + 1000).cast("string")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("tls_cert_sha256", "whois_email", "contact_phone", "rel_me", "nameserver", "other")]), (k + 1).cast("int"))
    raw = F.when(k == 0, "SHA256:AB:12:ab:12:AB:12:ab:12").when(k == 1, "mailto:Me@Own.test?subject=x").when(k == 2, F.concat(F.lit("0049 30 123-"), key)).when(k == 3, "HTTPS://user@Host.test:8443/a/b?q=1#f").when(k == 4, "MX.own.test.").otherwise("  Some \n value ")
    return D.table(spark, sf, "customer").select("c_custkey", I.normal_value(kind, raw).alias("value"))


@query("WITH RECURSIVE w(domain, name, depth) AS (SELECT CAST(c_custkey AS VARCHAR), CAST(c_custkey AS VARCHAR), 0 FROM customer UNION ALL SELECT domain, CAST(CAST(name AS BIGINT) // 2 AS VARCHAR), depth + 1 FROM w WHERE depth < 5 AND CAST(name AS BIGINT) > 1) SELECT domain, name, min(depth) AS depth FROM w WHERE depth > 0 AND name <> domain GROUP BY domain, name")
def spf_include_walk(spark, sf):
    key = F.col("c_custkey")
    c = D.table(spark, sf, "customer")
    records = c.select(key.cast("string").alias("name"), F.when(key > 1, F.concat(F.lit("v=spf1 include:"), F.floor(key / 2).cast("string"), F.lit(" -all"))).otherwise("v=spf1 -all").alias("text"))
    return N.spf_walk(records, c.select(key.cast("string").alias("domain")))


@query("SELECT c_custkey, 'microsoft|ms' || c_custkey AS tokens FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, '' FROM customer WHERE c_custkey % 2 <> 0")
def tenancy_tokens(spark, sf):
    key = F.col("c_custkey")
    text = F.when(key % 2 == 0, F.concat(F.lit('"MS=ms'), key.cast("string"), F.lit('"'))).otherwise("v=spf1 -all")
    return D.table(spark, sf, "customer").select("c_custkey", F.array_join(N.tenancy_tokens(text), ",").alias("tokens"))


@query("SELECT c_custkey, 0 AS flag, 'issue' AS tag, 'ca' || c_custkey % 3 || '.test' AS issuer, 'account=' || c_custkey AS parameters FROM customer")
def caa_record(spark, sf):
    key = F.col("c_custkey")
    text = F.concat(F.lit('0 ISSUE "ca'), (key % 3).cast("string"), F.lit(".test; account="), key.cast("string"), F.lit('"'))
    return D.table(spark, sf, "customer").select("c_custkey", N.caa(text).alias("c")).select("c_custkey", "c.flag", "c.tag", "c.issuer", F.array_join("c.parameters", ",").alias("parameters"))
