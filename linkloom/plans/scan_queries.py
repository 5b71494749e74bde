"""Facts of scans, and the reads that start from them, over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import host as H
from ..functions import signals as S
from ..operators import identifiers as Ids
from ..operators import scans as X
from . import driver_graph as D
from .registry import query


def joined(column: str) -> F.Column:
    return F.array_join(column, ",").alias(column)


def items(spark, sf):
    """Line items as sightings: the order is the run, the supplier the address."""
    ip = F.concat(F.lit("10."), (F.col("l_suppkey") % 250).cast("string"), F.lit(".0.1"))
    return D.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("run"), (F.col("l_linenumber") % 2).alias("branch"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag").alias("pos"), ip.alias("ip"), F.col("l_returnflag").alias("source"), "l_suppkey", "l_partkey")


_ITEMS = "it AS (SELECT l_orderkey AS run, l_linenumber % 2 AS branch, (l_linenumber, l_partkey, l_suppkey, l_returnflag) AS pos, '10.' || l_suppkey % 250 || '.0.1' AS ip, l_returnflag AS source, l_suppkey, l_partkey FROM lineitem)"


@query(f"WITH {_ITEMS}, s AS (SELECT run, ip, source, min((branch, pos)) AS seen FROM it GROUP BY ALL), g AS (SELECT run, ip, min(seen) AS seen, string_agg(source, ',' ORDER BY seen) AS sources FROM s GROUP BY ALL) SELECT run, ip, sources, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY seen, ip) AS rank FROM g) WHERE rank <= 3")
def observed_addresses(spark, sf):
    return X.observed_addresses(items(spark, sf), 3, H.networks(spark)).withColumn("sources", joined("sources"))


@query(f"WITH {_ITEMS}, f AS (SELECT run, ip, arg_min(source, (branch, pos)) AS first_source, bool_or(l_suppkey % 2 = 0) AS is_current FROM it GROUP BY ALL) SELECT *, CASE WHEN is_current THEN 'current' ELSE 'historical' END AS freshness FROM f")
def address_freshness(spark, sf):
    rows = items(spark, sf)
    return X.address_freshness(rows, rows.where("l_suppkey % 2 = 0"))


@query("SELECT o_custkey AS run, 'x' AS ip, arg_min(o_orderpriority, o_orderkey) FILTER (WHERE o_orderkey % 3 = 0) AS name, arg_min(o_orderstatus, o_orderkey) AS status, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS sources FROM orders GROUP BY o_custkey")
def merged_details(spark, sf):
    rows = D.table(spark, sf, "orders").select(F.col("o_custkey").alias("run"), F.lit("x").alias("ip"), F.col("o_orderkey").alias("pos"), F.col("o_orderstatus").alias("source"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).otherwise(" ").alias("name"), F.col("o_orderstatus").alias("status"))
    return X.merged_details(rows, ["name", "status"]).withColumn("sources", joined("sources"))


@query("SELECT s_suppkey AS ip, CASE WHEN s_suppkey % 3 = 0 AND s_suppkey % 2 = 0 THEN 'new' WHEN s_suppkey % 3 = 0 THEN NULL ELSE 'old' END AS asn, CASE WHEN s_suppkey % 4 = 0 THEN 'DE' ELSE 'US' END AS country FROM supplier")
def enrichment_gap_fill(spark, sf):
    s = D.table(spark, sf, "supplier")
    k = F.col("s_suppkey")
    stored = s.select(k.alias("ip"), F.when(k % 3 == 0, "").otherwise("old").alias("asn"), F.lit("US").alias("country"))
    new = s.where(k % 2 == 0).select(k.alias("ip"), F.lit("new").alias("asn"), F.when(k % 4 == 0, "DE").otherwise("").alias("country"))
    return X.gap_filled(stored, new, ["asn"], ["country"]).select("ip", F.nullif("asn", F.lit("")).alias("asn"), "country")


@query(f"WITH {_ITEMS} SELECT ip, count(*) AS n_rows FROM it WHERE l_partkey % 2 = 0 GROUP BY ip ORDER BY n_rows DESC, ip LIMIT 40")
def pending_addresses(spark, sf):
    rows = items(spark, sf).withColumn("enriched_at", F.when(F.col("l_partkey") % 2 == 1, F.col("source")))
    return X.pending_addresses(rows, 40).select("ip", "n_rows")


@query("WITH n AS (SELECT o_custkey AS run, o_orderpriority AS entity, o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS seen FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) = 1) "
       "SELECT run, entity, 'asn' AS kind, CAST(o_orderkey AS VARCHAR) AS value, 'ip_record' AS source, seen AS first_seen, seen AS last_seen FROM n UNION ALL SELECT run, entity, 'network_cidr', o_orderkey || '/24', 'ip_record', seen, seen FROM n WHERE o_orderkey % 2 = 0")
def address_observations(spark, sf):
    key = F.col("o_orderkey").cast("string")
    rows = D.table(spark, sf, "orders").select(F.col("o_custkey").alias("run"), F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("ip"), F.concat(F.lit("as"), key).alias("asn"), F.when(F.col("o_orderkey") % 2 == 0, F.concat(key, F.lit("/24"))).otherwise(" ").alias("network_cidr"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("observed_at"))
    return X.address_observations(rows)


@query(f"WITH {_ITEMS}, p AS (SELECT *, CASE WHEN branch = 0 THEN 'censys' ELSE 'scan_gcp' END AS s, CASE WHEN branch = 0 THEN l_partkey WHEN l_partkey % 2 = 0 THEN l_partkey ELSE 443 END AS port FROM it) SELECT run, ip, s AS source, arg_max(port, pos) AS port FROM p GROUP BY ALL")
def port_map(spark, sf):
    rows = items(spark, sf).withColumn("provider", F.when(F.col("branch") == 0, "censys").otherwise("scan")).withColumn("port", F.when((F.col("branch") == 0) | (F.col("l_partkey") % 2 == 0), F.col("l_partkey")))
    return X.port_map(rows)


def sightings(spark, sf):
    """Order lines as rows of an address table: customers as targets."""
    o = D.table(spark, sf, "orders").select("o_orderkey", "o_custkey", (F.col("o_orderkey") % 3 == 0).alias("is_latest"))
    li = D.table(spark, sf, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    k = F.col("l_suppkey") % 10
    asn = F.when(k == 0, "AS13335").otherwise(F.concat(F.lit("as"), (F.col("l_suppkey") + 64000).cast("string")))
    return li.select(F.concat(F.lit("www.C"), F.col("o_custkey").cast("string")).alias("target"), F.concat_ws("|", "l_suppkey", F.date_format("l_shipdate", "yyyy-MM-dd")).alias("ip"), F.when(k == 1, "mx.test").alias("ptr"), asn.alias("asn"), F.lit("dns").alias("source"), F.when(k == 2, "edge").alias("proxy_family"),
        (F.col("l_suppkey") % 10 == 3).alias("cloudflare"), F.struct("l_orderkey", "l_linenumber").alias("pos"), F.concat(F.lit("n"), (F.col("l_suppkey") % 2).cast("string")).alias("network_cidr"), "is_latest")


_SIGHT = "sg AS (SELECT o_custkey AS target, l_suppkey AS s, l_suppkey || '|' || strftime(l_shipdate, '%Y-%m-%d') AS ip, o_orderkey % 3 = 0 AS is_latest FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_suppkey % 10 NOT IN (0, 1, 2, 3))"


@query(f"WITH {_SIGHT} SELECT ip, CAST(min(s) + 64000 AS VARCHAR) AS asn, 'dns' AS sources, 'direct' AS role, count(DISTINCT target) AS targets FROM sg GROUP BY ip HAVING count(DISTINCT target) >= 2")
def clusters_by_address(spark, sf):
    return X.clusters_by_address(sightings(spark, sf)).withColumn("sources", joined("sources"))


@query(f"WITH {_SIGHT} SELECT CAST(s + 64000 AS VARCHAR) AS asn, CASE WHEN count(DISTINCT target) FILTER (WHERE is_latest) > 1 THEN 'current' ELSE 'historical' END AS status, count(DISTINCT target) AS all_targets, count(DISTINCT target) FILTER (WHERE is_latest) AS current_targets, 'n' || s % 2 AS cidrs, '' AS families, 'dns' AS sources FROM sg GROUP BY s HAVING count(DISTINCT target) >= 2")
def clusters_by_asn(spark, sf):
    out = X.clusters_by_asn(sightings(spark, sf), "all")
    return out.select("asn", "status", "all_targets", "current_targets", joined("cidrs"), joined("families"), joined("sources"))


@query("""WITH e AS (SELECT o_custkey AS run, o_orderkey // 2 AS id, 'c' || o_custkey || '.test' AS domain, o_orderkey, o_orderpriority FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderkey // 2 ORDER BY o_orderkey) = 1)
SELECT run, id, 'CA ' || o_orderpriority AS issuer, list_aggregate(list_sort([domain, 'w' || o_orderkey || '.' || domain, 'other.test']), 'string_agg', ',') AS sans, 'w' || o_orderkey || '.' || domain AS subdomains, 'other.test' AS cross_names FROM e""")
def ct_entries(spark, sf):
    o = D.table(spark, sf, "orders")
    domain, key = F.concat(F.lit("c"), F.col("o_custkey").cast("string"), F.lit(".test")), F.col("o_orderkey").cast("string")
    rows = o.select(F.col("o_custkey").alias("run"), domain.alias("domain"), F.col("o_orderkey").alias("pos"), F.floor(F.col("o_orderkey") / 2).alias("id"), F.struct(F.concat(F.lit("C=DE, CN=CA "), "o_orderpriority", F.lit(", O=x")).alias("name"), F.lit("y").alias("friendly_name")).alias("issuer"),
        F.array(domain, F.concat(F.lit("*."), domain), F.concat(F.lit("W"), key, F.lit("."), domain), F.lit(" Other.test ")).alias("dns_names"), F.lit("a").alias("not_before"), F.lit("b").alias("not_after"))
    return X.ct_entries(X.ct_feed(rows)).select("run", "id", "issuer", joined("sans"), joined("subdomains"), joined("cross_names"))


@query("SELECT o_orderkey, 'ip' AS ip, CAST(CASE WHEN o_orderkey % 3 = 0 THEN 8443 WHEN o_orderkey % 3 = 1 THEN 443 END AS INTEGER) AS port, CASE WHEN o_orderkey % 3 = 0 THEN 'b' WHEN o_orderkey % 3 = 1 THEN 'a' END AS sha256, o_orderkey % 3 = 0 AS matched FROM orders")
def host_hits(spark, sf):
    cert = lambda sha, *names: F.struct(F.lit(sha).cast("string").alias("sha256"), F.array(*[F.lit(n) for n in names]).cast("array<string>").alias("names"))
    service = lambda port, c: F.struct(F.lit(port).alias("port"), c.alias("cert"))
    k = F.col("o_orderkey") % 3
    services = F.when(k == 2, F.array(service(80, cert(None)))).otherwise(F.array(service(80, cert(None)), service(443, cert("a", "x.test")), service(8443, cert("b", "y.test"))))
    return D.table(spark, sf, "orders").select("o_orderkey", X.host_hit(services, F.lit("ip"), F.when(k == 0, F.array(F.lit("y.test"))).otherwise(F.array(F.lit("z.test")))).alias("h")).select("o_orderkey", "h.*")


@query("WITH r AS (SELECT l_suppkey AS run, l_orderkey * 10 + l_linenumber AS pos, 'h' || l_partkey % 20 || '.test' AS host, CAST(l_partkey % 3 AS VARCHAR) AS ip FROM lineitem), f AS (SELECT run, host, ip, min(pos) AS p FROM r GROUP BY ALL), g AS (SELECT run, host, min(pos) AS first, count(*) AS hits FROM r GROUP BY ALL) "
       "SELECT g.run, g.host, string_agg(ip, ',' ORDER BY p) AS ips, any_value(hits) AS hits, CAST(any_value(rank) AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY first, host) AS rank FROM g) g JOIN f ON f.run = g.run AND f.host = g.host WHERE rank <= 8 GROUP BY g.run, g.host")
def wordlist_hosts(spark, sf):
    li = D.table(spark, sf, "lineitem")
    rows = li.select(F.col("l_suppkey").alias("run"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), F.concat(F.lit("https://H"), (F.col("l_partkey") % 20).cast("string"), F.lit(".test/x")).alias("subdomain"), (F.col("l_partkey") % 3).cast("string").alias("ip"))
    return X.wordlist_hosts(rows).withColumn("ips", joined("ips"))


@query("SELECT run, target, arg_min(kind, (branch, pos)) AS kind, arg_min(kind, (branch, pos)) || '!' AS reason FROM (SELECT l_orderkey AS run, 't' || l_suppkey % 9 AS target, l_linenumber % 3 AS branch, l_linenumber AS pos, 'k' || l_linenumber % 3 AS kind FROM lineitem) WHERE target <> 't0' GROUP BY run, target")
def discovered_targets(spark, sf):
    kind = F.concat(F.lit("k"), (F.col("l_linenumber") % 3).cast("string"))
    rows = D.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("run"), F.lit("t0").alias("domain"), (F.col("l_linenumber") % 3).alias("branch"), F.col("l_linenumber").alias("pos"), F.concat(F.lit("http://t"), (F.col("l_suppkey") % 9).cast("string")).alias("target"), kind.alias("kind"), F.concat(kind, F.lit("!")).alias("reason"))
    return X.discovered(rows)


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'google|g' || c_custkey ELSE 'bing|m' || c_custkey END AS codes FROM customer")
def verification_codes(spark, sf):
    key = F.col("c_custkey").cast("string")
    found = F.when(F.col("c_custkey") % 2 == 0, F.create_map(F.lit("google"), F.array(F.concat(F.lit("g"), key)))).otherwise(F.create_map(F.lit("google"), F.array(F.lit(" "))))
    meta = F.create_map(F.lit("MSValidate.01"), F.array(F.concat(F.lit("m"), key)), F.lit("viewport"), F.array(F.lit("x")))
    return D.table(spark, sf, "customer").select("c_custkey", F.array_join(X.verification_codes(found, meta, {"msvalidate.01": "bing"}), ",").alias("codes"))


@query("SELECT c_custkey AS run, CASE c_custkey % 4 WHEN 0 THEN 'vercel' WHEN 1 THEN 'wix' WHEN 2 THEN 'cloudflare-pages' END AS platform, CASE WHEN c_custkey % 5 = 0 THEN 'drupal' WHEN c_custkey % 5 = 1 THEN 'wordpress' WHEN c_custkey % 4 = 3 THEN 'ghost' END AS cms, "
       "c_custkey % 3 <> 2 AND c_custkey % 3 <> 0 AS reachable, CASE WHEN c_custkey % 7 = 0 THEN 'no DNS resolution' END AS fetch_error FROM customer")
def live_states(spark, sf):
    k = F.col("c_custkey")
    headers = F.when(k % 4 == 0, F.create_map(F.lit("Server"), F.lit("Vercel"))).when(k % 4 == 1, F.create_map(F.lit("X-Wix-Request-Id"), F.lit("1"))).when(k % 4 == 2, F.create_map(F.lit("SERVER"), F.lit("cloudflare"))).otherwise(F.create_map(F.lit("X-Powered-By"), F.lit("Ghost 5")))
    docs = D.table(spark, sf, "customer").select(
        k.alias("run"), F.when(k % 7 != 0, F.array(F.lit("192.0.2.1"))).alias("a"), F.lit(None).cast("array<string>").alias("aaaa"), F.when(k % 3 == 0, F.lit(503)).when(k % 3 == 1, F.lit(200)).alias("status"), headers.alias("headers"),
        F.when(k % 5 == 0, "Drupal 10").alias("generator"), F.when(k % 5 == 1, "<link href=/wp-content/a.css>").alias("html"), F.lit(None).cast("string").alias("error"),
    )
    return X.live_state(docs).select("run", "platform", "cms", "reachable", "fetch_error")


_HITS = "h AS (SELECT l_suppkey AS doc, 'p' || l_partkey AS ip, l_orderkey % 3 AS url, l_orderkey % 2 = 0 AS third FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY l_orderkey, l_linenumber) = 1)"


@query(f"WITH {_HITS} SELECT x.doc AS a, y.doc AS b, x.ip, CASE WHEN x.third AND y.third AND x.url = y.url THEN 'shared_referrer' WHEN x.third AND y.third THEN 'both_third_party' WHEN x.third OR y.third THEN 'mixed' ELSE 'shared_host' END AS relationship, CASE WHEN x.third AND y.third AND x.url = y.url THEN 50 WHEN x.third AND y.third THEN 20 ELSE 0 END AS bonus "
       "FROM h x JOIN h y ON y.doc = x.doc + 1 AND x.ip = y.ip")
def referrer_matches(spark, sf):
    li = D.table(spark, sf, "lineitem")
    hits = li.select(F.col("l_suppkey").alias("doc"), F.struct("l_orderkey", "l_linenumber").alias("pos"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("ip"), (F.col("l_orderkey") % 3).cast("string").alias("url"), (F.col("l_orderkey") % 2 == 0).alias("third_party"))
    pairs = D.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("a"), (F.col("s_suppkey") + 1).alias("b"))
    return X.referrer_matches(hits, pairs).withColumn("bonus", Ids.referrer_bonus(F.col("relationship")))


@query("SELECT c_custkey AS run, 'ga' AS kind, 'g' || c_custkey % 3 AS value, 'one' AS field, 'tracking' AS class FROM customer UNION ALL SELECT c_custkey, 'icon', 'g1', 'three', 'content' FROM customer UNION ALL SELECT c_custkey, 'ga', 'g1', 'two', 'tracking' FROM customer WHERE c_custkey % 3 <> 1")
def page_selectors(spark, sf):
    docs = D.table(spark, sf, "customer").select(F.col("c_custkey").alias("run"), F.array(F.concat(F.lit(" g"), (F.col("c_custkey") % 3).cast("string")), F.lit("")).alias("one"), F.array(F.lit("g1")).alias("two"), F.array(F.lit("g1")).alias("three"))
    return X.candidate_selectors(docs, [("one", "ga", "tracking"), ("two", "ga", "tracking"), ("three", "icon", "content")])


@query("WITH r AS (SELECT l_suppkey AS run, 'd' || l_partkey % 50 || '.test' AS domain, 'k' || l_linenumber AS kind, CAST(l_orderkey AS VARCHAR) AS value, 'www' || l_linenumber || '.d' || l_partkey % 50 || '.test' AS hostname, CASE WHEN l_orderkey % 5 <> 0 THEN l_quantity END AS hits FROM lineitem WHERE l_partkey % 50 <> 0) "
       "SELECT run, domain, kind, value, hostname, hits FROM r QUALIFY row_number() OVER (PARTITION BY run, domain ORDER BY coalesce(hits, 1073741824), kind, value, hostname) = 1")
def rarest_selectors(spark, sf):
    host = lambda c, p: F.concat(F.lit(p), c.cast("string"), F.lit(".d"), (F.col("l_partkey") % 50).cast("string"), F.lit(".test"))
    rows = D.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("run"), F.lit("x.d0.test").alias("origin"), host(F.col("l_linenumber"), "www").alias("hostname"), F.concat(F.lit("k"), F.col("l_linenumber").cast("string")).alias("kind"), F.col("l_orderkey").cast("string").alias("value"), F.when(F.col("l_orderkey") % 5 != 0, F.col("l_quantity")).alias("hits"))
    return X.rarest_selector(rows)


@query("SELECT 'k' AS kind, 'v' || o_custkey AS value, max(o_orderkey) % 100 AS hits FROM orders WHERE o_orderkey % 4 <> 0 AND o_custkey % 2 = 0 GROUP BY o_custkey")
def selector_prevalence(spark, sf):
    o = D.table(spark, sf, "orders")
    value = F.concat(F.lit("v"), F.col("o_custkey").cast("string"))
    one = F.struct(F.lit("k").alias("kind"), value.alias("value"), F.when(F.col("o_orderkey") % 4 != 0, (F.col("o_orderkey") % 100).cast("string")).alias("global_hits"))
    fields = o.select(F.col("o_orderkey").alias("run"), F.to_json(F.struct(F.array(one).alias("selectors"))).alias("json"))
    return X.prevalence(fields, D.table(spark, sf, "customer").where("c_custkey % 2 = 0").select(F.lit("k").alias("kind"), F.concat(F.lit("v"), F.col("c_custkey").cast("string")).alias("value")))


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'ip' WHEN page_id % 3 = 1 THEN 'rd' END AS mode, CASE WHEN page_id % 3 = 0 THEN '192.0.2.' || page_id % 250 WHEN page_id % 3 = 1 THEN 'p' || page_id || '.test' END AS key FROM pages")
def resolved_side(spark, sf):
    k, text = F.col("page_id") % 3, F.col("page_id").cast("string")
    value = F.when(k == 0, F.concat(F.lit("192.0.2."), (F.col("page_id") % 250).cast("string"))).when(k == 1, F.concat(F.lit("https://a.b.P"), text, F.lit(".test:8080/x"))).otherwise("no host")
    return D.table(spark, sf, "pages").select("page_id", X.side_of(value).alias("s")).select("page_id", "s.mode", "s.key")


@query("""WITH hit AS (SELECT DISTINCT l_orderkey AS run FROM lineitem WHERE l_partkey IN (SELECT l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey = (SELECT min(o_custkey) FROM orders)))
SELECT o_orderkey AS run, o_custkey AS target FROM orders JOIN hit ON run = o_orderkey WHERE o_orderstatus = 'F' AND o_custkey <> (SELECT min(o_custkey) FROM orders) QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST, o_totalprice DESC, o_orderkey DESC) = 1 ORDER BY target LIMIT 24""")
def historical_candidates(spark, sf):
    o = D.table(spark, sf, "orders")
    first = o.agg(F.min("o_custkey")).first()[0]
    runs = o.select(F.col("o_orderkey").alias("run"), F.col("o_orderpriority").alias("case_id"), F.col("o_custkey").alias("target"), F.col("o_orderdate").alias("completed_at"), F.col("o_totalprice").alias("created_at"), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("open").alias("status"))
    facts = D.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("run"), F.lit("part").alias("kind"), F.col("l_partkey").alias("value"))
    asked = facts.join(runs.where(F.col("target") == first), "run", "left_semi")
    return X.historical_candidates(runs, facts, F.col("target") == first, asked).select("run", "target")


@query(f"WITH {D.sql_links('part_day')}, s AS (SELECT * FROM lk WHERE CAST(a AS BIGINT) % 3 = 0 QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 3) SELECT a AS target, b AS linked_target, score, confidence, strength FROM s ORDER BY score DESC, a, b LIMIT 5")
def pool_summary(spark, sf):
    from .graph_queries import all_links

    seeds = D.table(spark, sf, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").cast("string").alias("target"))
    return X.pool_summary(seeds, all_links(spark, sf, "part_day"))


_INSIDE = "e AS (SELECT o_custkey % 20 AS cluster, CAST(l_suppkey % 7 AS VARCHAR) AS path, l_quantity AS score, l_returnflag = 'R' AS strong FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_partkey % 20 = o_custkey % 20)"


@query(f"WITH {_INSIDE}, t AS (SELECT cluster, count(*) AS edges, count(*) FILTER (WHERE strong) AS strong_edges, max(score) AS max_score FROM e GROUP BY cluster), p AS (SELECT cluster, path, count(*) AS n, row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, path) AS r FROM e GROUP BY cluster, path) SELECT t.*, top_paths FROM t JOIN (SELECT cluster, string_agg(path || ':' || n, ',' ORDER BY r) AS top_paths FROM p WHERE r <= 5 GROUP BY cluster) USING (cluster)")
def cluster_summary(spark, sf):
    c, p = D.table(spark, sf, "customer").select("c_custkey"), D.table(spark, sf, "part").select("p_partkey")
    labels = c.select(F.concat(F.lit("c"), "c_custkey").alias("node"), (F.col("c_custkey") % 20).alias("cluster")).unionByName(p.select(F.concat(F.lit("p"), "p_partkey").alias("node"), (F.col("p_partkey") % 20).alias("cluster")))
    o = D.table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    edges = D.table(spark, sf, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.concat(F.lit("c"), "o_custkey").alias("a"), F.concat(F.lit("p"), "l_partkey").alias("b"), F.col("l_quantity").alias("score"), (F.col("l_returnflag") == "R").alias("strong"), F.array((F.col("l_suppkey") % 7).cast("string")).alias("paths"))
    return X.cluster_summary(labels, edges).withColumn("top_paths", joined("top_paths"))


@query("SELECT o_custkey AS apex, arg_max(o_orderpriority, o_orderkey) FILTER (WHERE o_orderkey % 2 = 0) AS registrar, arg_max(o_orderstatus, o_orderkey) FILTER (WHERE o_orderkey % 2 = 1 AND o_orderkey % 5 <> 1) AS country FROM orders GROUP BY o_custkey")
def latest_fields(spark, sf):
    key = F.col("o_orderkey")
    rows = D.table(spark, sf, "orders").select(F.col("o_custkey").alias("apex"), key.alias("run"), F.when(key % 2 == 0, "registrar").otherwise("country").alias("key"), F.when(key % 2 == 0, F.col("o_orderpriority")).when(key % 5 != 1, F.col("o_orderstatus")).alias("value"))
    return X.latest_fields(rows, ["registrar", "country"])


@query("SELECT least(l_partkey, l_suppkey + 100000) AS a, greatest(l_partkey, l_suppkey + 100000) AS b, CASE WHEN arg_max(l_returnflag, (l_quantity, l_returnflag)) = 'R' THEN 'infra' WHEN arg_max(l_returnflag, (l_quantity, l_returnflag)) = 'A' THEN 'strong' ELSE 'weak' END AS visual, CAST(least(8, greatest(1, floor(max(l_quantity * 10) / 30))) AS INTEGER) AS width FROM lineitem GROUP BY 1, 2")
def graph_edges(spark, sf):
    flag = F.col("l_returnflag")
    paths = F.when(flag == "R", F.array(F.lit("dns.A"))).when(flag == "A", F.array(F.lit("dns.A"), F.lit("legal_pages.registration_ids"))).otherwise(F.array(F.lit("dns.NS")))
    # The score carries the tie: flags of equal quantity are ranked by their letter.
    edges = D.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("a"), (F.col("l_suppkey") + 100000).alias("b"), (F.col("l_quantity") * 10 + F.ascii(flag) / 1000).alias("score"), paths.alias("paths"))
    return X.graph_payload(D.table(spark, sf, "part").select(F.col("p_name").alias("node"), F.lit(None).alias("cluster")), edges)[1].select("a", "b", "visual", "width")


@query("SELECT CASE WHEN c_custkey % 3 = 0 THEN 'c' || c_custkey || '.test' WHEN c_custkey % 3 = 1 THEN 'a.c' || c_custkey || '.test' ELSE '192.0.2.7' END AS node, CASE c_custkey % 3 WHEN 0 THEN 'domain' WHEN 1 THEN 'subdomain' ELSE 'ip' END AS kind, CASE WHEN c_custkey % 2 = 0 THEN 'isolate' ELSE 'cluster-' || c_nationkey END AS \"group\" FROM customer")
def graph_nodes(spark, sf):
    k, text = F.col("c_custkey") % 3, F.col("c_custkey").cast("string")
    node = F.when(k == 0, F.concat(F.lit("c"), text, F.lit(".test"))).when(k == 1, F.concat(F.lit("a.c"), text, F.lit(".test"))).otherwise("192.0.2.7")
    nodes = D.table(spark, sf, "customer").select(node.alias("node"), F.when(F.col("c_custkey") % 2 == 1, F.col("c_nationkey")).alias("cluster"))
    return X.graph_payload(nodes, spark.createDataFrame([], "a string, b string, score double, paths array<string>"))[0]


@query("WITH top AS (SELECT l_orderkey AS a, l_orderkey + 1 AS b, sum(l_extendedprice) AS score FROM lineitem GROUP BY l_orderkey ORDER BY score DESC, a, b LIMIT 5), m AS (SELECT 'p' || l_partkey || '.test' AS target, top.a, top.b, score, l_linenumber AS pos, CASE l_linenumber % 3 WHEN 0 THEN 'ip' WHEN 1 THEN 'cert_cn' ELSE 'referrer' END AS kind, a % 2 = 0 AS weak FROM lineitem JOIN top ON a = l_orderkey) "
       "SELECT target, kind, a, b FROM m WHERE (kind <> 'cert_cn' OR weak) AND target NOT IN (SELECT 'p' || p_partkey || '.test' FROM part WHERE p_partkey % 5 = 0) QUALIFY row_number() OVER (PARTITION BY target ORDER BY -score, a, b, pos) = 1")
def dive_targets(spark, sf):
    li = D.table(spark, sf, "lineitem")
    pairs = li.groupBy(F.col("l_orderkey").alias("a")).agg(F.sum("l_extendedprice").alias("score")).select("a", (F.col("a") + 1).alias("b"), "score", F.when(F.col("a") % 2 == 0, "weak").otherwise("strong").alias("quality"))
    k, target = F.col("l_linenumber") % 3, F.concat(F.lit("p"), F.col("l_partkey").cast("string"), F.lit(".test"))
    path = F.when(k == 0, "dns.A").when(k == 1, "tls_certs.probes[*].cn").otherwise("referrer")
    matches = li.select(F.col("l_orderkey").alias("a"), (F.col("l_orderkey") + 1).alias("b"), F.col("l_linenumber").alias("pos"), path.alias("path"), F.when(k == 2, F.concat(F.lit("http://"), target, F.lit("/x"))).otherwise(target).alias("value"))
    scanned = D.table(spark, sf, "part").where("p_partkey % 5 = 0").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string"), F.lit(".test")).alias("target"))
    return X.dive_targets(pairs, matches, scanned)


@query("SELECT CAST(c_custkey AS VARCHAR) AS a, c_custkey % 2 = 0 AS computed, CASE WHEN c_custkey % 2 = 0 THEN o_orderkey END AS b, CASE WHEN c_custkey % 2 = 0 THEN o_totalprice END AS score FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice >= 100000) ON o_custkey = c_custkey WHERE (c_custkey % 2 = 0 AND o_orderkey IS NOT NULL) OR c_custkey % 2 = 1")
def cached_links(spark, sf):
    c = D.table(spark, sf, "customer").select("c_custkey", F.col("c_custkey").cast("string").alias("rd"))
    links = D.table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("a"), F.col("o_orderkey").alias("b"), F.col("o_totalprice").alias("score"))
    return X.cached_links(c, links, c.where("c_custkey % 2 = 0"), 100000.0)


@query("SELECT 'c' || key AS key, CASE WHEN bool_or(o_orderkey % 3 = 0) THEN 'c' || key ELSE arg_min(t, o_orderkey) END AS target FROM (SELECT o_orderkey, o_custkey AS key, CASE WHEN o_orderkey % 3 = 1 THEN 'WWW.c' || o_custkey ELSE 'C' || o_custkey END AS t FROM orders) GROUP BY key")
def preferred_targets(spark, sf):
    k, text = F.col("o_orderkey") % 3, F.col("o_custkey").cast("string")
    spelt = F.when(k == 0, F.concat(F.lit("c"), text)).when(k == 1, F.concat(F.lit("WWW.c"), text)).otherwise(F.concat(F.lit(" C"), text))
    return X.preferred_targets(D.table(spark, sf, "orders").select(F.col("o_orderkey").alias("pos"), spelt.alias("target")))


@query("SELECT 'customers' AS \"table\", count(*) AS n_rows FROM customer UNION ALL SELECT 'parts', count(*) FROM part")
def table_counters(spark, sf):
    return X.counters({"parts": D.table(spark, sf, "part"), "customers": D.table(spark, sf, "customer")})


@query("WITH s AS (SELECT DISTINCT o_custkey AS t FROM orders WHERE o_orderkey % 20 = 1), f AS (SELECT DISTINCT l_suppkey AS t FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey IN (SELECT t FROM s)) SELECT t AS target, 0 AS round FROM s UNION ALL SELECT t, 1 FROM f WHERE t NOT IN (SELECT t FROM s)")
def followup_rounds(spark, sf):
    o = D.table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    found = D.table(spark, sf, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("source"), F.col("l_suppkey").alias("target"))
    return X.followup_rounds(o.where("o_orderkey % 20 = 1").select(F.col("o_custkey").alias("target")), found)


@query("SELECT event_id AS id, user_id AS target, event_type AS type FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
def recent_runs(spark, sf):
    e = D.table(spark, sf, "events")
    return e.orderBy(F.desc("ts"), F.desc("event_id")).limit(100).select(F.col("event_id").alias("id"), F.col("user_id").alias("target"), F.col("event_type").alias("type"))


@query(f"WITH {D.sql_obs('part_day')} SELECT rd FROM (SELECT DISTINCT rd FROM obs WHERE value = (SELECT arg_max(value, (n, value)) FROM (SELECT value, count(DISTINCT rd) AS n FROM obs GROUP BY value))) ORDER BY rd LIMIT 10")
def domains_behind(spark, sf):
    from .graph_queries import members

    found = members(spark, sf, "part_day")
    value = found.groupBy("value").agg(F.countDistinct("rd").alias("n")).orderBy(F.desc("n"), F.desc("value")).first()["value"]
    return found.where(F.col("value") == value).select("rd").distinct().orderBy("rd").limit(10)


# ---- single values ----


@query("""WITH v AS (SELECT c_custkey, CASE c_custkey % 8 WHEN 0 THEN '10.1.2.3' WHEN 1 THEN '172.' || c_custkey % 64 || '.0.1' WHEN 2 THEN '192.168.0.1' WHEN 3 THEN '8.8.' || c_custkey % 200 || '.8' WHEN 4 THEN '224.0.0.1' WHEN 5 THEN '169.254.1.1' WHEN 6 THEN '2606:4700::1' ELSE 'fe80::1' END AS ip FROM customer)
SELECT c_custkey, ip, CASE c_custkey % 8 WHEN 1 THEN NOT (c_custkey % 64 BETWEEN 16 AND 31) WHEN 3 THEN true WHEN 6 THEN true ELSE false END AS public FROM v""")
def public_addresses(spark, sf):
    k, part = F.col("c_custkey") % 8, lambda n: (F.col("c_custkey") % n).cast("string")
    ip = F.when(k == 0, "10.1.2.3").when(k == 1, F.concat(F.lit("172."), part(64), F.lit(".0.1"))).when(k == 2, "192.168.0.1").when(k == 3, F.concat(F.lit("8.8."), part(200), F.lit(".8"))).when(k == 4, "224.0.0.1").when(k == 5, "169.254.1.1").when(k == 6, "2606:4700::1").otherwise("fe80::1")
    return D.table(spark, sf, "customer").select("c_custkey", ip.alias("ip")).withColumn("public", S.public_ip(F.col("ip")))


@query("SELECT c_custkey, c_custkey % 3 <> 0 AS comparable, c_custkey % 3 = 1 AS mismatch, CASE WHEN c_custkey % 3 = 1 THEN 'ns2.x.test' ELSE '' END AS registrar_only, CASE WHEN c_custkey % 3 = 1 THEN 'nsown' || c_custkey || '.x.test' ELSE '' END AS live_only FROM customer")
def delegation_check(spark, sf):
    k, own = F.col("c_custkey") % 3, F.concat(F.lit("NSown"), F.col("c_custkey").cast("string"), F.lit(".x.test."))
    live = F.array(F.lit("ns1.x.test"), own, F.lit("creation"))
    registrar = F.when(k == 1, F.array(F.lit("NS1.X.test"), F.lit("ns2.x.test"))).when(k == 2, live)
    return D.table(spark, sf, "customer").select("c_custkey", S.delegation(live, registrar).alias("d")).select("c_custkey", "d.comparable", "d.mismatch", F.array_join("d.registrar_only", ",").alias("registrar_only"), F.array_join("d.live_only", ",").alias("live_only"))


@query("SELECT s_suppkey, 'ns1.cloudflare.com' AS boring, 'ns.own' || s_suppkey || '.test' AS vanity FROM supplier")
def nameserver_split(spark, sf):
    names = F.array(F.lit("NS1.Cloudflare.com."), F.concat(F.lit("ns.own"), F.col("s_suppkey").cast("string"), F.lit(".test")))
    return D.table(spark, sf, "supplier").select("s_suppkey", S.split_nameservers(names).alias("n")).select("s_suppkey", F.array_join("n.boring", ",").alias("boring"), F.array_join("n.vanity", ",").alias("vanity"))


@query("SELECT c_custkey, 'ci' || c_custkey || '.internal,grafana' AS labels FROM customer")
def distinctive_labels(spark, sf):
    hosts = F.array(F.lit("WWW.own.test"), F.lit("*.own.test"), F.lit("mail.own.test"), F.lit("grafana.own.test"), F.concat(F.lit("ci"), F.col("c_custkey").cast("string"), F.lit(".internal.own.test")), F.lit("cdn.eu.own.test"), F.lit("x.other.test"))
    return D.table(spark, sf, "customer").select("c_custkey", F.array_join(S.subdomain_labels(hosts, F.lit("own.test")), ",").alias("labels"))


@query("SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN true WHEN 3 THEN true WHEN 4 THEN true ELSE false END AS edge FROM customer")
def edge_networks(spark, sf):
    k = F.col("c_custkey") % 6
    is_ = lambda n: k == n
    edge = S.edge_network(is_(0), F.lit(None).cast("boolean"), F.when(is_(1), "cloudflare"), F.lit(False), [F.when(is_(2), "FASTLY-1").otherwise("Some Telecom"), F.when(is_(3), "lga.1e100.net")], F.create_map(F.lit("vpn"), F.lit(None).cast("boolean")), F.when(is_(4), F.array(F.lit("CDN"))))
    return D.table(spark, sf, "customer").select("c_custkey", edge.alias("edge"))


@query("SELECT c_custkey, c_custkey % 5 IN (0, 1, 2) AS low FROM customer")
def low_signal_certificates(spark, sf):
    k = F.col("c_custkey") % 5
    low = S.low_signal_certificate(F.when(k == 0, "mail").otherwise("direct"), F.when(k == 1, "*.localhost").otherwise("own.test"), F.when(k == 2, "Kubernetes Ingress Controller Fake Certificate").when(k == 3, "R3"))
    return D.table(spark, sf, "customer").select("c_custkey", low.alias("low"))


@query("""WITH v AS (SELECT c_custkey, c_custkey % 5 AS k, c_custkey % 2 = 0 AS e FROM customer)
SELECT c_custkey, e AS ok FROM v""")
def evidence_gates(spark, sf):
    k, even = F.col("c_custkey") % 5, F.col("c_custkey") % 2 == 0
    one = lambda good, bad: F.when(even, good).otherwise(bad)
    path = F.when(k == 0, "email_security.dkim_selectors").when(k == 1, "email_security.dmarc_report_uris").when(k == 2, "tls_certs.probes[*].cn").when(k == 3, "legal_pages.phones").otherwise("page_metadata.crypto_wallet_values")
    value = F.when(k == 0, one("own2024", "Default")).when(k == 1, one("a@own.test", "rua")).when(k == 2, one("*.own.test", "TRAEFIK DEFAULT CERT")).when(k == 3, one("+49 30 123987", "555 01-00")).otherwise(one("ethereum|0xabc", "ethereum|0x000000000000000000000000000000000000dEaD"))
    return D.table(spark, sf, "customer").select("c_custkey", S.evidence_ok(path, value).alias("ok"))


@query("SELECT c_custkey, 'google_site_verification|g' || c_custkey || ',microsoft|ms1,zoom_verification|z_1' AS tokens FROM customer")
def txt_tokens(spark, sf):
    records = F.array(F.concat(F.lit("google-site-verification=g"), F.col("c_custkey").cast("string")), F.lit("MS=ms1"), F.lit("ZOOM-domain-verification=z_1; x"), F.lit("v=spf1 -all"))
    return D.table(spark, sf, "customer").select("c_custkey", F.array_join(S.txt_tokens(records), ",").alias("tokens"))


@query("SELECT o_orderkey, CAST(greatest(0, least(o_orderkey % 50, 100 - o_custkey % 150)) AS BIGINT) AS granted FROM orders")
def budget_claim(spark, sf):
    return D.table(spark, sf, "orders").select("o_orderkey", S.granted(F.col("o_orderkey") % 50, F.col("o_custkey") % 150, 100).alias("granted"))
