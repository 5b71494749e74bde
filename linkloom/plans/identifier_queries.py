"""Identifier comparison, pair matching and discovery over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..operators import identifiers as I
from ..storage import written
from . import driver_graph as D
from .registry import query

_CATEGORIES = ("tls", "tracking", "social", "generic")


def identifiers(spark, sf):
    """Customers as domains; parts, suppliers, brands and days as identifiers."""
    o = D.table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    li = D.table(spark, sf, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    day = F.date_format("l_shipdate", "yyyy-MM-dd")
    found = F.array(
        F.struct(F.lit("part_day").alias("type"), F.lit("tier_1").alias("tier"), F.lit("tls").alias("category"), F.concat_ws("|", F.col("l_partkey").cast("string"), day).alias("value")),
        F.struct(F.lit("supp_day").alias("type"), F.lit("tier_2").alias("tier"), F.lit("tracking").alias("category"), F.concat_ws("|", F.col("l_suppkey").cast("string"), day).alias("value")),
        F.struct(F.lit("part").alias("type"), F.lit("tier_3").alias("tier"), F.lit("social").alias("category"), F.col("l_partkey").cast("string").alias("value")),
    )
    return li.select(F.col("o_custkey").cast("string").alias("domain"), F.explode(found).alias("i")).select("domain", "i.*").distinct()


_IDS = f"""{D.SQL_LINES}, ids AS (SELECT DISTINCT rd AS domain, type, tier, category, value FROM (
  SELECT rd, 'part_day' AS type, 'tier_1' AS tier, 'tls' AS category, p || '|' || day AS value FROM li UNION ALL SELECT rd, 'supp_day', 'tier_2', 'tracking', s || '|' || day FROM li UNION ALL SELECT rd, 'part', 'tier_3', 'social', p FROM li)),
 fq AS (SELECT type, category, value, domains, CASE WHEN domains > o THEN 'excluded' WHEN domains > d THEN 'downweighted' ELSE 'normal' END AS status, CASE WHEN domains > o THEN 0.0::DOUBLE WHEN domains > d THEN greatest(0.2::DOUBLE, d::DOUBLE / domains::DOUBLE) ELSE 1.0::DOUBLE END AS multiplier
   FROM (SELECT type, category, value, count(DISTINCT domain) AS domains, CASE category WHEN 'tls' THEN 10 WHEN 'tracking' THEN 6 ELSE 4 END AS d, CASE category WHEN 'tls' THEN 60 WHEN 'tracking' THEN 30 ELSE 18 END AS o FROM ids GROUP BY ALL))"""


@query(f"WITH {_IDS} SELECT type, category, value, domains, status, round(multiplier, 3) AS multiplier FROM fq")
def identifier_frequency(spark, sf):
    return I.frequency(identifiers(spark, sf)).withColumn("multiplier", F.round("multiplier", 3))


_TIMING = """ct AS (SELECT CAST(o_custkey AS VARCHAR) AS domain, o_orderpriority AS issuer, epoch(o_orderdate + to_seconds(o_orderkey % 86400)) AS t FROM orders),
 tm AS (SELECT x.domain AS a, y.domain AS b, x.issuer, CASE WHEN abs(x.t - y.t) <= 86400 THEN '24h' ELSE '7d' END AS within, min(CAST(abs(x.t - y.t) AS BIGINT)) AS seconds FROM ct x JOIN ct y ON x.issuer = y.issuer AND x.domain < y.domain AND y.t BETWEEN x.t - 604800 AND x.t + 604800 AND x.t <> y.t GROUP BY 1, 2, 3, 4)"""


def certificates(spark, sf):
    """Orders as certificates: the customer's, issued by the priority."""
    o = D.table(spark, sf, "orders")
    issued = (F.unix_timestamp(F.col("o_orderdate").cast("timestamp")) + F.col("o_orderkey") % 86400).cast("timestamp")
    return o.select(F.col("o_custkey").cast("string").alias("domain"), F.col("o_orderpriority").alias("issuer"), issued.alias("issued"))


def compared_evidence(spark, sf):
    """What customers share, and certificates issued close together, of all pairs."""
    found = written(identifiers(spark, sf), "identifiers")
    return I.evidence(I.shared_points(found, I.frequency(found)), certificates(spark, sf))


_COMPARE = f"""{_IDS}, {_TIMING}, pts AS (SELECT x.domain AS a, y.domain AS b, x.tier, x.category, least(100, greatest(0, round_even(least(100, greatest(1, CASE x.tier WHEN 'tier_1' THEN 74 WHEN 'tier_2' THEN 46 ELSE 28 END + CASE x.category WHEN 'tls' THEN 18 WHEN 'tracking' THEN 12 ELSE 4 END)) * multiplier, 0))) AS points
   FROM ids x JOIN ids y ON x.type = y.type AND x.value = y.value AND x.domain < y.domain JOIN fq ON fq.type = x.type AND fq.value = x.value WHERE status <> 'excluded'
   UNION ALL SELECT a, b, CASE within WHEN '24h' THEN 'tier_3' ELSE 'tier_4' END, 'tls_ct', CASE within WHEN '24h' THEN 48.0::DOUBLE ELSE 30.0::DOUBLE END FROM tm),
 cp AS (SELECT a, b, n_shared, round(least(100.0::DOUBLE, total + 4 * (kinds - 1) + 6 * (tiers - 1)), 2) AS score FROM (SELECT a, b, sum(points) AS total, count(DISTINCT (tier, category)) AS kinds, count(DISTINCT tier) AS tiers, count(*) AS n_shared FROM pts GROUP BY a, b))"""


@query(f"WITH {_COMPARE} SELECT a, b, n_shared, score, CASE WHEN score >= 85 THEN 'high' WHEN score >= 60 THEN 'medium' WHEN score >= 30 THEN 'low' ELSE 'very_low' END AS label FROM cp")
def domain_compare(spark, sf):
    return I.compared(compared_evidence(spark, sf))


@query(f"WITH {_COMPARE} SELECT a, b, tier, score, n_evidence, CASE WHEN score >= 85 THEN 'high' WHEN score >= 60 THEN 'medium' WHEN score >= 30 THEN 'low' ELSE 'very_low' END AS label FROM (SELECT a, b, tier, round(least(100.0::DOUBLE, sum(points)), 2) AS score, count(*) AS n_evidence FROM pts GROUP BY a, b, tier)")
def domain_compare_tiers(spark, sf):
    return I.tier_sums(compared_evidence(spark, sf))


_TRAVERSE = f"""{_COMPARE}, ed AS (SELECT a, b FROM cp WHERE score >= 20 UNION ALL SELECT b, a FROM cp WHERE score >= 20), s0 AS (SELECT min(a) AS node, 0 AS h FROM ed),
 s1 AS (SELECT DISTINCT b AS node, 1 AS h FROM ed JOIN s0 ON a = node WHERE b NOT IN (SELECT node FROM s0)), s2 AS (SELECT DISTINCT b AS node, 2 AS h FROM ed JOIN s1 ON a = node WHERE b NOT IN (SELECT node FROM s0 UNION ALL SELECT node FROM s1))"""


@query(f"WITH {_TRAVERSE} SELECT node, h AS hop_distance FROM (FROM s0 UNION ALL FROM s1 UNION ALL FROM s2)")
def traverse_depth2(spark, sf):
    found = identifiers(spark, sf)
    return I.walk(written(I.telling(found, I.frequency(found)), "identifiers"), certificates(spark, sf))


@query(f"WITH {_TIMING} SELECT a, b, issuer, within, seconds FROM tm")
def issuance_timing(spark, sf):
    return I.issuance_timing(certificates(spark, sf))


# ---- pairs of documents: orders as documents, their columns as paths ----


def facts(spark, sf):
    o = D.table(spark, sf, "orders").select("o_orderkey")
    li = D.table(spark, sf, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    doc = F.col("l_orderkey").cast("string")
    found = F.array(
        F.struct(F.lit("dns.A").alias("path"), F.col("l_partkey").cast("string").alias("value")), F.struct(F.lit("dns.NS").alias("path"), F.concat_ws("|", "l_suppkey", F.date_format("l_shipdate", "yyyy-MM")).alias("value")),
        F.struct(F.lit("other.path").alias("path"), F.concat_ws("|", "l_partkey", "l_suppkey").alias("value")),
    )
    return li.select(doc.alias("doc"), F.explode(found).alias("f")).select("doc", "f.*")


_FACTS = f"""ft AS (SELECT * FROM (SELECT DISTINCT doc, path, value FROM (SELECT CAST(l_orderkey AS VARCHAR) AS doc, unnest(['dns.A', 'dns.NS', 'other.path']) AS path, unnest([CAST(l_partkey AS VARCHAR), l_suppkey || '|' || strftime(l_shipdate, '%Y-%m'), l_partkey || '|' || l_suppkey]) AS value FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)) WHERE value NOT IN ('', '0', 'false', 'none', 'null')) QUALIFY count(*) OVER (PARTITION BY path, value) <= {K.MOST_OWNERS}),
 pm AS (SELECT x.doc AS a, y.doc AS b, x.path, count(*) AS n_values FROM ft x JOIN ft y ON x.path = y.path AND x.value = y.value AND x.doc < y.doc GROUP BY ALL)"""


@query(f"WITH {_FACTS} SELECT a, b, path, n_values FROM pm")
def path_value_matches(spark, sf):
    return I.path_matches(facts(spark, sf))


_SCORED = f"{_FACTS}, sc AS (SELECT a, b, sum(CASE path WHEN 'dns.A' THEN CAST(trunc(25 * CASE WHEN CAST(a AS BIGINT) % 2 = 0 THEN 0.3::DOUBLE ELSE 1.0::DOUBLE END) AS BIGINT) WHEN 'dns.NS' THEN 10 ELSE 5 END) AS score, list_sort(list(path)) AS paths FROM pm GROUP BY a, b)"


def _scored(spark, sf):
    ip = F.when(F.col("a").cast("long") % 2 == 0, F.lit(0.3)).otherwise(F.lit(1.0))
    rows = I.path_matches(facts(spark, sf)).withColumn("w", I.path_weight(F.col("path"), F.lit(1.0), ip, F.lit(False)))
    return rows.groupBy("a", "b").agg(F.sum("w").alias("score"), F.array_sort(F.collect_set("path")).alias("paths"))


@query(f"WITH {_SCORED} SELECT a, b, CAST(score AS BIGINT) AS score FROM sc")
def pair_score(spark, sf):
    return _scored(spark, sf).select("a", "b", "score")


@query(f"WITH {_SCORED} SELECT a, b, CASE WHEN round_even(100.0::DOUBLE * score / (score + 65.0::DOUBLE), 0) >= 65 THEN 'strong' WHEN round_even(100.0::DOUBLE * score / (score + 65.0::DOUBLE), 0) >= 35 THEN 'moderate' ELSE 'weak' END AS strength FROM sc")
def pair_strength(spark, sf):
    from ..functions.scoring import confidence

    s = _scored(spark, sf)
    return s.select("a", "b", I.pair_strength(F.col("paths"), confidence(F.col("score").cast("double")), F.lit("n/a"), F.lit(False)).alias("strength"))


_CERT = K.CERT_PATHS[0]
_WEIGHTS = "CASE path " + " ".join(f"WHEN '{p}' THEN {K.PATH_WEIGHTS.get(p, K.DEFAULT_PATH_WEIGHT)}" for p in (_CERT, K.SSH_PATH, "dns.A", "dns.NS", "other.path")) + " END::DOUBLE"


def _pair_tables(spark, sf):
    """Matches of orders with certificates and keys too, and what is known of the
    pairs: quality and freshness by the first order, referrers by both."""
    doc, day = F.col("l_orderkey").cast("string").alias("doc"), F.date_format("l_shipdate", "yyyy-MM-dd")
    li, o = D.table(spark, sf, "lineitem"), D.table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("doc"), "o_orderstatus", "o_totalprice", "o_orderpriority")
    keys = F.array(F.struct(F.lit(_CERT).alias("path"), F.concat_ws("|", "l_partkey", day).alias("value")), F.struct(F.lit(K.SSH_PATH).alias("path"), F.concat_ws("|", "l_suppkey", day).alias("value")))
    known = D.table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    found = written(I.path_matches(facts(spark, sf).unionByName(li.join(known, "l_orderkey", "left_semi").select(doc, F.explode(keys).alias("f")).select("doc", "f.*"))), "matches")
    pairs = found.select("a", "b").distinct().join(o.select(F.col("doc").alias("a"), F.col("o_orderstatus").alias("sa"), F.col("o_totalprice").alias("pa")), "a").join(o.select(F.col("doc").alias("b"), F.col("o_orderstatus").alias("sb")), "b")
    certificates = pairs.select("a", "b", I.certificate_quality(F.lit(True), F.col("pa") >= 100000, F.col("sa") == "F").alias("cert_quality"))
    addresses = pairs.select("a", "b", F.when(F.col("pa") < 50000, "historical").when(F.col("pa") < 150000, "mixed").otherwise("current").alias("freshness"))
    referrers = pairs.where("sa = 'P'").select("a", "b", F.lit("x").alias("ip"), F.when(F.col("sb") == "P", "shared_referrer").when(F.col("sb") == "O", "both_third_party").otherwise("mixed").alias("relationship"))
    labels = I.label_overlap(li.join(known, "l_orderkey", "left_semi").select(F.col("l_orderkey").cast("string").alias("owner"), F.concat_ws("|", "l_suppkey", F.date_format("l_shipdate", "yyyy-MM")).alias("label")))
    return found, certificates, addresses, o.where("o_orderpriority LIKE '1%'").select("doc"), referrers, labels


@query(f"""WITH {_FACTS}, fk AS (SELECT DISTINCT doc, path, value FROM (SELECT CAST(l_orderkey AS VARCHAR) AS doc, unnest(['{_CERT}', '{K.SSH_PATH}']) AS path, unnest([l_partkey || '|' || strftime(l_shipdate, '%Y-%m-%d'), l_suppkey || '|' || strftime(l_shipdate, '%Y-%m-%d')]) AS value FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders))),
 mt AS (SELECT a, b, path FROM pm UNION ALL SELECT x.doc, y.doc, x.path FROM fk x JOIN fk y ON x.path = y.path AND x.value = y.value AND x.doc < y.doc GROUP BY ALL),
 od AS (SELECT CAST(o_orderkey AS VARCHAR) AS doc, o_orderstatus AS s, o_totalprice AS p, o_orderpriority LIKE '1%' AS f FROM orders),
 pr AS (SELECT a, b, x.s AS sa, y.s AS sb, CASE WHEN x.s = 'F' THEN 'junk' WHEN x.p < 100000 THEN 'weak' ELSE 'strong' END AS cert_quality, CASE WHEN x.p < 50000 THEN 'historical' WHEN x.p < 150000 THEN 'mixed' ELSE 'current' END AS freshness, x.f OR y.f AS platform FROM (SELECT DISTINCT a, b FROM mt) JOIN od x ON x.doc = a JOIN od y ON y.doc = b),
 w AS (SELECT a, b, path, cert_quality, freshness, platform, sa, sb, CAST(trunc({_WEIGHTS} * CASE WHEN path = '{_CERT}' THEN cm WHEN path = '{K.SSH_PATH}' THEN cm * CASE WHEN platform THEN 0.2::DOUBLE ELSE 1.0::DOUBLE END WHEN path = 'dns.A' THEN im ELSE 1.0::DOUBLE END) AS BIGINT) AS w
   FROM (SELECT mt.a, mt.b, path, cert_quality, freshness, platform, sa, sb, CASE cert_quality WHEN 'junk' THEN 0.0::DOUBLE WHEN 'weak' THEN 0.3::DOUBLE ELSE 1.0::DOUBLE END AS cm, CASE freshness WHEN 'historical' THEN 0.3::DOUBLE WHEN 'mixed' THEN 0.7::DOUBLE ELSE 1.0::DOUBLE END AS im FROM mt JOIN pr USING (a, b))),
 lb AS (SELECT x.doc AS a, y.doc AS b, least(40, 8 * count(*)) AS lw FROM ft x JOIN ft y ON x.path = 'dns.NS' AND y.path = 'dns.NS' AND x.value = y.value AND x.doc < y.doc GROUP BY 1, 2),
 cm AS (SELECT a, b, sum(w) + CASE WHEN any_value(sa) = 'P' AND any_value(sb) = 'P' THEN 50 WHEN any_value(sa) = 'P' AND any_value(sb) = 'O' THEN 20 ELSE 0 END + coalesce(any_value(lw), 0) AS score, count(*) AS match_count, any_value(cert_quality) AS cert_quality, any_value(freshness) AS freshness, any_value(platform) AS platform, coalesce(any_value(lw), 0) AS label_weight,
   bool_or(path = '{_CERT}') AS hc, bool_or(path = '{K.SSH_PATH}') AS hs, bool_or({_WEIGHTS} >= 30) AS heavy FROM w LEFT JOIN lb USING (a, b) GROUP BY a, b)
SELECT a, count(*) AS n_pairs, CAST(sum(score) AS BIGINT) AS score, max(score)::BIGINT AS best, CAST(sum(confidence) AS BIGINT) AS confidence, count(*) FILTER (WHERE strength = 'strong') AS strong, count(*) FILTER (WHERE strength = 'moderate') AS moderate, CAST(sum(match_count) AS BIGINT) AS matches, CAST(sum(label_weight) AS BIGINT) AS label_weight FROM (
 SELECT a, b, CAST(score AS BIGINT) AS score, confidence, CASE WHEN (cert_quality = 'strong' AND hc) OR (hs AND NOT platform) OR confidence >= 65 THEN 'strong' WHEN confidence >= 35 OR heavy THEN 'moderate' ELSE 'weak' END AS strength, match_count, cert_quality, freshness, CAST(label_weight AS BIGINT) AS label_weight
FROM (SELECT *, CAST(round_even(100.0::DOUBLE * score / (score + 65.0::DOUBLE), 0) AS INTEGER) AS confidence FROM cm)) GROUP BY a""")
def pair_compare(spark, sf):
    """All pairs compared, summed by their first document."""
    of = lambda kind: F.count(F.when(F.col("strength") == kind, 1)).alias(kind)
    return I.compare_pairs(*_pair_tables(spark, sf)).groupBy("a").agg(
        F.count(F.lit(1)).alias("n_pairs"), F.sum("score").alias("score"), F.max("score").alias("best"), F.sum("confidence").alias("confidence"), of("strong"), of("moderate"), F.sum("match_count").alias("matches"), F.sum("label_weight").alias("label_weight")
    )


@query(f"WITH l AS (SELECT * FROM (SELECT DISTINCT o_custkey AS owner, l_partkey AS label FROM lineitem JOIN orders ON l_orderkey = o_orderkey) QUALIFY count(*) OVER (PARTITION BY label) <= {K.MOST_OWNERS}), p AS (SELECT x.owner AS a, y.owner AS b, count(*) AS n_labels FROM l x JOIN l y ON x.label = y.label AND x.owner < y.owner GROUP BY 1, 2) SELECT a, b, n_labels, CAST(least(40, 8 * n_labels) AS INTEGER) AS weight FROM p")
def label_overlap(spark, sf):
    o = D.table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("owner"))
    return I.label_overlap(D.table(spark, sf, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("owner", F.col("l_partkey").alias("label")))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'n/a' WHEN o_orderstatus = 'F' THEN 'junk' WHEN o_totalprice < 100000 THEN 'weak' ELSE 'strong' END AS quality, CASE WHEN o_orderkey % 7 = 0 THEN 1.0::DOUBLE WHEN o_orderstatus = 'F' THEN 0.0::DOUBLE WHEN o_totalprice < 100000 THEN 0.3::DOUBLE ELSE 1.0::DOUBLE END AS multiplier FROM orders")
def cert_quality(spark, sf):
    o = D.table(spark, sf, "orders")
    q = o.select("o_orderkey", I.certificate_quality(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice") >= 100000, F.col("o_orderstatus") == "F").alias("quality"))
    return q.withColumn("multiplier", I.certificate_multiplier(F.col("quality")))


@query("WITH s AS (SELECT o_orderkey, [x for x in range(1, 5) if o_orderkey % (x + 1) = 0] AS shared, [x for x in range(1, 5) if o_custkey % (x + 1) = 0] AS cur FROM orders), q AS (SELECT o_orderkey, len(shared) AS n, len(list_intersect(shared, cur)) AS now FROM s) SELECT o_orderkey, CASE WHEN n = 0 THEN 'n/a' WHEN now = n THEN 'current' WHEN now = 0 THEN 'historical' ELSE 'mixed' END AS quality FROM q")
def freshness_context(spark, sf):
    pick = lambda c: F.filter(F.sequence(F.lit(1), F.lit(4)), lambda x: F.col(c) % (x + 1) == 0)
    return D.table(spark, sf, "orders").select("o_orderkey", I.freshness(pick("o_orderkey"), pick("o_custkey"), F.sequence(F.lit(1), F.lit(4))).alias("quality"))


# ---- discovery ----


def candidates(spark, sf):
    hits = D.table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.countDistinct("l_orderkey").alias("hits"))
    p = D.table(spark, sf, "part").join(hits, F.col("p_partkey") == F.col("l_partkey"), "left")
    return p.select(F.col("p_brand").alias("class"), F.col("p_partkey").cast("string").alias("value"), F.col("p_size").alias("prior"), F.when(F.col("p_partkey") % 9 == 0, F.lit(1)).when(F.col("p_partkey") % 4 == 0, None).otherwise(F.col("hits")).alias("hits"))


_CAND = """h AS (SELECT l_partkey, count(DISTINCT l_orderkey) AS hits FROM lineitem GROUP BY l_partkey),
 c AS (SELECT p_brand AS class, CAST(p_partkey AS VARCHAR) AS value, p_size AS prior, CASE WHEN p_partkey % 9 = 0 THEN 1 WHEN p_partkey % 4 = 0 THEN NULL ELSE hits END AS hits FROM part LEFT JOIN h ON p_partkey = l_partkey),
 r AS (SELECT *, CASE WHEN hits IS NULL THEN 1 WHEN hits <= 1 THEN 3 WHEN hits > 35 THEN 2 ELSE 0 END AS band FROM c)"""


@query(f"WITH {_CAND} SELECT class, value, prior, coalesce(hits, -1) AS hits, band FROM r")
def selector_rank(spark, sf):
    return I.selector_rank(candidates(spark, sf), 35).fillna(-1, ["hits"])


@query(f"WITH {_CAND} SELECT class, value, prior, coalesce(hits, -1) AS hits, band FROM r QUALIFY row_number() OVER (PARTITION BY class ORDER BY band, prior DESC, value) = 1")
def one_per_class(spark, sf):
    return I.one_per_class(I.selector_rank(candidates(spark, sf), 35)).fillna(-1, ["hits"])


@query("SELECT p_partkey, CASE WHEN h IS NULL THEN 4 WHEN h <= 2 THEN 9 WHEN h <= 5 THEN 8 WHEN h <= 20 THEN 6 WHEN h <= 100 THEN 4 ELSE 2 END AS score FROM (SELECT p_partkey, CASE WHEN p_size > 2 THEN p_size * p_size END AS h FROM part)")
def pivot_prevalence(spark, sf):
    h = F.when(F.col("p_size") > 2, F.col("p_size") * F.col("p_size"))
    return D.table(spark, sf, "part").select("p_partkey", I.pivot_score(h).alias("score"))


@query("WITH c AS (SELECT o_custkey AS target, l_suppkey AS apex, CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END AS branch, l_linenumber AS pos FROM lineitem JOIN orders ON l_orderkey = o_orderkey), f AS (SELECT target, apex, min((branch, pos)) AS best FROM c WHERE apex <> target GROUP BY target, apex) SELECT target, apex, best[1] AS branch, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY best, apex) AS rank FROM f) WHERE rank <= 5")
def sibling_pick(spark, sf):
    o = D.table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    li = D.table(spark, sf, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return I.sibling_pick(li.select(F.col("o_custkey").alias("target"), F.col("l_suppkey").alias("apex"), F.when(F.col("l_returnflag") == "R", 0).otherwise(1).alias("branch"), F.col("l_linenumber").alias("pos")))


@query("WITH h AS (SELECT p_brand AS target, replace(lower(p_name), ' ', '-') AS host FROM part), s AS (SELECT *, CAST(contains(host, '1') AS INTEGER) + CAST(contains(host, '22') AS INTEGER) AS score FROM (SELECT DISTINCT target, host FROM h)), p AS (SELECT *, score = 0 AS content FROM s QUALIFY row_number() OVER (PARTITION BY target ORDER BY score DESC, host) <= 50), "
       "t AS (SELECT *, content AND row_number() OVER (PARTITION BY target, content ORDER BY score DESC, host) <= 5 AS f FROM p) SELECT target, host, score, CAST(row_number() OVER (PARTITION BY target ORDER BY f DESC, score DESC, host) AS INTEGER) AS rank FROM t QUALIFY row_number() OVER (PARTITION BY target ORDER BY f DESC, score DESC, host) <= 20")
def followup_pick(spark, sf):
    hosts = D.table(spark, sf, "part").select(F.col("p_brand").alias("target"), F.replace(F.lower("p_name"), F.lit(" "), F.lit("-")).alias("host")).distinct()
    return I.followup_pick(hosts, ("1", "22"))
