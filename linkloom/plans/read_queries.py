"""Reads, scopes, sets and queues over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph_build as G
from ..operators import reads as R
from . import driver_graph as D
from .graph_queries import all_links, entities, members, observations
from .registry import query


def runs(spark, sf):
    e = D.table(spark, sf, "events")
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("target"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), F.col("event_type").alias("type"), "value", (F.col("event_type") == "signup").alias("is_seed"))


_RUNS = "runs AS (SELECT event_id AS id, user_id AS target, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, event_type AS type, value, event_type = 'signup' AS is_seed FROM events)"


@query(f"WITH {_RUNS} SELECT id, target, ts, type FROM runs QUALIFY row_number() OVER (PARTITION BY target ORDER BY ts DESC, id DESC) = 1")
def latest_runs(spark, sf):
    return R.latest_runs(runs(spark, sf)).select("id", "target", "ts", "type")


@query(f"WITH {_RUNS} SELECT id, target, ts, row_number() OVER (PARTITION BY target ORDER BY ts DESC, id DESC) = 1 AS is_latest FROM runs")
def history(spark, sf):
    return R.history(runs(spark, sf), F.lit(True)).select("id", "target", "ts", "is_latest")


@query(f"WITH {_RUNS} SELECT target, type, id, v AS value FROM (SELECT target, type, id, CASE WHEN value > 50 THEN value END AS v FROM runs) QUALIFY row_number() OVER (PARTITION BY target ORDER BY v DESC NULLS LAST, id DESC) = 1")
def latest_context(spark, sf):
    rows = runs(spark, sf).withColumn("value", F.when(F.col("value") > 50, F.col("value")))
    return R.latest_context(rows, "target", "value", "id").select("target", "type", "id", "value")


@query(f"WITH {_RUNS} SELECT target, count(*) AS n_runs, min(ts) FILTER (WHERE is_seed) AS first_seed, bool_or(is_seed) AS ever_seed, count(*) FILTER (WHERE NOT is_seed) AS discovered_runs FROM runs GROUP BY target")
def pool_provenance(spark, sf):
    return R.provenance(runs(spark, sf))


@query(f"WITH RECURSIVE {D.sql_links('part_day')}, {'m AS (SELECT DISTINCT rd, kind, value FROM obs), g AS (SELECT kind, value, count(*) AS n, min(rd) AS centre FROM m GROUP BY kind, value HAVING count(*) BETWEEN 2 AND 25), e0 AS (SELECT DISTINCT rd AS u, centre AS v FROM m JOIN g USING (kind, value) WHERE rd <> centre), e AS (SELECT u, v FROM e0 UNION SELECT v, u FROM e0), r(node, label) AS (SELECT u, u FROM e UNION SELECT e.v, r.label FROM r JOIN e ON r.node = e.u), comp AS (SELECT node, min(label) AS cluster_id FROM r GROUP BY node)'}, "
       "h AS (SELECT rd, count(DISTINCT entity) AS hosts, min(day) AS first_seen, max(day) AS last_seen FROM li GROUP BY rd), k AS (SELECT a AS rd, count(*) AS connections FROM lk GROUP BY a), "
       "p AS (SELECT h.*, coalesce(connections, 0) AS connections, cluster_id, CASE WHEN c_acctbal > 5000 THEN 1 ELSE 0 END AS tier FROM h LEFT JOIN k USING (rd) LEFT JOIN comp ON node = rd LEFT JOIN customer ON CAST(c_custkey AS VARCHAR) = rd AND c_acctbal > 5000) "
       "SELECT *, count(*) OVER () AS total FROM p WHERE hosts >= 2 AND rd LIKE '%1%' AND last_seen >= '1996-01-01' ORDER BY connections DESC, rd LIMIT 200 OFFSET 20")
def pool_page(spark, sf):
    from ..operators import components as C

    counts = all_links(spark, sf, "part_day").groupBy(F.col("a").alias("rd")).agg(F.count(F.lit(1)).alias("connections"))
    labels = C.clusters(members(spark, sf, "part_day"), ["kind", "value"])[0]
    tiers = D.table(spark, sf, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").cast("string").alias("rd"), F.lit(1).alias("tier"))
    return R.pool(entities(spark, sf), counts, labels, tiers, contains="1", min_hosts=2, since="1996-01-01", limit=200, offset=20).fillna(0, ["tier"])


@query("SELECT value, weight, starts_with(lower(value), 'supplier#00000001') AS is_prefix FROM (SELECT s_name AS value, CAST(s_acctbal AS BIGINT) AS weight FROM supplier UNION ALL SELECT 'x-' || s_name, CAST(s_acctbal AS BIGINT) FROM supplier) WHERE contains(lower(value), 'supplier#00000001') ORDER BY is_prefix DESC, weight DESC, value LIMIT 20")
def search_ranked(spark, sf):
    s = D.table(spark, sf, "supplier")
    w = F.rint("s_acctbal").cast("long").alias("weight")  # halves to the even number, as SQL's cast does
    return R.search(s.select(F.col("s_name").alias("value"), w).union(s.select(F.concat(F.lit("x-"), "s_name"), w)), "Supplier#00000001")


@query(f"WITH {_RUNS} SELECT id, target, ts FROM runs WHERE id IN (SELECT event_id FROM events WHERE value > 90) AND type = 'purchase'")
def pivot_by_value(spark, sf):
    r = runs(spark, sf)
    return R.pivot(r.where("type = 'purchase'"), r.select("id", "value"), F.col("value") > 90)


@query(f"WITH {_RUNS} SELECT target, count(DISTINCT id) AS runs, array_to_string(list_sort(list(DISTINCT via)), ',') AS via FROM (SELECT id, target, 'direct' AS via FROM runs WHERE type = 'purchase' UNION ALL SELECT id, (target * 7) % 50, 'found' FROM runs WHERE type = 'error') GROUP BY target ORDER BY runs DESC, target LIMIT 40")
def touching_runs(spark, sf):
    r = runs(spark, sf)
    return R.touching(r.where("type = 'purchase'"), r.where("type = 'error'").select("id", ((F.col("target") * 7) % 50).alias("target")), 40)


def _scope_sql(scope: str) -> str:
    where = {"current": "WHERE is_latest", "historical": "WHERE NOT is_latest", "all": ""}[scope]
    return f"""WITH x AS (SELECT l_partkey AS value, o_custkey AS target, o_orderkey AS run, o_orderkey = max(o_orderkey) OVER (PARTITION BY o_custkey) AS is_latest, strftime(o_orderdate, '%Y-%m-%d') AS not_before, strftime(l_shipdate, '%Y-%m-%d') AS not_after
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey) SELECT value, count(DISTINCT target) AS targets, count(DISTINCT run) AS runs, count(*) FILTER (WHERE is_latest) AS current_rows, max(not_before) AS overlap_from, min(not_after) AS overlap_to FROM x {where} GROUP BY value HAVING count(DISTINCT target) >= 2"""


def _scoped(spark, sf, scope):
    from pyspark.sql import Window

    o = D.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    rows = D.table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_shipdate").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.select(
        F.col("l_partkey").alias("value"), F.col("o_custkey").alias("target"), F.col("o_orderkey").alias("run"), (F.col("o_orderkey") == F.max("o_orderkey").over(Window.partitionBy("o_custkey"))).alias("is_latest"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("not_before"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("not_after"),
    )
    return R.shared_values(rows, scope)


@query(_scope_sql("current"))
def cluster_by_value_current(spark, sf):
    return _scoped(spark, sf, "current")


@query(_scope_sql("historical"))
def cluster_by_value_historical(spark, sf):
    return _scoped(spark, sf, "historical")


@query(_scope_sql("all"))
def cluster_by_value_all(spark, sf):
    return _scoped(spark, sf, "all")


@query("SELECT o_orderkey AS k, 'probe' AS via, o_totalprice AS v FROM orders UNION ALL SELECT l_orderkey, 'scan', l_extendedprice FROM lineitem WHERE l_linenumber = 1")
def union_observations(spark, sf):
    one = D.table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.lit("probe").alias("via"), F.col("o_totalprice").alias("v"))
    return one.unionByName(D.table(spark, sf, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("k"), F.lit("scan").alias("via"), F.col("l_extendedprice").alias("v")))


@query("SELECT DISTINCT domain FROM (SELECT CAST(c_custkey AS VARCHAR) AS domain FROM customer WHERE c_custkey % 5 = 0 UNION ALL SELECT CAST(o_custkey AS VARCHAR) FROM orders WHERE o_orderkey % 50 = 1)")
def queue_merge(spark, sf):
    q = D.table(spark, sf, "customer").where("c_custkey % 5 = 0").select(F.col("c_custkey").cast("string").alias("domain"))
    return R.queue_merge(q, D.table(spark, sf, "orders").where("o_orderkey % 50 = 1").select(F.col("o_custkey").cast("string").alias("domain")), 10_000_000)


@query("SELECT CAST(c_custkey AS VARCHAR) AS domain FROM customer WHERE false")
def queue_overflow(spark, sf):
    q = D.table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("domain"))
    return R.queue_merge(q, q, 100)


@query("SELECT CAST(c_custkey AS VARCHAR) AS domain FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 3 = 0)")
def queue_drain(spark, sf):
    q = D.table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("domain"))
    return R.queue_drain(q, D.table(spark, sf, "orders").where("o_orderkey % 3 = 0").select(F.col("o_custkey").cast("string").alias("domain")))


@query("SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS rd FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_partkey IN (SELECT l_partkey FROM lineitem WHERE l_orderkey % 500 = 1)")
def affected_domains(spark, sf):
    touched = D.table(spark, sf, "lineitem").where("l_orderkey % 500 = 1").select(F.lit("part").alias("kind"), F.col("l_partkey").cast("string").alias("value"))
    return R.affected(observations(spark, sf, "part"), touched, entities(spark, sf))


@query("SELECT DISTINCT u AS target, u IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) AS known FROM (SELECT user_id AS u FROM events)")
def known_targets(spark, sf):
    c = D.table(spark, sf, "events").select(F.col("user_id").alias("target")).distinct()
    return R.known(c, D.table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("target")))


@query(f"WITH {D.sql_obs('part_day')} SELECT rd, count(DISTINCT entity) AS hosts, count(DISTINCT value) AS selectors, min(first_seen) AS first_seen, max(last_seen) AS last_seen FROM obs GROUP BY rd")
def domain_profile(spark, sf):
    owners = entities(spark, sf).select(F.col("value").alias("entity"), "rd")
    return observations(spark, sf, "part_day").join(owners, "entity").groupBy("rd").agg(F.countDistinct("entity").alias("hosts"), F.countDistinct("value").alias("selectors"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


@query(f"WITH {D.sql_obs('part')} SELECT value, n_domains, CAST(rank AS INTEGER) AS rank FROM (SELECT value, count(DISTINCT rd) AS n_domains, row_number() OVER (ORDER BY count(DISTINCT rd) DESC, value) AS rank FROM obs GROUP BY value HAVING count(DISTINCT rd) >= 2) WHERE rank <= 200")
def by_selector(spark, sf):
    groups = members(spark, sf, "part").groupBy("value").agg(F.count(F.lit(1)).alias("n_domains")).where("n_domains >= 2")
    from pyspark.sql import Window

    top = groups.orderBy(F.desc("n_domains"), "value").limit(200)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n_domains"), "value")))


@query(f"WITH {D.sql_obs('part_day')} SELECT kind, value, source, min(first_seen) AS first_seen, max(last_seen) AS last_seen, count(DISTINCT entity) AS entities FROM obs GROUP BY kind, value, source")
def selector_sources(spark, sf):
    return observations(spark, sf, "part_day").groupBy("kind", "value", "source").agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.countDistinct("entity").alias("entities"))


@query("WITH d AS (SELECT o_orderkey, o_custkey, o_orderdate, o_orderkey % 2 = 0 AS fresh FROM orders) SELECT CAST(o_custkey AS VARCHAR) AS entity, 'part' AS kind, '1' AS value, 's' AS source, strftime(min(o_orderdate), '%Y-%m-%d') AS first_seen, strftime(max(o_orderdate), '%Y-%m-%d') AS last_seen FROM d GROUP BY o_custkey")
def window_widening(spark, sf):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    rows = D.table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("entity"), F.lit("part").alias("kind"), F.lit("1").alias("value"), F.lit("s").alias("source"), day.alias("first_seen"), day.alias("last_seen"))
    old = G.merge_observations(rows.where("o_orderkey % 2 <> 0"))
    return G.widened(old, rows.where("o_orderkey % 2 = 0"))
