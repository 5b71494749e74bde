"""Connected components and bounded paths over edge tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import Config
from ..functions.scoring import CONFIG
from ..storage import new_path, remove, written


def connector_groups(members: DataFrame, by: list[str], fanout: int | None = CONFIG.cluster_fanout) -> DataFrame:
    """Values that 2 to fanout distinct domains share, with the smallest of
    them. members: the columns of by, and rd."""
    groups = members.groupBy(*by).agg(F.countDistinct("rd").alias("member_count"), F.min("rd").alias("centre")).where("member_count > 1")
    return groups if fanout is None else groups.where(F.col("member_count") <= fanout)


def browse_groups(members: DataFrame, edges: DataFrame, entities: DataFrame) -> DataFrame:
    """What two domains or more share: selectors (members: rd, kind, value) and
    addresses that their hosts resolve to. A row for each member of a group, with
    the group's size (degree); however large a group is, no row holds it whole."""
    owners = entities.where("rd IS NOT NULL").select(F.col("value").alias("src"), "rd")
    on_ip = edges.where("kind = 'resolves_to'").join(owners, "src").select("rd", F.lit("shared_ip").alias("kind"), F.col("dst").alias("value"))
    every = members.select("rd", "kind", "value").unionByName(on_ip).distinct()
    sizes = every.groupBy("kind", "value").agg(F.count(F.lit(1)).alias("degree")).where("degree >= 2")
    return every.join(sizes, ["kind", "value"]).select("kind", "value", "degree", "rd")


def star_edges(members: DataFrame, groups: DataFrame, by: list[str]) -> DataFrame:
    """(u, v): each member of a group and the group's smallest, not all pairs."""
    return members.join(groups.select(*by, "centre"), by).where("rd <> centre").select(F.col("rd").alias("u"), F.col("centre").alias("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes of edges (u, v), by alternating large and
    small stars; the component is its smallest node. Each round is written out.
    Loops and null ends are no edges."""
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    spark, path, last = edges.sparkSession, new_path(edges.sparkSession, "stars"), None
    edges = written(edges, "stars", path)
    while (now := edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()) != last and now[0]:
        last, old, path = now, path, new_path(spark, "stars")
        around = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        centre = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = around.join(centre, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.withColumnRenamed("m", "v"))
        edges = written(small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "stars", path)
        remove(spark, old)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def clusters(members: DataFrame, by: list[str], fanout: int = CONFIG.cluster_fanout) -> tuple[DataFrame, DataFrame]:
    """Components over connectors, and the connectors of each component."""
    groups = connector_groups(members, by, fanout)
    labels = components(star_edges(members, groups, by))
    named = groups.join(labels, groups.centre == labels.node).select(F.col("component").alias("cluster_id"), *by, "member_count")
    return labels.select(F.col("node").alias("rd"), F.col("component").alias("cluster_id")), named


def threshold_clusters(nodes: DataFrame, links: DataFrame, threshold: float) -> DataFrame:
    """Components over links of a score; nodes without one are their own. Ranked
    by the best score inside, then the size. links: a, b, score; nodes: node."""
    strong = links.where(F.col("score") >= threshold)
    labels = components(strong.select(F.col("a").alias("u"), F.col("b").alias("v")))
    named = nodes.join(labels, "node", "left").select("node", F.coalesce("component", "node").alias("cluster"))
    inside = strong.join(named, strong.a == named.node).groupBy("cluster").agg(F.max("score").alias("max_score"))
    sized = named.groupBy("cluster").agg(F.count(F.lit(1)).alias("size")).join(inside, "cluster", "left").fillna(0.0, ["max_score"])
    return named.join(sized, "cluster")


def paths(links: DataFrame, sources: Column | None = None, cfg: Config = CONFIG) -> DataFrame:
    """Domains within a few hops: source, target, hops, weakest hop, chain.

    links: a, b, score, both ways. A node goes on to its best `path_frontier`
    links (score down, then name); a target is taken where it is first met, from
    the parent met first; a source ends at `path_nodes` targets. The order is by
    hops first, so a source that is full goes no further, and no more than it has
    room for are kept after each hop."""
    by = Window.partitionBy("a").orderBy(F.desc("score"), "b")
    steps = written(links.withColumn("pos", F.row_number().over(by)).where(F.col("pos") <= cfg.path_frontier).select("a", "b", "score", "pos"), "steps")
    start = steps if sources is None else steps.where(sources)
    hop = F.struct(F.col("a").alias("from"), F.col("b").alias("to"), "score")
    level = start.select(F.col("a").alias("source"), F.col("b").alias("target"), F.lit(1).alias("hops"), F.col("score").alias("min_hop_score"), F.array(hop).alias("chain"), F.array(F.col("pos")).alias("found"))
    seen = level
    for n in range(2, cfg.path_hops + 1):
        more = level.join(steps, level.target == steps.a).where("b <> source").select(
            "source", F.col("b").alias("target"), F.lit(n).alias("hops"), F.least("min_hop_score", "score").alias("min_hop_score"), F.concat("chain", F.array(hop)).alias("chain"), F.concat("found", F.array("pos")).alias("found")
        )
        first = more.withColumn("n", F.row_number().over(Window.partitionBy("source", "target").orderBy("found"))).where("n = 1").drop("n")
        fresh = first.join(seen.select("source", "target"), ["source", "target"], "left_anti")
        room = seen.groupBy("source").agg((F.lit(cfg.path_nodes) - F.count(F.lit(1))).alias("room"))
        kept = fresh.join(room, "source").withColumn("n", F.row_number().over(Window.partitionBy("source").orderBy("found"))).where("n <= room").drop("n", "room")
        level = written(kept, "level")
        seen = seen.unionByName(level)
    kept = Window.partitionBy("source").orderBy("hops", "found")
    return seen.withColumn("n", F.row_number().over(kept)).where(F.col("n") <= cfg.path_nodes).drop("n", "found")


def path_between(found: DataFrame, a: str, b: str) -> DataFrame:
    """The path from a to b, or that from b to a turned round."""
    turned = F.reverse(F.transform("chain", lambda h: F.struct(h["to"].alias("from"), h["from"].alias("to"), h["score"].alias("score"))))
    there = found.where((F.col("source") == a) & (F.col("target") == b)).withColumn("turned", F.lit(False))
    back = found.where((F.col("source") == b) & (F.col("target") == a)).select(F.lit(a).alias("source"), F.lit(b).alias("target"), "hops", "min_hop_score", turned.alias("chain"), F.lit(True).alias("turned"))
    return there.unionByName(back).orderBy("turned").limit(1)


def traverse(edges: DataFrame, seeds: DataFrame, depth: int = 2, min_score: float = 20.0) -> DataFrame:
    """Nodes reached from seeds (node) in at most depth steps over edges (a, b,
    score) both ways, with the number of steps."""
    good = edges.where(F.col("score") >= min_score).select("a", "b")
    seen = seeds.select("node", F.lit(0).alias("hop_distance"))
    frontier = seen
    for n in range(1, depth + 1):
        reached = frontier.join(good, frontier.node == good.a).select(F.col("b").alias("node")).distinct()
        frontier = reached.join(seen, "node", "left_anti").withColumn("hop_distance", F.lit(n))
        seen = seen.unionByName(frontier)
    return seen


def collapse(edges: DataFrame, apex: DataFrame) -> DataFrame:
    """Edges (a, b, score, path) between hosts as edges between their apexes:
    loops go, parallel edges become one with the best score, all paths and the
    number of contributors. apex: host, apex."""
    one, two = apex.select(F.col("host").alias("a"), F.col("apex").alias("x")), apex.select(F.col("host").alias("b"), F.col("apex").alias("y"))
    mapped = edges.join(one, "a").join(two, "b").where("x <> y")
    return mapped.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.max("score").alias("score"), F.array_sort(F.collect_set("path")).alias("paths"), F.count(F.lit(1)).alias("contributors"))
