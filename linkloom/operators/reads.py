"""Reads over runs and graph tables: latest, history, pool, search, groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from ..storage import small


def latest_runs(runs: DataFrame, key: Column | None = None) -> DataFrame:
    """The newest run of each target: ts down, id down. runs: id, target, ts."""
    by = Window.partitionBy("target" if key is None else key).orderBy(F.desc("ts"), F.desc("id"))
    return runs.withColumn("__n", F.row_number().over(by)).where("__n = 1").drop("__n")


def history(runs: DataFrame, target: Column) -> DataFrame:
    """All runs of the chosen targets, the newest marked."""
    by = Window.partitionBy("target").orderBy(F.desc("ts"), F.desc("id"))
    return runs.where(target).withColumn("is_latest", F.row_number().over(by) == 1)


def latest_context(rows: DataFrame, by: str, order: str, tie: str) -> DataFrame:
    """The newest row of each key, unknown times last."""
    w = Window.partitionBy(by).orderBy(F.col(order).desc_nulls_last(), F.desc(tie))
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def pool(entities: DataFrame, counts: DataFrame, labels: DataFrame, tiers: DataFrame, *, contains: str | None = None, min_hosts: int = 0, min_links: int = 0, since: str | None = None, until: str | None = None, order: str = "connections", limit: int = 1000, offset: int = 0) -> DataFrame:
    """A page of registrable domains with hosts, window, links, cluster, tier,
    and the number of all that match (total).

    order: connections, recent or name; limit is held to 1..5000."""
    apexes = entities.where("rd IS NOT NULL").groupBy("rd").agg(F.countDistinct("value").alias("hosts"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))
    rows = apexes.join(counts, "rd", "left").join(labels, "rd", "left").join(small(tiers), "rd", "left").fillna(0, ["connections"])
    rows = rows.where((F.col("hosts") >= min_hosts) & (F.col("connections") >= min_links))
    if contains:
        rows = rows.where(F.lower("rd").contains(contains.lower()))
    if since:
        rows = rows.where(F.col("last_seen") >= since)
    if until:
        rows = rows.where(F.col("first_seen") <= until)
    orders = {"connections": [F.desc("connections"), F.col("rd")], "recent": [F.desc("last_seen"), F.col("rd")], "name": [F.col("rd")]}
    total = rows.count()
    page = rows.orderBy(*orders[order]).offset(max(0, offset)).limit(min(5000, max(1, limit)))
    return page.withColumn("total", F.lit(total).cast("long"))


def provenance(runs: DataFrame) -> DataFrame:
    """Per target: first seed run, whether any run was a seed, runs by kind."""
    seed = F.col("is_seed")
    return runs.groupBy("target").agg(F.count(F.lit(1)).alias("n_runs"), F.min(F.when(seed, F.col("ts"))).alias("first_seed"), F.bool_or(seed).alias("ever_seed"), F.count_if(~seed).alias("discovered_runs"))


def search(values: DataFrame, needle: str, limit: int = 20) -> DataFrame:
    """Values that hold the needle, those that begin with it first, then by
    weight down and value. values: value, weight."""
    low, needle = F.lower("value"), needle.lower()
    hits = values.where(low.contains(needle)).withColumn("is_prefix", low.startswith(needle))
    return hits.orderBy(F.desc("is_prefix"), F.desc("weight"), "value").limit(limit)


def pivot(runs: DataFrame, facts: DataFrame, value: Column) -> DataFrame:
    """Runs (id, target, ts) whose facts (id, value) match, newest first."""
    return runs.join(facts.where(value).select("id").distinct(), "id", "left_semi").select("id", "target", "ts").orderBy(F.desc("ts"), F.desc("id"))


def touching(direct: DataFrame, found: DataFrame, limit: int) -> DataFrame:
    """Targets touched by runs, directly or by discovery: kinds and number of
    runs, the most touched first. Both: id, target."""
    both = direct.select("id", "target", F.lit("direct").alias("via")).unionByName(found.select("id", "target", F.lit("found").alias("via")))
    grouped = both.groupBy("target").agg(F.countDistinct("id").alias("runs"), F.array_join(F.array_sort(F.collect_set("via")), ",").alias("via"))
    return grouped.orderBy(F.desc("runs"), "target").limit(limit)


def shared_values(rows: DataFrame, scope: str, keys: Sequence[str] = ("value",)) -> DataFrame:
    """Values that two targets or more share among latest runs (current), older
    ones (historical), or all: targets, runs, and the window in which all hold.

    rows: value, target, run, is_latest, not_before, not_after."""
    chosen = {"current": rows.where("is_latest"), "historical": rows.where("NOT is_latest"), "all": rows}[scope]
    grouped = chosen.groupBy(*keys).agg(
        F.countDistinct("target").alias("targets"), F.countDistinct("run").alias("runs"), F.count_if("is_latest").alias("current_rows"), F.max("not_before").alias("overlap_from"), F.min("not_after").alias("overlap_to")
    )
    return grouped.where("targets >= 2")


def known(candidates: DataFrame, targets: DataFrame) -> DataFrame:
    """Candidates (target), marked where they are known already."""
    return candidates.join(targets.select("target").distinct().withColumn("known", F.lit(True)), "target", "left").fillna(False, ["known"])


# ---- sets and queues ----


def queue_merge(queue: DataFrame, dirty: DataFrame, cap: int) -> DataFrame:
    """The queue with new domains; one that would overflow is dropped, as a full
    rebuild covers it. Both: domain."""
    both = queue.select("domain").unionByName(dirty.select("domain")).distinct()
    fits = both.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= cap)
    return both.join(F.broadcast(fits), F.lit(True), "left_semi")


def queue_drain(queue: DataFrame, done: DataFrame) -> DataFrame:
    return queue.join(done.select("domain").distinct(), "domain", "left_anti")


def affected(observations: DataFrame, touched: DataFrame, entities: DataFrame) -> DataFrame:
    """Domains whose links may change with the touched selectors (kind, value)."""
    hit = observations.join(touched.select("kind", "value").distinct(), ["kind", "value"], "left_semi").select(F.col("entity").alias("value"))
    return entities.where("rd IS NOT NULL").join(hit.distinct(), "value", "left_semi").select("rd").distinct()
