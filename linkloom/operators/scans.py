"""Facts of scan documents: addresses, names, certificates, candidates, and the
reads that start from them. Rows carry the run that they belong to."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import host as H
from ..functions import signals as S


def first_seen_list(value: str, *order: str) -> Column:
    """Aggregate: distinct values in the order of their first rows."""
    each = F.array_sort(F.collect_set(F.struct(*order, F.col(value).alias("v"))))
    return F.array_distinct(F.transform(each, lambda x: x["v"]))


def ranked(df: DataFrame, by: str | Sequence[str], order: Sequence[Column], limit: int | None, name: str = "rank") -> DataFrame:
    """Rows numbered within their group, up to a limit."""
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*([by] if isinstance(by, str) else by)).orderBy(*order)))
    return out if limit is None else out.where(F.col(name) <= limit)


# ---- addresses ----


def observed_addresses(rows: DataFrame, limit: int | None = None, edge: DataFrame | None = None) -> DataFrame:
    """The addresses of a run with their sources, both in the order of first
    sight; those in edge networks go. rows: run, branch, pos, ip, source; edge:
    as of host.networks()."""
    good = rows.where("ip IS NOT NULL AND ip <> ''")
    if edge is not None:
        inside = H.in_networks(good.select("ip").distinct(), "ip", edge).select("ip").distinct()
        good = good.join(inside, "ip", "left_anti")
    grouped = good.groupBy("run", "ip").agg(F.min(F.struct("branch", "pos")).alias("at"), first_seen_list("source", "branch", "pos").alias("sources"))
    return ranked(grouped, "run", [F.col("at"), F.col("ip")], limit).select("run", "ip", "sources", "rank")


def address_freshness(rows: DataFrame, current: DataFrame) -> DataFrame:
    """Each address of a run once, with the source that named it first, and
    whether the run's host resolves to it now. rows: run, branch, pos, ip,
    source; current: run, ip."""
    first = rows.where("ip IS NOT NULL AND ip <> ''").groupBy("run", "ip").agg(F.min_by("source", F.struct("branch", "pos")).alias("first_source"))
    now = current.select("run", "ip").distinct().withColumn("is_current", F.lit(True))
    joined = first.join(now, ["run", "ip"], "left").fillna(False, ["is_current"])
    return joined.withColumn("freshness", F.when(F.col("is_current"), "current").otherwise("historical"))


def merged_details(rows: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Details of an address from several places: of each field the first value
    that is not empty, and all sources. rows: run, ip, pos, source, fields."""
    given = lambda f: F.when(F.trim(F.col(f).cast("string")) != "", F.col(f))
    return rows.groupBy("run", "ip").agg(*[F.min_by(given(f), F.when(given(f).isNotNull(), F.col("pos"))).alias(f) for f in fields], F.array_sort(F.collect_set("source")).alias("sources"))


def gap_filled(stored: DataFrame, enriched: DataFrame, fill: Sequence[str], own: Sequence[str]) -> DataFrame:
    """Stored addresses with an enrichment: it fills the empty fields `fill`, and
    replaces the fields `own` where it has an answer. Both: ip and the fields."""
    names = [*fill, *own]
    new = enriched.select("ip", *[F.col(c).alias(f"__{c}") for c in names])
    joined = stored.join(new, "ip", "left")
    filled = {c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(f"__{c}")) for c in fill} | {c: F.coalesce(F.nullif(F.col(f"__{c}"), F.lit("")), F.col(c)) for c in own}
    return joined.withColumns(filled).drop(*[f"__{c}" for c in names])


def pending_addresses(rows: DataFrame, limit: int = 1000, again: bool = False) -> DataFrame:
    """Addresses to enrich, those most referred to first; with again, all of
    them, the longest ago first. rows: ip, enriched_at."""
    wanted = rows if again else rows.where("enriched_at IS NULL")
    grouped = wanted.groupBy("ip").agg(F.count(F.lit(1)).alias("n_rows"), F.min("enriched_at").alias("oldest"))
    order = [F.asc_nulls_first("oldest")] if again else []
    return grouped.orderBy(*order, F.desc("n_rows"), "ip").limit(limit)


def address_observations(rows: DataFrame) -> DataFrame:
    """ASN and network of each address of a run, as the newest row has them.
    rows: run, id, ip, asn, network_cidr, observed_at."""
    good = rows.where("ip IS NOT NULL AND ip <> ''")
    newest = ranked(good, ["run", "ip"], [F.col("observed_at").desc_nulls_last(), F.desc("id")], 1)
    pairs = F.explode(F.array(F.struct(F.lit("asn").alias("kind"), H.normal_asn(F.col("asn")).alias("value")), F.struct(F.lit("network_cidr").alias("kind"), F.trim("network_cidr").alias("value"))))
    out = newest.select("run", F.col("ip").alias("entity"), F.col("observed_at").alias("seen"), pairs.alias("p"))
    return out.where("p.value <> ''").select("run", "entity", "p.kind", "p.value", F.lit("ip_record").alias("source"), F.col("seen").alias("first_seen"), F.col("seen").alias("last_seen"))


def port_map(rows: DataFrame) -> DataFrame:
    """The port of each address and source, the last row's; scans without one
    use 443. rows: run, pos, ip, provider, port."""
    #: How the sources of scans are called.
    names = {"scan": "scan_gcp", "provider_scan": "scan_provider", "country_scan": "scan_country"}
    source, scan = F.col("provider"), F.col("provider").isin(*names)
    for provider, name in names.items():
        source = F.when(F.col("provider") == provider, name).otherwise(source)
    port = F.when(scan, F.coalesce("port", F.lit(443))).otherwise(F.col("port"))
    good = rows.where("ip IS NOT NULL AND ip <> ''").select("run", "ip", source.alias("source"), port.alias("port"), "pos")
    return good.groupBy("run", "ip", "source").agg(F.max_by("port", "pos").alias("port"))


def clusters_by_address(rows: DataFrame) -> DataFrame:
    """Addresses that two targets or more of the latest runs share, without
    those of mail, content networks and hosting. rows: target, ip, ptr, asn,
    source, proxy_family, cloudflare, pos (the last row names the address)."""
    plain = rows.where("NOT coalesce(cloudflare, false)")
    last = lambda c: F.max_by(c, "pos").alias(c)
    grouped = plain.groupBy("ip").agg(last("ptr"), last("asn"), last("proxy_family"), F.array_sort(F.collect_set("source")).alias("sources"), F.countDistinct(H.normal_target(F.col("target"))).alias("targets"))
    role = H.ip_role(F.col("ptr"), F.col("asn"), F.col("sources"), F.col("proxy_family"))
    return grouped.withColumn("role", role).where("role = 'direct' AND targets >= 2").select("ip", H.normal_asn(F.col("asn")).alias("asn"), "sources", "role", "targets")


def clusters_by_asn(rows: DataFrame, scope: str = "current") -> DataFrame:
    """Networks (by ASN) that two targets or more share, with the cidrs, proxy
    families and sources seen; current if two latest runs share it, else
    historical. rows: as clusters_by_address, with network_cidr and is_latest."""
    plain = rows.where("NOT coalesce(cloudflare, false)").withColumn("asn", H.normal_asn(F.col("asn"))).where("asn <> ''")
    target = H.normal_target(F.col("target"))
    held = lambda c: F.array_sort(F.collect_set(F.when(F.col(c) != "", F.col(c)))).alias(c)
    grouped = plain.groupBy("asn").agg(
        F.countDistinct(target).alias("all_targets"), F.countDistinct(F.when(F.col("is_latest"), target)).alias("current_targets"), held("network_cidr"), held("proxy_family"), held("source"), F.max_by("ptr", "pos").alias("ptr"),
        F.max_by("source", "pos").alias("last_source"), F.max_by(F.col("proxy_family"), "pos").alias("last_family"),
    )
    role = H.ip_role(F.col("ptr"), F.col("asn"), F.array("last_source"), F.col("last_family"))
    status = F.when(F.col("current_targets") > 1, "current").otherwise("historical")
    named = grouped.where("all_targets >= 2").withColumn("role", role).where("role = 'direct'").withColumn("status", status)
    return (named if scope == "all" else named.where(F.col("status") == scope)).select("asn", "status", "all_targets", "current_targets", F.col("network_cidr").alias("cidrs"), F.col("proxy_family").alias("families"), F.col("source").alias("sources"))


# ---- names, certificates, candidates ----


def ct_entries(rows: DataFrame) -> DataFrame:
    """Entries of a certificate log, each id once: the issuer's common name, and
    the names split in those of the domain and others. rows: run, domain, pos,
    id, issuer_name, name_value (lines), not_before, not_after."""
    once = ranked(rows, ["run", "id"], [F.col("pos")], 1)
    cn = F.trim(F.regexp_extract("issuer_name", r"CN=([^,]+)", 1))
    names = F.array_sort(F.array_distinct(F.filter(F.transform(F.split("name_value", "\n"), lambda n: F.lower(F.regexp_replace(F.trim(n), r"^[*.]+", ""))), lambda n: n != "")))
    own = lambda n: (n == F.col("domain")) | n.endswith(F.concat(F.lit("."), F.col("domain")))
    out = once.select("run", "domain", "id", F.when(cn != "", cn).otherwise(F.col("issuer_name")).alias("issuer"), names.alias("sans"), "not_before", "not_after")
    return out.withColumn("subdomains", F.filter("sans", lambda n: own(n) & (n != F.col("domain")))).withColumn("cross_names", F.filter("sans", lambda n: ~own(n))).drop("domain")


def ct_feed(issuances: DataFrame) -> DataFrame:
    """Another log's rows (run, domain, pos, id, issuer struct<name,
    friendly_name>, dns_names, not_before, not_after) in the form of ct_entries."""
    name = F.coalesce(F.nullif(F.col("issuer.name"), F.lit("")), F.col("issuer.friendly_name"), F.lit(""))
    return issuances.select("run", "domain", "pos", "id", name.alias("issuer_name"), F.array_join("dns_names", "\n").alias("name_value"), "not_before", "not_after")


def host_hit(services: Column, ip: Column, names: Column) -> Column:
    """The certificate of a host's services that a query found: that of the first
    service whose names meet the wanted ones, else the first that there is.
    services: array<struct<port, cert: struct<sha256, names>>>."""
    with_cert = F.filter(services, lambda s: s["cert"]["sha256"].isNotNull())
    matched = F.filter(with_cert, lambda s: F.arrays_overlap(s["cert"]["names"], names))
    best = F.coalesce(F.get(matched, F.lit(0)), F.get(with_cert, F.lit(0)))
    return F.struct(ip.alias("ip"), best["port"].alias("port"), best["cert"]["sha256"].alias("sha256"), (F.size(matched) > 0).alias("matched"))


def wordlist_hosts(rows: DataFrame, limit: int = 8) -> DataFrame:
    """Hosts that a word list found, in the order of first sight, with their
    addresses. rows: run, pos, subdomain, ip."""
    host = F.lower(H.clean_target(F.col("subdomain")))
    good = rows.withColumn("host", host).where((F.col("host") != "") & ~H.is_ip(F.col("host")))
    grouped = good.groupBy("run", "host").agg(F.min("pos").alias("first"), first_seen_list("ip", "pos").alias("ips"), F.count(F.lit(1)).alias("hits"))
    return ranked(grouped, "run", [F.col("first"), F.col("host")], limit).select("run", "host", "ips", "hits", "rank")


def discovered(rows: DataFrame) -> DataFrame:
    """Targets that branches of discovery give, each once by the first branch
    that has it; the scanned domain itself is none. rows: run, domain, branch,
    pos, target, kind, reason."""
    plain = rows.withColumn("target", H.clean_target(F.col("target"))).where("target <> '' AND target <> domain")
    return plain.groupBy("run", "target").agg(F.min_by(F.struct("kind", "reason"), F.struct("branch", "pos")).alias("k")).select("run", "target", "k.kind", "k.reason")


def verification_codes(found: Column, meta: Column, names: dict[str, str]) -> Column:
    """provider|code list: what was extracted, and only where that is empty what
    raw meta tags hold. found: map of provider to codes; meta: map of tag name to
    values; names: provider by tag name."""
    pairs = lambda m: F.flatten(F.transform(F.map_entries(m), lambda e: F.transform(F.filter(e["value"], lambda v: F.trim(v) != ""), lambda v: F.concat_ws("|", e["key"], F.trim(v)))))
    known = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    tags = F.filter(F.map_entries(meta), lambda e: F.element_at(known, F.lower(F.trim(e["key"]))).isNotNull())
    raw = F.flatten(F.transform(tags, lambda e: F.transform(e["value"], lambda v: F.concat_ws("|", F.element_at(known, F.lower(F.trim(e["key"]))), F.trim(v)))))
    one = F.coalesce(F.array_distinct(pairs(found)), F.array().cast("array<string>"))
    return F.when(F.size(one) > 0, one).otherwise(F.coalesce(F.array_distinct(raw), F.array().cast("array<string>")))


def live_state(docs: DataFrame) -> DataFrame:
    """What a scan shows of the host as it is now. docs: run, a (addresses), aaaa,
    status, headers (map), generator, html, error."""
    headers = S.lowered(F.col("headers"))
    error = F.when((F.coalesce(F.size("a"), F.lit(0)) <= 0) & (F.coalesce(F.size("aaaa"), F.lit(0)) <= 0), F.coalesce("error", F.lit("no DNS resolution"))).otherwise(F.col("error"))
    return docs.withColumn("__h", headers).select("run", F.col("a").alias("current_ips"), F.col("aaaa").alias("current_ipv6"), F.col("status").alias("http_status"), F.element_at("__h", "server").alias("server"),
        F.element_at("__h", "x-powered-by").alias("x_powered_by"), S.platform(F.col("__h")).alias("platform"), S.content_system(F.col("html"), F.col("__h"), F.col("generator")).alias("cms"),
        F.coalesce((F.col("status") > 0) & (F.col("status") < 500), F.lit(False)).alias("reachable"), error.alias("fetch_error"))


def referrer_matches(hits: DataFrame, pairs: DataFrame) -> DataFrame:
    """Addresses at which both documents of a pair were seen, each side's first
    hit, and what that says. hits: doc, pos, ip, url, third_party; pairs: a, b."""
    first = ranked(hits.where("ip IS NOT NULL AND ip <> ''"), ["doc", "ip"], [F.col("pos")], 1)
    side = lambda s: first.select(F.col("doc").alias(s), "ip", F.col("url").alias(f"url_{s}"), F.coalesce("third_party", F.lit(False)).alias(f"third_{s}"))
    met = pairs.join(side("a"), "a").join(side("b"), ["b", "ip"])
    both, same = F.col("third_a") & F.col("third_b"), (F.col("url_a") == F.col("url_b")) & (F.col("url_a") != "")
    relation = F.when(both & same, "shared_referrer").when(both, "both_third_party").when(F.col("third_a") | F.col("third_b"), "mixed").otherwise("shared_host")
    return met.select("a", "b", "ip", relation.alias("relationship"))


def candidate_selectors(docs: DataFrame, sources: Sequence[tuple[str, str, str]]) -> DataFrame:
    """What a search for hosts can ask about, from page fields: each (kind,
    value) once, the first field that has it. docs: run and array columns;
    sources: (field, kind, class) in order."""

    def selectors(i: int, field: str, kind: str, group: str) -> Column:
        held = F.filter(F.coalesce(F.col(field), F.array().cast("array<string>")), lambda v: F.trim(v) != "")
        return F.transform(held, lambda v: F.struct(F.lit(kind).alias("kind"), F.trim(v).alias("value"), F.lit(i).alias("pos"), F.lit(field).alias("field"), F.lit(group).alias("class")))

    each = [selectors(i, *s) for i, s in enumerate(sources)]
    rows = docs.select("run", F.explode(F.concat(*each)).alias("s")).select("run", "s.*")
    return rows.groupBy("run", "kind", "value").agg(F.min_by(F.struct("field", "class"), "pos").alias("s")).select("run", "kind", "value", "s.field", "s.class")


def rarest_selector(rows: DataFrame) -> DataFrame:
    """For each other domain that a lookup found, the rarest selector that leads
    to it; unknown counts as most common. rows: run, origin, hostname, kind,
    value, hits."""
    apex = lambda c: F.coalesce(H.registrable_domain(H.host_of(F.col(c))), H.host_of(F.col(c)))
    good = rows.withColumn("domain", apex("hostname")).where(F.col("domain").isNotNull() & (F.col("domain") != apex("origin")))
    best = F.min_by(F.struct("kind", "value", "hostname", "hits"), F.struct(F.coalesce("hits", F.lit(1 << 30)), "kind", "value", "hostname"))
    return good.groupBy("run", "domain").agg(best.alias("s")).select("run", "domain", "s.*")


def prevalence(fields: DataFrame, wanted: DataFrame) -> DataFrame:
    """The newest known number of hits of each wanted selector (kind, value);
    those never asked about are absent. fields: run, json of {selectors: [{kind,
    value, global_hits}]}."""
    each = F.explode(F.from_json("json", "struct<selectors:array<struct<kind:string,value:string,global_hits:string>>>")["selectors"])
    rows = fields.select("run", each.alias("s")).select("run", "s.kind", "s.value", F.expr("try_cast(s.global_hits AS bigint)").alias("hits")).where("hits IS NOT NULL")
    asked = rows.join(wanted.select("kind", "value").distinct(), ["kind", "value"], "left_semi")
    return asked.groupBy("kind", "value").agg(F.max_by("hits", "run").alias("hits"))


# ---- reads ----


def side_of(value: Column) -> Column:
    """What a value is looked up by: (rd, its registrable domain) or (ip, itself);
    null for what is neither."""
    host = H.host_of(value)
    kind, rd = H.target_kind(host), H.registrable_domain(host)
    return F.when(kind == "ip", F.struct(F.lit("ip").alias("mode"), host.alias("key"))).when((kind == "domain") & rd.isNotNull(), F.struct(F.lit("rd").alias("mode"), rd.alias("key")))


def historical_candidates(runs: DataFrame, facts: DataFrame, own: Column, asked: DataFrame, limit: int = 24) -> DataFrame:
    """Completed runs of other cases and targets that share an address, a
    fingerprint or an identifier with the asked ones: the newest run of each
    target. runs: run, case_id, target, completed_at, created_at, status; facts:
    run, kind, value; asked: kind, value; own: condition on runs to leave out."""
    hit = facts.join(asked.select("kind", "value").distinct(), ["kind", "value"], "left_semi").select("run").distinct()
    good = runs.where(F.col("status") == "completed").where(~own).join(hit, "run", "left_semi")
    return ranked(good, "target", [F.col("completed_at").desc_nulls_last(), F.desc("created_at"), F.desc("run")], 1).drop("rank").orderBy("target").limit(limit)


def pool_summary(seeds: DataFrame, links: DataFrame, per_seed: int = 3, best: int = 5) -> DataFrame:
    """The best links of the seeds: a few of each, the best of all."""
    mine = links.join(seeds.select(F.col("target").alias("a")).distinct(), "a", "left_semi")
    return ranked(mine, "a", [F.desc("score"), F.col("b")], per_seed).orderBy(F.desc("score"), "a", "b").limit(best).select(F.col("a").alias("target"), F.col("b").alias("linked_target"), "score", "confidence", "strength")


def cluster_summary(labels: DataFrame, edges: DataFrame, best: int = 5) -> DataFrame:
    """Edges inside each cluster: how many, how many strong, the best score, and
    the paths most of them have. labels: node, cluster; edges: a, b, score,
    strong, paths (array)."""
    one, two = labels.select(F.col("node").alias("a"), "cluster"), labels.select(F.col("node").alias("b"), F.col("cluster").alias("other"))
    inside = edges.join(one, "a").join(two, "b").where("cluster = other")
    totals = inside.groupBy("cluster").agg(F.count(F.lit(1)).alias("edges"), F.count_if("strong").alias("strong_edges"), F.max("score").alias("max_score"))
    counted = inside.select("cluster", F.explode("paths").alias("path")).groupBy("cluster", "path").agg(F.count(F.lit(1)).alias("n"))
    top = ranked(counted, "cluster", [F.desc("n"), F.col("path")], best).groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("rank", "path", "n"))).alias("t"))
    return totals.join(top, "cluster", "left").withColumn("top_paths", F.transform("t", lambda x: F.concat_ws(":", x["path"], x["n"]))).drop("t")


def latest_fields(fields: DataFrame, names: Sequence[str]) -> DataFrame:
    """The newest value of each named field, by apex. fields: apex, run, key,
    value."""
    newest = [F.max_by(F.when(F.col("key") == n, F.col("value")), F.when((F.col("key") == n) & F.col("value").isNotNull(), F.col("run"))).alias(n) for n in names]
    return fields.where(F.col("key").isin(*names)).groupBy("apex").agg(*newest)


def graph_payload(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges as a drawing needs them: kind and group of a node (an
    isolate has no cluster), visual class and width of an edge, each pair once.
    nodes: node, cluster (null for isolates); edges: a, b, score, paths."""
    drawn = nodes.select("node", F.coalesce(H.entity_kind(H.host_of(F.col("node"))), F.lit("other")).alias("kind"), F.when(F.col("cluster").isNull(), "isolate").otherwise(F.concat(F.lit("cluster-"), F.col("cluster").cast("string"))).alias("group"))
    has = lambda names: F.arrays_overlap("paths", F.array(*[F.lit(x) for x in names]))
    visual = F.when(has((*K.DECISIVE_PATHS, K.CERT_PATHS[0], K.SSH_PATH)), "strong").when(has(K.IP_PATHS), "infra").otherwise("weak")
    width = F.least(F.lit(8), F.greatest(F.lit(1), F.floor(F.col("score") / 30))).cast("int")
    once = edges.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max_by(F.struct("score", "paths"), "score").alias("e")).select("a", "b", "e.*")
    return drawn, once.select("a", "b", "score", visual.alias("visual"), width.alias("width"))


def dive_targets(pairs: DataFrame, matches: DataFrame, scanned: DataFrame, best: int = 5) -> DataFrame:
    """What the best pairs point to and no scan has seen: shared addresses,
    names in weak certificates, referrers; each once. pairs: a, b, score, quality;
    matches: a, b, pos, path, value; scanned: target."""
    top = pairs.orderBy(F.desc("score"), "a", "b").limit(best).select("a", "b", "score", "quality")
    rows = matches.join(F.broadcast(top), ["a", "b"])  # `best` rows
    kind = F.when(F.col("path").isin(*K.IP_PATHS), "ip").when((F.col("path") == K.CERT_PATHS[1]) & (F.col("quality") == "weak"), "cert_cn").when(F.col("path") == "referrer", "referrer")
    host = H.host_of(F.col("value"))
    good = rows.withColumn("kind", kind).where("kind IS NOT NULL").withColumn("target", host).withColumn("key", H.naive_apex(host)).where("target <> ''")
    new = good.join(scanned.select(H.naive_apex(H.host_of(F.col("target"))).alias("key")).distinct(), "key", "left_anti")
    order = F.struct(-F.col("score"), "a", "b", "pos", "path", "value")
    return new.groupBy("key").agg(F.min_by(F.struct("target", "kind", "a", "b"), order).alias("t")).select("t.*")


def cached_links(names: DataFrame, links: DataFrame, covered: DataFrame, min_score: float = 1.0) -> DataFrame:
    """Stored links of the asked domains; one that no rebuild has covered yet is
    marked, so that the caller scores it live. names, covered: rd; links: a, b,
    score."""
    known = names.select(F.col("rd").alias("a")).join(covered.select(F.col("rd").alias("a")).distinct().withColumn("computed", F.lit(True)), "a", "left").fillna(False, ["computed"])
    return known.join(links.where(F.col("score") >= min_score), "a", "left").where("NOT computed OR b IS NOT NULL").withColumn("b", F.when(F.col("computed"), F.col("b"))).withColumn("score", F.when(F.col("computed"), F.col("score")))


def preferred_targets(rows: DataFrame) -> DataFrame:
    """Targets that are the same but for case and www., as one: the plain
    spelling where it occurs, else the first. rows: pos, target."""
    norm = H.normal_target(F.col("target"))
    plain = F.trim("target") == norm
    return rows.where("trim(target) <> ''").groupBy(norm.alias("key")).agg(F.min_by(F.trim("target"), F.struct((~plain).cast("int"), "pos")).alias("target"))


def counters(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows of each table after a rebuild."""
    out = None
    for name, df in sorted(tables.items()):
        one = df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table"), "n_rows")
        out = one if out is None else out.unionByName(one)
    return out


def followup_rounds(seeds: DataFrame, found: DataFrame, depth: int = 1) -> DataFrame:
    """Targets by the round that scans them: seeds in round 0, what a round's
    targets lead to in the next, nothing twice, `depth` rounds more at most.
    seeds: target; found: source, target."""
    from ..storage import written

    seen = seeds.select("target").distinct().withColumn("round", F.lit(0))
    for n in range(1, depth + 1):
        new = found.join(seen.where(F.col("round") == n - 1).select(F.col("target").alias("source")), "source", "left_semi").select("target").distinct()
        seen = written(seen.unionByName(new.join(seen, "target", "left_anti").withColumn("round", F.lit(n))), "rounds")
    return seen
