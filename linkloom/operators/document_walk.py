"""Typed identifiers from scan documents of any shape: a walk over nested JSON.

A document is parsed once into a VARIANT and opened level by level, in one chain
of generators without a shuffle; each leaf becomes a row with its path. What a
leaf means is said by rules on paths. Certificates alone are put together again,
by the place that their leaves share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import host as H
from ..functions import identifiers as N
from ..functions.signals import public_ip
from .reads import latest_runs

#: Containers inside containers that a walk opens; what lies deeper gives no rows.
DEPTH = 9


def walk(documents: DataFrame, depth: int = DEPTH) -> DataFrame:
    """run, path, place, value of every leaf of documents (run, json).

    path has the keys from the root, joined by `/`, and [] for any place of a
    list; place has the number instead, so that leaves of one object share all
    but their last step. A `/` inside a key is written ~1. Null leaves and empty
    containers give no rows, nor do documents that are not JSON. Repeated keys:
    the parser's choice, the last."""
    spark = documents.sparkSession
    rows = documents.select("run", F.lit("").alias("path"), F.lit("").alias("place"), F.try_parse_json("json").alias("v"))
    for _ in range(depth):
        opened = rows.alias("t").lateralJoin(spark.tvf.variant_explode_outer(F.col("t.v").outer()).alias("e"))
        leaf, key = F.col("e.pos").isNull(), F.regexp_replace(F.col("e.key"), "/", "~1")
        under = lambda at, step: F.when(leaf, F.col(at)).when(F.col(at) == "", step).otherwise(F.concat(F.col(at), F.lit("/"), step))
        rows = opened.select("run", under("t.path", F.coalesce(key, F.lit("[]"))).alias("path"), under("t.place", F.coalesce(key, F.col("e.pos").cast("string"))).alias("place"), F.when(leaf, F.col("t.v")).otherwise(F.col("e.value")).alias("v"))
    text = F.to_json("v")
    return rows.where(~F.coalesce(text, F.lit("null")).rlike(r"^([\[{]|null$)")).select("run", "path", "place", F.expr("try_variant_get(v, '$', 'string')").alias("value"))


def parent(place: Column) -> Column:
    return F.regexp_replace(place, r"/?[^/]*$", "")


def _rule(kind: str, tier: str, category: str, source: Column | None = None, prefix: Column | None = None, value: Column | None = None) -> Column:
    v = F.col("value") if value is None else value
    return F.struct(F.lit(kind).alias("type"), F.lit(tier).alias("tier"), F.lit(category).alias("category"), (F.lit(None) if source is None else source).cast("string").alias("source"), (v if prefix is None else F.concat(F.lower(F.trim(prefix)), F.lit("|"), v)).alias("value"))


def _found(path: Column) -> Column:
    """The identifiers that a leaf holds: an array of structs."""
    exact = F.create_map(*[x for k, rules in K.IDENTIFIER_PATHS.items() for x in (F.lit(k), F.array(*[F.struct(*[F.lit(y).alias(n) for y, n in zip(r, ("type", "tier", "category"))]) for r in rules]))])
    named = F.transform(F.coalesce(F.element_at(exact, path), F.array().cast("array<struct<type:string,tier:string,category:string>>")), lambda r: F.struct(r["type"].alias("type"), r["tier"].alias("tier"), r["category"].alias("category"), F.lit(None).cast("string").alias("source"), F.col("value").alias("value")))
    by_key = [F.when(path.rlike(pattern), _rule(kind, tier, category, F.lit(source), F.regexp_extract(path, pattern, 1) if prefixed else None)) for pattern, kind, tier, category, source, prefixed in K.IDENTIFIER_PATTERNS]
    is_url = F.col("value").contains("://") | F.lower("value").startswith("mailto:")
    by_value = [F.when(path.rlike(pattern) & (is_url if wants_url else ~is_url), _rule(kind, tier, category, F.lit(source))) for pattern, kind, tier, category, source, wants_url in K.IDENTIFIER_VALUE_PATTERNS]
    txt = [F.when(path.isin("dns/TXT", "dns/TXT/[]") & F.col("value").rlike(rf"(?i){pattern}"), _rule("dns_txt_token", "tier_3", "dns", value=F.concat(F.lit(f"{provider}|"), F.lower(F.regexp_extract("value", rf"(?i){pattern}", 1))))) for provider, pattern in K.TXT_TOKENS.items()]
    return F.concat(named, F.array_compact(F.array(*by_key, *by_value, *txt)))


def _certificates(leaves: DataFrame) -> DataFrame:
    """Identifiers of certificates: their hashes, names and issuing, with the
    certificate's validity as window."""
    at = F.regexp_extract("path", K.CERTIFICATE_PLACES, 1)
    node = F.when(F.col("path").endswith("/sans/[]"), parent(parent(F.col("place")))).otherwise(parent(F.col("place")))
    rows = leaves.withColumn("node", F.when(at != "", node)).where("node IS NOT NULL").withColumn("source", at).withColumn("name", F.regexp_extract("path", r"([^/]+)(/\[\])?$", 1))
    first = lambda *names: F.coalesce(*[F.max(F.when(F.col("name") == n, F.col("value"))) for n in names])
    whole = rows.groupBy("run", "prefix", "source", "node").agg(
        first("not_before").alias("first_seen"), first("not_after").alias("last_seen"), first("error").alias("error"), first("spki_sha256").alias("spki"), first("sha256", "fingerprint_sha256").alias("sha"),
        first("transport_fingerprint").alias("transport"), first("issuer", "issuer_cn", "issuer_org").alias("issuer"), F.collect_set(F.when(F.col("name") == "sans", F.col("value"))).alias("sans"),
    ).where("error IS NULL")
    one = lambda kind, tier, value, category="tls": F.struct(F.lit(kind).alias("type"), F.lit(tier).alias("tier"), F.lit(category).alias("category"), value.alias("value"))
    issued = F.concat(F.lower(F.trim("issuer")), F.lit("|"), F.col("first_seen"))
    all_of = F.concat(
        F.array(one("tls_spki_sha256", "tier_1", F.col("spki")), one("tls_sha256", "tier_1", F.col("sha")), one("tls_transport_fingerprint", "tier_2", F.col("transport")), one("cert_issuer_not_before", "tier_3", issued, "tls_ct")),
        F.transform("sans", lambda s: one("certificate_san", "tier_4", s)),
    )
    return whole.select("run", "prefix", "source", "first_seen", "last_seen", F.inline(all_of))


def identifiers(documents: DataFrame, depth: int = DEPTH) -> DataFrame:
    """run, type, value, tier, category, source, first_seen, last_seen: each
    identifier of each document (run, json), in the spelling of its type.

    Documents nested as follow-ups count for the run that holds them. Addresses
    count if they are public and the document does not put them behind a proxy.
    Certificates with an error, redacted owners and values that cannot be of
    their type are left out."""
    inner = r"^subdomain_followups/\[\]/result/"
    leaves = walk(documents, depth)
    leaves = leaves.withColumn("prefix", F.when(F.col("path").rlike(inner), "subdomain_followups.").otherwise("")).withColumn("path", F.regexp_replace("path", inner, ""))
    plain = leaves.select("run", "path", "prefix", F.inline(_found(F.col("path")))).withColumn("source", F.concat("prefix", F.coalesce("source", F.regexp_replace(F.regexp_replace("path", r"/\[\]", ""), "/", "."))))
    none = F.lit(None).cast("string")
    found = plain.select("run", "type", "value", "tier", "category", "source", none.alias("first_seen"), none.alias("last_seen")).unionByName(_certificates(leaves).select("run", "type", "value", "tier", "category", F.concat("prefix", "source").alias("source"), "first_seen", "last_seen"))
    fronted = leaves.where((F.col("path").rlike(r"^ip_details/[^/]+/cloudflare$") & (F.col("value") == "true")) | F.col("path").rlike(r"^ip_details/[^/]+/proxy_family$") & (F.trim("value") != "")).select("run", F.split_part("path", F.lit("/"), F.lit(2)).alias("value"), F.lit(True).alias("fronted")).distinct()
    # Generators keep the long expressions in one place: filters are not pushed
    # into them, which would copy them wherever the value is looked at.
    spelled = found.select("run", "type", F.explode(F.array(N.document_value(F.col("type"), F.col("value")))).alias("value"), "tier", "category", "source", "first_seen", "last_seen").where("value IS NOT NULL")
    address, owner = F.col("type").isin(*K.ADDRESS_TYPES), F.col("type").isin("registrant_email", "registrant_name")
    fit = F.when(address, F.coalesce(public_ip(F.col("value")), F.lit(False))).when(owner, ~H.redacted(F.col("value"))).otherwise(F.lit(True))
    fitting = spelled.select("*", F.explode(F.array(fit)).alias("fit")).where("fit").drop("fit")
    good = fitting.join(fronted, ["run", "value"], "left").where(~address | F.col("fronted").isNull())
    keys = ["run", "type", "value", "tier", "category", "source"]
    return good.groupBy(*keys).agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


def runs(documents: DataFrame) -> DataFrame:
    """id, target, ts of documents (run, json): three fields, no walk."""
    field = lambda name: F.get_json_object("json", f"$.{name}")
    return documents.select(F.col("run").alias("id"), H.normal_target(field("input")).alias("target"), field("timestamp").alias("ts")).where("target <> ''")


def identifier_state(documents: DataFrame, depth: int = DEPTH) -> DataFrame:
    """What the newest document of each target holds: domain, type, value, tier,
    category, sources, first_seen, last_seen. Feeds identifiers.frequency(),
    compare() and the rest. Ties of tier and category go to the least."""
    newest = latest_runs(runs(documents)).select(F.col("id").alias("run"), F.col("target").alias("domain"))
    held = identifiers(documents.join(newest.select("run"), "run", "left_semi"), depth).join(newest, "run")
    return held.groupBy("domain", "type", "value").agg(F.min("tier").alias("tier"), F.min_by("category", F.struct("tier", "category")).alias("category"), F.array_sort(F.collect_set("source")).alias("sources"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


def issuance(documents: DataFrame, depth: int = DEPTH) -> DataFrame:
    """domain, issuer, issued (timestamp) of the certificates in the newest
    documents: feeds identifiers.issuance_timing()."""
    state = identifier_state(documents, depth).where("type = 'cert_issuer_not_before'")
    when = F.upper(F.regexp_extract("value", r"\|([^|]*)$", 1))
    return state.select("domain", F.regexp_extract("value", r"^(.*)\|", 1).alias("issuer"), when.alias("when")).select("domain", "issuer", F.try_to_timestamp("when").alias("issued")).where("issued IS NOT NULL")
