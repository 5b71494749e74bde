"""DNS records as column expressions, and the bounded walk over SPF includes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def txt(value: Column) -> Column:
    """A TXT value without quotes, its parts joined."""
    return F.regexp_replace(F.regexp_replace(F.trim(value), r'"\s+"', ""), r'^"|"$', "")


def spf(value: Column) -> Column:
    """Struct of an SPF record: ip4, ip6, includes, redirect, policy; null for
    any other text."""
    text = F.lower(txt(value))
    terms = F.split(text, r"\s+")

    def after(prefix: str) -> Column:
        return F.transform(F.filter(terms, lambda t: F.regexp_replace(t, r"^[+?~-]", "").startswith(prefix)), lambda t: F.regexp_replace(t, rf"^[+?~-]?{prefix}", ""))

    parts = F.struct(
        after("ip4:").alias("ip4"), after("ip6:").alias("ip6"), after("include:").alias("includes"), F.element_at(F.concat(after("redirect="), F.array(F.lit(None).cast("string"))), 1).alias("redirect"),
        F.element_at(F.concat(F.filter(terms, lambda t: t.rlike(r"^[+?~-]?all$")), F.array(F.lit(None).cast("string"))), 1).alias("policy"),
    )
    return F.when(text.rlike(r"^v=spf1(\s|$)"), parts)


def tag(text: Column, name: str) -> Column:
    return F.trim(F.regexp_extract(text, rf"(?i)(?:^|;)\s*{name}\s*=\s*([^;]*)", 1))


def report_uris(value: Column) -> Column:
    """Mail addresses of a report tag, without size limits."""
    parts = F.filter(F.split(value, r"\s*,\s*"), lambda x: F.lower(x).startswith("mailto:"))
    return F.transform(parts, lambda x: F.lower(F.regexp_replace(F.regexp_replace(x, r"(?i)^mailto:", ""), r"!\d+[a-z]?$", "")))


def dmarc(value: Column) -> Column:
    """Struct of a DMARC record: policy, rua, ruf; null for any other text."""
    text = txt(value)
    return F.when(text.rlike(r"(?i)^v=dmarc1(\s*;|$)"), F.struct(F.lower(tag(text, "p")).alias("policy"), report_uris(tag(text, "rua")).alias("rua"), report_uris(tag(text, "ruf")).alias("ruf")))


def caa(value: Column) -> Column:
    """Struct of a CAA record: flag, tag, issuer domain and its parameters."""
    flag = F.regexp_extract(value, r"^\s*(\d+)\s", 1).try_cast("int")
    name = F.lower(F.regexp_extract(value, r"^\s*\d+\s+([A-Za-z]+)", 1))
    body = F.regexp_extract(value, r'^\s*\d+\s+[A-Za-z]+\s+"?([^"]*)"?', 1)
    parts = F.split(body, r"\s*;\s*")
    return F.when(flag.isNotNull() & (name != ""), F.struct(flag.alias("flag"), name.alias("tag"), F.lower(F.trim(parts.getItem(0))).alias("issuer"), F.filter(F.slice(parts, 2, 100), lambda x: x != "").alias("parameters")))


#: How providers begin their verification records.
TOKEN_PREFIXES = {
    "google-site-verification=": "google_site_verification", "ms=": "microsoft", "facebook-domain-verification=": "facebook", "apple-domain-verification=": "apple",
    "yandex-verification:": "yandex", "atlassian-domain-verification=": "atlassian", "adobe-idp-site-verification=": "adobe",
}


def tenancy_tokens(value: Column) -> Column:
    """Array of provider|token of a TXT value."""
    text = txt(value)
    found = [F.when(F.lower(text).startswith(p), F.concat(F.lit(f"{name}|"), F.trim(F.substring(text, F.lit(len(p) + 1), F.length(text))))) for p, name in TOKEN_PREFIXES.items()]
    return F.array_compact(F.array(*found))


def dkim_names(domains: DataFrame, selectors: tuple[str, ...]) -> DataFrame:
    """domain, selector, name of the DKIM records to look for."""
    each = domains.select("domain", F.explode(F.array(*[F.lit(s) for s in selectors])).alias("selector"))
    return each.withColumn("name", F.concat_ws(".", "selector", F.lit("_domainkey"), "domain"))


def spf_walk(records: DataFrame, start: DataFrame, depth: int = 5, lookups: int = 20) -> DataFrame:
    """Names that each domain's SPF record reaches by include and redirect:
    domain, name, depth, each name once, at most `lookups` of them.

    records: name, text. start: domain."""
    from pyspark.sql import Window

    parsed = records.select("name", spf(F.col("text")).alias("s")).where("s IS NOT NULL")
    goes = parsed.select("name", F.explode(F.array_compact(F.concat("s.includes", F.array("s.redirect")))).alias("next")).distinct()
    seen = start.select("domain", F.col("domain").alias("name"), F.lit(0).alias("depth"))
    level = seen
    for n in range(1, depth + 1):
        more = level.join(goes, "name").select("domain", F.col("next").alias("name")).distinct()
        level = more.join(seen, ["domain", "name"], "left_anti").withColumn("depth", F.lit(n))
        seen = seen.unionByName(level)
    by = Window.partitionBy("domain").orderBy("depth", "name")
    return seen.where("depth > 0").withColumn("n", F.row_number().over(by)).where(F.col("n") <= lookups).drop("n")
