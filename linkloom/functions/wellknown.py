"""Text files that sites publish about themselves, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as X
from .pages import let

_LIST = "array<string>"


def lines_of(text: Column, comments: bool = True) -> Column:
    """Lines without white space at their ends; empty ones and, unless they
    count, those that begin with # go."""
    plain = F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|\r|\n"), lambda x: F.btrim(x, F.lit(" \t\f\x0b")))
    return F.filter(plain, lambda x: (x != "") if not comments else ((x != "") & ~x.startswith("#")))


def _halves(line: Column, mark: str) -> tuple[Column, Column]:
    at = F.instr(line, mark)
    return F.lower(F.trim(F.substring(line, F.lit(1), at - 1))), F.trim(F.substring(line, at + 1, F.length(line)))


def fields_of(text: Column, comments: bool = True) -> Column:
    """key: value lines as a map of distinct values by lower-case key."""
    lines = F.filter(lines_of(text, comments), lambda x: x.contains(":"))
    pairs = F.transform(lines, lambda x: F.struct(_halves(x, ":")[0].alias("k"), _halves(x, ":")[1].alias("v")))
    values = lambda every, k: F.array_distinct(F.transform(F.filter(every, lambda p: (p["k"] == k) & (p["v"] != "")), lambda p: p["v"]))
    return let(F.filter(pairs, lambda p: p["v"] != ""), lambda every: F.map_from_entries(F.transform(F.array_distinct(F.transform(every, lambda p: p["k"])), lambda k: F.struct(k, values(every, k)))))


def _of(fields: Column, key: str) -> Column:
    return F.coalesce(F.element_at(fields, F.lit(key)), F.array().cast(_LIST))


def _urls(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?i)https?://[^\s>]+"), F.lit(0)))


def security_txt(text: Column) -> Column:
    """Contacts, policy and expiry of a security.txt."""
    return let(fields_of(text), lambda f: F.struct(
        _of(f, "contact").alias("contacts"), F.get(_of(f, "expires"), F.lit(0)).alias("expires"), _of(f, "canonical").alias("canonical"), _of(f, "preferred-languages").alias("preferred_languages"), _of(f, "policy").alias("policy"),
        F.array_distinct(F.regexp_extract_all(F.array_join(_of(f, "contact"), "\n"), F.lit(X.EMAIL), F.lit(0))).alias("emails"), _urls(text).alias("urls"), X.text_hash(F.coalesce(text, F.lit(""))).alias("text_hash"),
    ))


def mta_sts(text: Column) -> Column:
    """Mail transport policy."""
    first = lambda f, k: F.get(_of(f, k), F.lit(0))
    return let(fields_of(text), lambda f: F.struct(first(f, "version").alias("version"), first(f, "mode").alias("mode"), _of(f, "mx").alias("mx"), first(f, "max_age").alias("max_age")))


def humans_txt(text: Column) -> Column:
    """Fields, mailboxes, numbers and addresses of a humans.txt."""
    plain = F.coalesce(text, F.lit(""))
    return F.struct(fields_of(plain, False).alias("fields"), F.array_distinct(F.regexp_extract_all(plain, F.lit(X.EMAIL), F.lit(0))).alias("emails"), X.phones_in(plain).alias("phones"), _urls(plain).alias("urls"), X.text_hash(plain).alias("text_hash"))


def ads_txt(text: Column) -> Column:
    """Sellers and variables of an ads.txt: records of three parts or more; what
    follows a # in a line does not count."""
    bodies = F.filter(F.transform(lines_of(text), lambda x: F.trim(F.regexp_replace(x, "#.*$", ""))), lambda x: x != "")
    assigned = lambda x: x.contains("=") & ~x.contains(",")
    parts = lambda x: F.transform(F.split(x, ","), lambda p: F.trim(p))
    record = lambda p: F.struct(F.lower(p[0]).alias("seller_domain"), p[1].alias("publisher_id"), F.upper(p[2]).alias("relationship"), F.get(p, F.lit(3)).alias("cert_authority_id"))
    records = F.transform(F.filter(F.transform(F.filter(bodies, lambda x: ~assigned(x)), parts), lambda p: F.size(p) >= 3), record)
    pairs = F.transform(F.filter(bodies, assigned), lambda x: F.struct(_halves(x, "=")[0].alias("k"), _halves(x, "=")[1].alias("v")))
    last = lambda every: F.aggregate(every, F.create_map().cast("map<string,string>"), lambda m, p: F.map_concat(F.map_filter(m, lambda k, v: k != p["k"]), F.create_map(p["k"], p["v"])))
    return let(records, lambda r: F.struct(r.alias("records"), last(pairs).alias("variables"), F.array_distinct(F.transform(r, lambda x: x["seller_domain"])).alias("seller_domains"), F.array_distinct(F.transform(r, lambda x: x["publisher_id"])).alias("publisher_ids")))


def assetlinks(text: Column) -> Column:
    """Packages, sites and relations of an assetlinks.json: a list of statements
    or one; anything else gives empty lists."""
    kind = "array<struct<relation:array<string>,target:struct<namespace:string,package_name:string,site:string,sha256_cert_fingerprints:array<string>>>>"
    parsed = F.coalesce(F.from_json(F.when(F.trim(text).startswith("["), text).otherwise(F.concat(F.lit("["), text, F.lit("]"))), kind), F.array().cast(kind))
    every = lambda items: F.array_distinct(F.filter(items, lambda x: x.isNotNull() & (x != "")))
    flat = lambda items: F.flatten(F.filter(items, lambda x: x.isNotNull()))
    return let(parsed, lambda s: F.struct(
        every(F.transform(s, lambda x: x["target"]["package_name"])).alias("package_names"), every(F.transform(s, lambda x: x["target"]["site"])).alias("sites"), every(flat(F.transform(s, lambda x: x["relation"]))).alias("relations"),
        every(flat(F.transform(s, lambda x: x["target"]["sha256_cert_fingerprints"]))).alias("fingerprints"),
    ))
