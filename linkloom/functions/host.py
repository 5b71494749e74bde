"""Hosts, addresses and mail as column expressions."""

from __future__ import annotations

import ipaddress
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..storage import small

HOSTNAME = r"^(?=.{1,253}$)([a-z0-9_]([a-z0-9_-]{0,61}[a-z0-9_])?\.)+[a-z]([a-z0-9-]{0,61}[a-z0-9])$"
IPV4 = r"^(25[0-5]|2[0-4]\d|1?\d?\d)(\.(25[0-5]|2[0-4]\d|1?\d?\d)){3}$"
IPV6 = r"^(?=.*:)[0-9a-f:]{2,39}$"
#: Public suffixes of two labels that the test corpus meets; a parameter of
#: registrable_domain(), to be replaced by a full list where one is at hand.
TWO_LABEL_SUFFIXES = ("ac.uk", "co.il", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "com.ua", "gov.il", "gov.uk", "net.au", "org.il", "org.uk", "github.io", "gitlab.io", "web.app", "blogspot.com", "wordpress.com")


def contains_any(text: Column, patterns: Sequence[str]) -> Column:
    """One expression for the whole list, so that plans stay small."""
    return text.rlike("|".join(re.escape(p) for p in patterns))


def under_any(host: Column, suffixes: Sequence[str]) -> Column:
    """The host is one of the suffixes or lies below one."""
    return host.rlike(rf"(^|\.)({'|'.join(re.escape(s) for s in suffixes)})$")


def clean_target(text: Column) -> Column:
    """Quotes, scheme, path and a leading www. off."""
    text = F.regexp_replace(F.trim(text), r"^[\"']+|[\"']+$", "")
    text = F.regexp_replace(text, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    text = F.regexp_replace(text, r"[/?#].*$", "")
    return F.regexp_replace(F.trim(text), r"^[Ww][Ww][Ww]\.", "")


def normal_target(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(text)), r"^www\.", "")


def host_of(text: Column) -> Column:
    """Host of a URL or of a bare target: lower case, without user, port,
    brackets, wildcard, www. and trailing dot."""
    text = F.lower(F.trim(text))
    text = F.regexp_replace(text, r"^[a-z][a-z0-9+.-]*://", "")
    text = F.regexp_replace(text, r"[/?#].*$", "")
    text = F.regexp_replace(text, r"^.*@", "")
    bracketed = F.regexp_extract(text, r"^\[([0-9a-f:]+)\]", 1)
    bare = F.regexp_replace(text, r"^([^:]*):\d+$", "$1")
    bare = F.regexp_replace(F.regexp_replace(bare, r"^\*\.", ""), r"\.$", "")
    return F.regexp_replace(F.when(bracketed != "", bracketed).otherwise(bare), r"^www\.", "")


def is_ip(host: Column) -> Column:
    return host.rlike(IPV4) | host.rlike(IPV6)


def target_kind(host: Column) -> Column:
    """ip, domain, or null for what is neither."""
    return F.when(is_ip(host), "ip").when(host.rlike(HOSTNAME), "domain")


def naive_apex(host: Column) -> Column:
    """The last two labels; an address whole."""
    labels = F.split(host, r"\.")
    return F.when(is_ip(host) | (F.size(labels) <= 2), host).otherwise(F.array_join(F.slice(labels, -2, 2), "."))


def registrable_domain(host: Column, suffixes: Sequence[str] = TWO_LABEL_SUFFIXES) -> Column:
    """The label below a public suffix, and it; the last two labels where no
    listed suffix applies; null for addresses, suffixes and bare hosts."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    two = F.array_join(F.slice(labels, F.greatest(n - 1, F.lit(1)), F.lit(2)), ".")
    three = F.array_join(F.slice(labels, F.greatest(n - 2, F.lit(1)), F.lit(3)), ".")
    return F.when(is_ip(host) | (n < 2) | host.isin(*suffixes), None).when(two.isin(*suffixes), three).otherwise(two)


def entity_kind(host: Column) -> Column:
    """ip, domain (an apex), subdomain, or null."""
    kind = target_kind(host)
    return F.when(kind == "ip", "ip").when((kind == "domain") & (registrable_domain(host) == host), "domain").when(kind == "domain", "subdomain")


def normal_asn(asn: Column) -> Column:
    return F.regexp_replace(F.upper(F.trim(asn.cast("string"))), r"^AS", "")


def noisy_suffix(host: Column) -> Column:
    return under_any(host, K.NOISY_SUFFIXES)


def tls_identity(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), r"\.$", ""), r"^(\*\.)?(www\.)?", "")


def low_signal_tls(name: Column) -> Column:
    plain = tls_identity(name)
    return plain.isin(*K.LOW_TLS_NAMES) | contains_any(plain, K.LOW_TLS_PATTERNS)


def boring_nameserver(value: Column) -> Column:
    return contains_any(F.regexp_replace(F.lower(F.trim(value)), r"\.$", ""), K.BORING_NAMESERVERS)


def redacted(value: Column) -> Column:
    text = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    return (text == "") | text.isin(*K.REDACTED_VALUES) | contains_any(text, K.REDACTED_PATTERNS)


def generic_email(text: Column) -> Column:
    """Mailboxes of registrars, providers and privacy services."""
    domain = F.lower(F.trim(F.regexp_extract(text, r"@([^@]*)$", 1)))
    return text.contains("@") & (under_any(domain, K.GENERIC_MAIL) | domain.rlike(K.PRIVACY_MAIL))


def ip_role(ptr: Column, asn: Column, sources: Column, proxy_family: Column) -> Column:
    """mail, cdn_proxy, shared_hosting or direct, the first that applies.
    sources is an array."""
    ptr, asn = F.lower(F.coalesce(ptr, F.lit(""))), F.coalesce(normal_asn(asn), F.lit(""))
    only = lambda allowed: F.forall(sources, lambda s: s.isin(*allowed))
    mail = ((F.size(sources) > 0) & only(K.MAIL_SOURCES)) | (asn.isin(*K.MAIL_ASNS) & only((*K.MAIL_SOURCES, "dns"))) | contains_any(ptr, K.MAIL_PTRS)
    cdn = (F.coalesce(proxy_family, F.lit("")) != "") | asn.isin(*K.CDN_ASNS) | contains_any(ptr, K.CDN_PTRS)
    hosting = asn.isin(*K.HOSTING_ASNS) | contains_any(ptr, K.HOSTING_PTRS)
    return F.when(mail, "mail").when(cdn, "cdn_proxy").when(hosting, "shared_hosting").otherwise("direct")


def tier_from_labels(labels: Column) -> Column:
    """The lowest tier (1 to 5) that any label names."""
    found = F.transform(labels, lambda x: F.regexp_extract(F.lower(x), r"tier[\s_-]*([1-5])\b", 1))
    return F.array_min(F.transform(F.filter(found, lambda x: x != ""), lambda x: x.cast("int")))


# ---- address ranges ----


def ip_number(ip: Column) -> Column:
    """IPv4 as a number; null for anything else."""
    parts = F.split(ip, r"\.")
    n = sum((parts.getItem(k).cast("long") * F.lit(256 ** (3 - k)) for k in range(4)), F.lit(0))
    return F.when(ip.rlike(IPV4), n)


def ip_key(ip: Column) -> Column:
    """Sortable text of any address: the version, then the address in full
    hexadecimal. Ranges of one version compare as text."""
    four = F.concat(F.lit("4"), F.lpad(F.hex(ip_number(ip)), 8, "0"))
    halves = F.split(F.lower(ip), "::")
    groups = lambda h: F.filter(F.split(h, ":"), lambda x: x != "")
    left, right = groups(halves.getItem(0)), F.when(F.size(halves) > 1, groups(halves.getItem(1))).otherwise(F.array().cast("array<string>"))
    gap = F.array_repeat(F.lit("0"), F.lit(8) - F.size(left) - F.size(right))
    six = F.concat(F.lit("6"), F.array_join(F.transform(F.concat(left, gap, right), lambda x: F.lpad(x, 4, "0")), ""))
    return F.when(ip.rlike(IPV4), four).when(F.lower(ip).rlike(IPV6) & (F.size(left) + F.size(right) <= 8), F.upper(six))


def networks(spark: SparkSession, nets: Sequence[str] = K.CDN_NETS) -> DataFrame:
    """net, lo, hi (as ip_key) of a fixed list of networks."""
    rows = []
    for text in nets:
        net = ipaddress.ip_network(text)
        digits = 8 if net.version == 4 else 32
        rows.append((text, f"{net.version}{int(net[0]):0{digits}X}", f"{net.version}{int(net[-1]):0{digits}X}"))
    return spark.createDataFrame(rows, "net string, lo string, hi string")


def in_networks(df: DataFrame, ip: str, nets: DataFrame) -> DataFrame:
    """Rows of df whose address lies in one of the (few, fixed) networks, with
    the network: a range join against a list that is broadcast if it is small."""
    key = ip_key(F.col(ip))
    return df.join(small(nets), (key >= F.col("lo")) & (key <= F.col("hi"))).drop("lo", "hi")


def cidr_hosts(net: Column) -> Column:
    """All addresses of a small IPv4 network, as numbers."""
    base = ip_number(F.split_part(net, F.lit("/"), F.lit(1)))
    size = F.pow(F.lit(2.0), F.lit(32) - F.split_part(net, F.lit("/"), F.lit(2)).cast("int")).cast("long")
    lo = base - base % size
    return F.sequence(lo, lo + size - 1)


def ip_text(number: Column) -> Column:
    return F.concat_ws(".", *[F.shiftright(number, 8 * k).bitwiseAND(F.lit(255)).cast("string") for k in (3, 2, 1, 0)])
