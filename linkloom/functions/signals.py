"""What a single value tells: platforms, content systems, networks, names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K
from . import host as H

#: Response headers that name a managed platform, in order; an
#: empty part matches any value.
PLATFORMS = (
    ("hostinger-horizons", "x-powered-by", "hostinger horizons"), ("hostinger", "platform", "hostinger"), ("vercel", "server", "vercel"), ("netlify", "server", "netlify"), ("github-pages", "server", "github.com"),
    ("cloudflare-pages", "server", "cloudflare"), ("squarespace", "server", "squarespace"), ("wix", "x-wix-request-id", ""), ("shopify", "x-shopify-stage", ""), ("wordpress-com", "x-hacker", "wordpress.com"),
    ("framer", "x-framer-site", ""), ("webflow", "server", "webflow"),
)
#: Content systems by the generator that a page declares, in order.
GENERATORS = ("wordpress", "drupal", "joomla", "ghost", "typo3", "wix", "squarespace", "shopify", "hugo", "jekyll", "bitrix")
#: Subdomain labels that everybody has.
COMMON_LABELS = (
    "www", "www2", "m", "mobile", "web", "mail", "mail2", "webmail", "smtp", "smtps", "imap", "imaps", "pop", "pop3", "mx", "mx1", "mx2", "email", "relay", "mailrelay", "ns", "ns1", "ns2", "ns3", "ns4", "dns", "dns1",
    "dns2", "ftp", "sftp", "ftps", "cpanel", "whm", "webdisk", "cpcalendars", "cpcontacts", "autodiscover", "autoconfig", "_domainkey", "_dmarc", "_acme-challenge", "cdn", "static", "assets", "img", "images", "media",
    "files", "localhost", "default", "vpn", "remote",
)
#: Networks that no public address lies in.
PRIVATE_NETS = (
    "0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4",
    "2001::/23", "2001:db8::/32", "2002::/16",
)


def first_of(cases: Sequence[tuple[Column, str]], default: str | None = None) -> Column:
    """The name of the first case that holds."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for condition, name in cases:
        out = out.when(F.coalesce(condition, F.lit(False)), name)
    return out if default is None else out.otherwise(default)


def lowered(headers: Column) -> Column:
    """A header map with lower-case names; of names that differ by case alone,
    the last one counts."""
    entries = F.map_entries(headers)
    return F.aggregate(entries, F.create_map().cast("map<string,string>"), lambda m, e: F.map_concat(F.map_filter(m, lambda k, v: k != F.lower(e["key"])), F.create_map(F.lower(e["key"]), e["value"])))


def platform(headers: Column) -> Column:
    """The managed platform that response headers (lower-case names) name."""
    return first_of([(F.element_at(headers, F.lit(h)).isNotNull() & F.lower(F.element_at(headers, F.lit(h))).contains(part), name) for name, h, part in PLATFORMS])


def content_system(html: Column, headers: Column, generator: Column) -> Column:
    """The content system: what the page declares, else what headers and markup
    show. headers: lower-case names."""
    text, header = F.coalesce(html, F.lit("")), lambda n: F.coalesce(F.element_at(headers, F.lit(n)), F.lit(""))
    declared = F.lower(F.coalesce(generator, F.lit("")))
    shown = [
        (header("link").contains("wp-json") | header("x-pingback").contains("/xmlrpc.php") | text.contains("wp-content/") | text.contains("wp-includes/"), "wordpress"),
        (F.lower(header("x-generator")).contains("drupal") | text.contains("Drupal.settings"), "drupal"), (text.contains("/media/jui/"), "joomla"), (F.lower(header("x-powered-by")).contains("ghost"), "ghost"),
    ]
    return first_of([(declared.contains(g), g) for g in GENERATORS] + shown)


def names_cdn(*texts: Column) -> Column:
    """Network name, description or reverse name of a content network."""
    return H.contains_any(F.lower(F.concat_ws(" ", *texts)), K.CDN_NAMES)


def edge_network(noisy: Column, cloudflare: Column, proxy_family: Column, in_net: Column, texts: Sequence[Column], flags: Column, labels: Column) -> Column:
    """Whether an address belongs to infrastructure that strangers share: noted
    so, under a proxy family, in a listed network, named so, or enriched so."""
    from ..operators.links import says_shared

    yes = lambda c: F.coalesce(c, F.lit(False))
    return yes(noisy) | yes(cloudflare) | (F.coalesce(proxy_family, F.lit("")) != "") | yes(in_net) | yes(names_cdn(*texts)) | yes(says_shared(flags, labels))


def public_ip(ip: Column) -> Column:
    """An address that is neither private nor reserved; null where it is none."""
    import ipaddress

    key, inside = H.ip_key(ip), F.lit(False)
    for net in map(ipaddress.ip_network, PRIVATE_NETS):
        width = 8 if net.version == 4 else 32
        inside = inside | key.between(f"{net.version}{int(net[0]):0{width}X}", f"{net.version}{int(net[-1]):0{width}X}")
    return ~inside & (key.startswith("4") | key.between("62", "63" + "F" * 31))


def nameservers(values: Column) -> Column:
    """Names of servers as a list: lower case, no dot at the end, once each, in
    order; labels of a parsed record that are no names go."""
    plain = F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.regexp_replace(F.lower(F.trim(v)), r"\.+$", ""))
    return F.array_distinct(F.filter(plain, lambda v: v.contains(".") & ~v.isin("creation", "updated")))


def delegation(live: Column, registrar: Column) -> Column:
    """Live name servers against the registrar's: a side without any compares
    with nothing."""
    one, two = nameservers(live), nameservers(registrar)
    both = (F.size(one) > 0) & (F.size(two) > 0)
    left = lambda a, b: F.when(both, F.array_sort(F.array_except(a, b))).otherwise(F.array().cast("array<string>"))
    only_registrar, only_live = left(two, one), left(one, two)
    return F.struct(both.alias("comparable"), (both & ((F.size(only_registrar) > 0) | (F.size(only_live) > 0))).alias("mismatch"), only_registrar.alias("registrar_only"), only_live.alias("live_only"))


def split_nameservers(values: Column) -> Column:
    """Name servers of mass providers, and those that may be the owner's own."""
    names = nameservers(values)
    boring = lambda v: H.boring_nameserver(H.naive_apex(v))
    return F.struct(F.filter(names, boring).alias("boring"), F.filter(names, lambda v: ~boring(v)).alias("vanity"))


def subdomain_labels(hosts: Column, apex: Column) -> Column:
    """What stands before the apex in the names below it, without labels that
    everybody has; sorted."""
    plain = F.transform(hosts, lambda h: F.regexp_replace(F.lower(F.trim(h)), r"^[*.]+", ""))
    below = F.filter(plain, lambda h: h.endswith(F.concat(F.lit("."), apex)))
    labels = F.transform(below, lambda h: F.substring(h, F.lit(1), F.length(h) - F.length(apex) - 1))
    return F.array_sort(F.array_distinct(F.filter(labels, lambda x: (x != "") & ~x.isin(*COMMON_LABELS) & ~F.split_part(x, F.lit("."), F.lit(1)).isin(*COMMON_LABELS))))


def low_signal_certificate(label: Column, common_name: Column, issuer: Column) -> Column:
    """A certificate sighting that says nothing: on a noisy address, or with
    names that come with the server."""
    name = lambda c: F.coalesce(H.contains_any(F.lower(c), K.LOW_HOSTING) | H.low_signal_tls(c), F.lit(False)) & (F.coalesce(c, F.lit("")) != "")
    return F.coalesce(label.isin("mail", "cdn_proxy", "shared_hosting"), F.lit(False)) | name(common_name) | name(issuer)


def evidence_ok(path: Column, value: Column) -> Column:
    """Whether a value at a path can be evidence: no default keys, placeholder
    numbers, empty wallets or names that are no hosts."""
    low, digits = F.lower(F.trim(value)), F.regexp_replace(value, r"\D", "")
    wallet = F.lower(F.trim(F.regexp_extract(value, r"^[^|]*\|(.*)$", 1)))
    return (
        F.when(path == "email_security.dmarc_report_uris", value.contains("@") | value.startswith("http"))
        .when(path == "email_security.dkim_selectors", ~low.isin(*K.DEFAULT_SELECTORS))
        .when(path == "tls_certs.probes[*].cn", F.regexp_replace(low, r"^\*\.", "").rlike(H.HOSTNAME))
        .when(path.isin("page_metadata.phone_numbers", "legal_pages.phones"), (F.length(digits) >= 7) & ~digits.rlike(r"^(\d)\1*$") & ~digits.isin(*K.PLACEHOLDER_PHONES))
        .when(path == "page_metadata.crypto_wallet_values", (wallet != "") & ~wallet.isin(*K.NULL_WALLETS))
        .otherwise(F.lit(True))
    )


def txt_tokens(records: Column) -> Column:
    """provider|code of the verification records among TXT values."""
    #: What such records begin with.
    marks = {"google_site_verification": "google-site-verification", "facebook_domain_verification": "facebook-domain-verification", "microsoft": r"\bms", "stripe_verification": "stripe-verification", "apple_domain_verification": "apple-domain-verification", "zoom_verification": "zoom-domain-verification", "atlassian_domain_verification": "atlassian-domain-verification"}

    def codes(provider: str, mark: str) -> Column:
        found = F.flatten(F.transform(records, lambda r: F.regexp_extract_all(r, F.lit(rf"(?i){mark}=([A-Za-z0-9._-]+)"), F.lit(1))))
        return F.transform(found, lambda code: F.concat(F.lit(f"{provider}|"), code))

    return F.array_distinct(F.concat(*[codes(*m) for m in marks.items()]))


def granted(asked: Column, used: Column, limit: int) -> Column:
    """How many calls a daily budget still gives."""
    return F.greatest(F.lit(0), F.least(asked, F.lit(limit) - used))
