"""What the headers of a response give away, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Attributes of a cookie, which are no names of cookies.
COOKIE_ATTRIBUTES = ("path", "domain", "expires", "max-age", "secure", "httponly", "samesite", "priority", "partitioned", "version")
#: Headers whose first value is a field of its own.
SAID_ONCE = {"server": "server", "x_powered_by": "x-powered-by", "content_security_policy": "content-security-policy", "x_generator": "x-generator", "x_aspnet_version": "x-aspnet-version"}


def cookie_names(values: Column) -> Column:
    """Names in Set-Cookie values (an array), in order, once each; a value may
    hold several cookies after commas."""
    named = lambda v: F.regexp_extract_all(v, F.lit(r"(?:^|,\s*)([!#$%&'*+\-.^_`|~0-9A-Za-z]+)="), F.lit(1))
    return F.array_distinct(F.filter(F.flatten(F.transform(values, named)), lambda n: ~F.lower(n).isin(*COOKIE_ATTRIBUTES)))


def http_fingerprint(headers: Column) -> Column:
    """A struct of what headers say. headers: array of structs (name, value) in
    the order of the response; a name may come again, in any case of letters.

    Null: empty lists, the rest null. Entries without a name or value are left
    out. In the map the last value of a spelling counts; in x_drupal_headers all
    values of a name, as an array."""
    none = F.array().cast("array<struct<name:string,value:string>>")
    sent = F.filter(F.coalesce(headers, none), lambda h: h["name"].isNotNull() & h["value"].isNotNull())
    low = F.transform(sent, lambda h: F.struct(F.lower(h["name"]).alias("name"), h["value"].alias("value")))
    of = lambda name: F.transform(F.filter(low, lambda h: h["name"] == name), lambda h: h["value"])
    distinct = lambda items: F.array_distinct(F.transform(items, lambda h: h["name"]))
    last = lambda n: F.struct(n, F.element_at(F.filter(sent, lambda h: h["name"] == n), -1)["value"])
    drupal = F.filter(distinct(low), lambda n: n.startswith("x-drupal-"))
    return F.struct(
        F.map_from_entries(F.transform(distinct(sent), last)).alias("headers"),
        F.transform(low, lambda h: h["name"]).alias("header_order"), distinct(low).alias("header_names"),
        *[F.get(of(name), F.lit(0)).alias(k) for k, name in SAID_ONCE.items()],
        cookie_names(of("set-cookie")).alias("set_cookie_names"),
        F.map_from_entries(F.transform(drupal, lambda n: F.struct(n, of(n)))).alias("x_drupal_headers"),
    )
