"""What a home page says, as column expressions over its markup.

Tags are cut out with regular expressions and their attributes read by name, so
pages are worked inside the JVM, in time that grows with their length. A tag ends
at its first > or <, in quotes or not.
"""

from __future__ import annotations

import html.entities
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as X

#: Profile addresses by platform; the last group is the handle.
SOCIAL_PATTERNS = (
    ("telegram", r"https?://t\.me/([A-Za-z0-9_]{3,60})"),
    ("vkontakte", r"https?://(?:www\.)?vk\.com/([^\s\"'<>/?]{2,80})"),
    ("odnoklassniki", r"https?://(?:www\.)?ok\.ru/(?:profile/|group/)?([^\s\"'<>/?]{2,80})"),
    ("odnoklassniki", r"https?://(?:www\.)?odnoklassniki\.ru/(?:profile/|group/)?([^\s\"'<>/?]{2,80})"),
    ("twitter_x", r"https?://(?:www\.)?(?:twitter|x)\.com/(?!search|share|intent|home)([^\s\"'<>/?]{2,60})"),
    ("tiktok", r"https?://(?:www\.)?tiktok\.com/@([A-Za-z0-9_.]{2,60})"),
    ("instagram", r"https?://(?:www\.)?instagram\.com/([^\s\"'<>/?]{2,60})"),
    ("facebook", r"https?://(?:www\.)?facebook\.com/(?!sharer|share|dialog|tr\b|profile\.php\b|pages\b)([^\s\"'<>/?]{2,80})"),
    ("youtube", r"https?://(?:www\.)?youtube\.com/(?:channel/|@)([^\s\"'<>/?]{2,80})"),
    ("linkedin", r"https?://(?:www\.)?linkedin\.com/(?:company|in)/([^\s\"'<>/?]{2,80})"),
    ("pinterest", r"https?://(?:www\.)?pinterest\.(?:com|[a-z]{2})/([^\s\"'<>/?]{2,80})"),
    ("mastodon", r"https?://(?!(?:www\.)?(?:tiktok\.com|youtube\.com|unpkg\.com|(?:cdn\.)?jsdelivr\.net|cdnjs\.cloudflare\.com|esm\.(?:sh|run)|(?:cdn\.)?skypack\.dev|jspm\.(?:dev|io))\b)[A-Za-z0-9.-]+/@([A-Za-z0-9_]{2,80})"),
)
#: Path parts of these sites that are no handles.
SOCIAL_NOISE = (
    "", "home", "login", "signup", "help", "support", "about", "contact", "profile.php", "pages", "search", "explore", "settings", "notifications", "messages", "hashtag", "tag", "privacy", "terms", "tos", "legal",
    "cookies", "policies", "faq", "join", "business", "ads", "careers", "press", "developers", "apps", "accounts", "direct", "watch", "video", "videos", "photo", "photos", "live", "topic", "widgets", "widget", "plugins",
    "embed", "share", "share.php", "sharer", "away.php", "l.php", "dk", "joinchat", "addstickers", "addtheme", "addstyle", "addemoji", "proxy", "socks", "iv", "confirmphone", "setlanguage", "auth", "call", "boost",
    "auction", "giftcode", "nft", "feed", "im", "widget_comments.php", "widget_community.php", "widget_recomm.php", "widget_events.php", "al_widget.php", "video_ext.php", "groups", "events", "marketplace", "gaming",
    "login.php", "photo.php", "video.php", "permalink.php", "story.php", "reel", "reels", "tv", "stories", "showcase", "pin", "source",
)
#: Meta tags that prove ownership, and whom they prove it to.
VERIFICATION_META = {
    "google-site-verification": "google", "msvalidate.01": "bing", "yandex-verification": "yandex", "p:domain_verify": "pinterest", "facebook-domain-verification": "facebook", "norton-safeweb-site-verification": "norton",
    "alexaverifyid": "alexa", "baidu-site-verification": "baidu", "naver-site-verification": "naver", "ahrefs-site-verification": "ahrefs", "shopify-verification": "shopify", "verify-v1": "yahoo", "wot-verification": "wot",
}
#: What scripts of each bundler hold.
BUNDLERS = {
    "webpack": r"__webpack_require__|webpackChunk|webpackJsonp", "vite": r"__vite__|import\.meta\.hot|/@vite/client", "parcel": "parcelRequire|parcelHotUpdate", "rollup": r"System\.register\(|rollupPluginBabelHelpers",
    "nextjs": r"/_next/|__NEXT_DATA__|self\.__next_f", "nuxt": r"/_nuxt/|window\.__NUXT__|nuxtApp", "browserify": r"function e\(t,n,r\)|require=function e\(t,n,r\)", "esbuild": "__toESM|__commonJS",
}
#: Account ids in tags, none a part of a longer word.
TAG_IDS = {
    "google_analytics": r"(?<![\w-])(UA-\d{4,12}-\d{1,3}|G-[A-Z0-9]{10}|AW-[0-9]{8,12})(?![\w-])", "gtm_ids": r"(?<![\w-])(GTM-[A-Z0-9]{4,8})(?![\w-])", "facebook_pixel": r"fbq\([\"']init[\"'],\s*[\"'](\d{8,20})[\"']",
    "tiktok_pixel": r"ttq\.load\([\"']([A-Z0-9]{15,25})[\"']", "yandex_metrika": r"(?:\bym\((?=\d{5,12}\s*,)|metrika\.yandex\.(?:com|ru)/watch/)(\d{5,12})", "adsense_ids": r"(?i)\b(ca-pub-\d{10,20})\b",
}
_LIST = "array<string>"
#: What homepages() gives.
PAGE_FIELDS = (
    "title", *TAG_IDS, "html_lang", "cms_generator", "author", "authors", "fb_app_id", "twitter_site", "twitter_creator", "social_links", "social_handles", "social_meta", "site_verifications", "meta_tags", "rel_me_links",
    "canonical_url", "favicon_links", "script_assets", "script_urls", "script_asset_hosts", "inline_source_map_urls", "inline_bundlers", "homepage_text_hash", "phone_numbers",
)


def let(value: Column, use) -> Column:
    """use(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def unescape(text: Column) -> Column:
    """Character references decoded: numbers, and the names of HTML 4."""
    names = {**{k: chr(v) for k, v in html.entities.name2codepoint.items()}, "apos": "'"}
    known = F.str_to_map(F.lit("\x01".join(f"{k}\x02{v}" for k, v in sorted(names.items()))), F.lit("\x01"), F.lit("\x02"))  # folded to a literal

    def one(part: Column) -> Column:
        name = F.regexp_extract(part, r"^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);", 1)
        code = F.when(name.rlike("^#[xX]"), F.conv(F.substring(name, 3, 8), 16, 10)).when(name.startswith("#"), F.substring(name, 2, 8)).cast("int")
        bad = (code == 0) | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF)
        number = F.when(bad, "�").when(code.isNotNull(), F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
        char = F.coalesce(number, F.element_at(known, name))
        return F.when(char.isNotNull(), F.concat(char, F.substring(part, F.length(name) + 2, F.length(part)))).otherwise(F.concat(F.lit("&"), part))

    whole = let(F.split(text, "&"), lambda parts: F.concat(F.element_at(parts, 1), F.array_join(F.transform(F.slice(parts, F.lit(2), F.size(parts)), one), "")))
    return F.when(text.contains("&"), whole).otherwise(text)


def tags(markup: Column, name: str) -> Column:
    """The attribute texts of all tags of a name, in order."""
    return F.regexp_extract_all(markup, F.lit(rf"(?is)<{name}(?=[\s/>])([^<>]*)>"), F.lit(1))


def attribute(tag: Column, name: str) -> Column:
    """An attribute of a tag's text; null if it has none or it is empty."""
    found = lambda k: F.nullif(F.regexp_extract(tag, rf"""(?is)(?:^|[\s"'/]){name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", k), F.lit(""))
    return unescape(F.trim(F.coalesce(found(1), found(2), found(3))))


def absolute(base: Column, ref: Column) -> Column:
    """A reference resolved against the page's address."""
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    path = F.regexp_replace(F.regexp_replace(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", ""), r"[?#].*$", "")
    target = F.when(ref.startswith("/"), ref).when(ref.rlike(r"^[?#]"), F.concat(path, ref)).otherwise(F.concat(F.coalesce(F.nullif(F.regexp_replace(path, r"[^/]*$", ""), F.lit("")), F.lit("/")), ref))
    rest = F.regexp_extract(target, r"([?#].*)$", 1)
    steps = F.split(F.regexp_replace(target, r"[?#].*$", ""), "/")
    walked = F.aggregate(steps, F.array().cast(_LIST), lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(1)))).when(s == ".", acc).otherwise(F.concat(acc, F.array(s))))
    joined = F.concat(origin, F.array_join(walked, "/"), F.when(steps[F.size(steps) - 1].isin(".", ".."), "/").otherwise(""), rest)
    return (
        F.when(ref.isNull() | (ref == ""), None).when(base.isNull() | (origin == "") | ref.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), ref)
        .when(ref.startswith("//"), F.concat(F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1), ref)).otherwise(joined)
    )


def _distinct(items: Column) -> Column:
    """Without nulls and repeats, in order."""
    return F.array_distinct(F.filter(items, lambda x: x.isNotNull() & (x != "")))


def _grouped(pairs: Column) -> Column:
    """A map of distinct values by key from an array of (k, v)."""
    values = lambda all_, k: F.array_distinct(F.transform(F.filter(all_, lambda p: p["k"] == k), lambda p: p["v"]))
    return let(pairs, lambda all_: F.map_from_entries(F.transform(F.array_distinct(F.transform(all_, lambda p: p["k"])), lambda k: F.struct(k, values(all_, k)))))


def _pairs(arrays: list[Column]) -> Column:
    return F.filter(F.concat(*arrays), lambda p: p["k"].isNotNull() & (p["k"] != "") & p["v"].isNotNull() & (p["v"] != ""))


def _pair(key: Column, value: Column) -> Column:
    return F.struct(F.lower(F.trim(key)).alias("k"), value.alias("v"))


def meta_tags(markup: Column) -> Column:
    """Contents of meta tags by name, property, http-equiv and itemprop."""
    found = tags(markup, "meta")
    return _grouped(_pairs([F.transform(found, _named(n)) for n in ("name", "property", "http-equiv", "itemprop")]))


def _named(name: str):
    return lambda t: _pair(attribute(t, name), attribute(t, "content"))


def social_profiles(whole: Column) -> Column:
    """Social profiles in a text: array of platform (k), link (l), handle (v)."""
    edge = r"""[/?).,;"']+$"""

    def found(platform: str, pattern: str) -> Column:
        plain = lambda x: F.regexp_replace(x, edge, "")
        links = F.regexp_extract_all(whole, F.lit(f"(?i){pattern}"), F.lit(0))
        handles = F.regexp_extract_all(whole, F.lit(f"(?i){pattern}"), F.lit(1))
        return F.filter(F.transform(F.arrays_zip(links.alias("l"), handles.alias("h")), lambda z: F.struct(F.lit(platform).alias("k"), plain(z["l"]).alias("l"), plain(z["h"]).alias("v"))), lambda z: ~F.lower(z["v"]).isin(*SOCIAL_NOISE))

    return F.concat(*[found(*p) for p in SOCIAL_PATTERNS])


def tag_ids(markup: Column) -> Column:
    """Account ids in a page, each a sorted set."""
    ids = {k: F.array_sort(F.array_distinct(F.regexp_extract_all(markup, F.lit(p), F.lit(1)))) for k, p in TAG_IDS.items()}
    ids["adsense_ids"] = F.array_sort(F.array_distinct(F.transform(ids["adsense_ids"], lambda x: F.lower(x))))
    return F.struct(*[c.alias(k) for k, c in ids.items()])


def inline_scripts(markup: Column) -> Column:
    """The texts of script elements without a source."""
    closed = let(F.split(markup, r"(?i)</script\s*>"), lambda p: F.slice(p, F.lit(1), F.size(p) - 1))
    opened = F.transform(closed, lambda x: F.struct(F.regexp_extract(x, r"(?is)<script(?=[\s>])([^<>]*)>", 1).alias("tag"), F.regexp_extract(x, r"(?is)<script(?=[\s>])[^<>]*>(.*)$", 1).alias("text")))
    return F.filter(F.transform(F.filter(opened, lambda o: ~o["tag"].rlike(r"(?i)\ssrc\s*=")), lambda o: F.trim(o["text"])), lambda x: x != "")


def script_disclosures(scripts: Column, url: Column) -> Column:
    """Source maps and bundlers that scripts (array of texts) give away."""
    maps = F.flatten(F.transform(scripts, lambda s: F.regexp_extract_all(s, F.lit(r"(?:/[/*])[#@]\s*sourceMappingURL=([^\s*'\"]+)"), F.lit(1))))
    every = F.array_join(scripts, "\n")
    bundlers = F.filter(F.array(*[F.when(every.rlike(p), F.lit(n)) for n, p in BUNDLERS.items()]), lambda x: x.isNotNull())
    return F.struct(_distinct(F.transform(maps, lambda m: absolute(url, m))).alias("source_map_urls"), bundlers.alias("bundlers"))


def json_telephones(script: Column) -> Column:
    """Values of `telephone` at any depth of a JSON text. The text is written anew
    from what was parsed, in which a quote inside a string is escaped and a key
    is followed by a colon at once: so this finds keys and nothing else. Not JSON
    (or a key twice in one object): none."""
    plain = F.to_json(F.try_parse_json(script))
    held = F.regexp_extract_all(plain, F.lit(r'(?<!\\)"telephone":"((?:[^"\\]|\\.)*)"'), F.lit(1))
    values = F.flatten(F.transform(held, lambda v: F.from_json(F.concat(F.lit('["'), v, F.lit('"]')), _LIST)))
    return F.coalesce(values, F.array().cast(_LIST))


def declared_phones(markup: Column, scripts: Column, meta: Column) -> Column:
    """Numbers that a page declares: tel: links, structured data, meta tags and
    microdata; normal form, sorted."""
    hrefs = F.transform(tags(markup, "a"), lambda t: attribute(t, "href"))
    links = F.transform(F.filter(hrefs, lambda h: h.rlike(r"(?i)^(?:tel|callto|sms):")), lambda h: F.regexp_replace(h, r"(?i)^(?:tel|callto|sms):/*", ""))
    data = F.flatten(F.transform(F.filter(scripts, lambda s: F.lower(s).contains("telephone")), json_telephones))
    micro = F.transform(F.filter(F.regexp_extract_all(markup, F.lit(r"(?is)<([a-z][^<>]*\sitemprop\s*=\s*[\"']?telephone\b[^<>]*)>"), F.lit(1)), lambda t: F.coalesce(attribute(t, "content"), attribute(t, "href")).isNotNull()), lambda t: F.regexp_replace(F.coalesce(attribute(t, "content"), attribute(t, "href")), "^tel:", ""))
    inner = F.regexp_extract_all(markup, F.lit(r"(?is)<[a-z][^<>]*\sitemprop\s*=\s*[\"']?telephone\b[^<>]*>([^<]{5,60})<"), F.lit(1))
    named = F.flatten(F.array(*[F.coalesce(F.element_at(meta, k), F.array().cast(_LIST)) for k in ("og:phone_number", "business:contact_data:phone_number", "telephone", "phone", "contact:phone_number")]))
    return F.array_sort(_distinct(F.transform(F.concat(links, data, micro, inner, named), lambda p: X.normal_phone(p))))


def homepages(pages: DataFrame, markup: str, url: str, decode_title: Callable[[Column], Column] = unescape) -> DataFrame:
    """pages with all that each home page says, in the columns of PAGE_FIELDS.
    Null and empty pages: empty fields. Wallets need checksums and are read apart
    (wallets.wallets_in). decode_title: how references in titles are read. Each step uses the columns of the one before, so that
    nothing is computed twice."""
    names = [c for c in pages.columns if c not in PAGE_FIELDS]
    none = F.array().cast(_LIST)
    page, at = F.col("__page"), F.col("__url")
    bare = X.cut(X.cut(page, "<!--", "-->"), r"(<script(?=[\s>])[^<>]*>)", r"</script\s*>", "$1")
    steps = pages.select(*names, F.coalesce(F.col(markup), F.lit("")).alias("__page"), F.col(url).alias("__url")).withColumn("__bare", bare)
    rels = lambda t: F.filter(F.split(F.lower(F.regexp_replace(F.coalesce(attribute(t, "rel"), F.lit("")), ",", " ")), r"\s+"), lambda x: x != "")
    link = lambda t: F.struct(absolute(at, attribute(t, "href")).alias("href"), rels(t).alias("rel"), attribute(t, "type").alias("type"), attribute(t, "sizes").alias("sizes"))
    flag = lambda t, word: t.rlike(rf"(?i)(?:^|\s){word}(?=[\s=/]|$)")
    part = lambda u, what: F.nullif(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)([^?#]*)", what), F.lit(""))
    asset = lambda t: F.struct(absolute(at, attribute(t, "src")).alias("url"), attribute(t, "type").alias("type"), attribute(t, "integrity").alias("integrity"), attribute(t, "crossorigin").alias("crossorigin"), flag(t, "async").alias("async"), flag(t, "defer").alias("defer"))
    located = lambda a: a.withField("host", part(a["url"], 1)).withField("path", part(a["url"], 2)).withField("filename", F.nullif(F.regexp_extract(part(a["url"], 2), r"([^/]+)/*$", 1), F.lit("")))
    steps = steps.withColumns({
        "meta_tags": meta_tags(F.col("__bare")), "__scripts": inline_scripts(page), "__links": F.transform(tags(F.col("__bare"), "link"), link), "__anchors": F.transform(tags(F.col("__bare"), "a"), link),
        "__assets": F.array_distinct(F.filter(F.transform(tags(F.col("__bare"), "script"), asset), lambda a: a["url"].isNotNull())), "__ids": tag_ids(page), "__text": X.html_text(page),
    })
    of = lambda key: F.coalesce(F.element_at("meta_tags", F.lit(key)), none)
    first = lambda key: F.get(of(key), F.lit(0))
    has = lambda x, word: F.array_contains(x["rel"], word) & x["href"].isNotNull()
    me = _distinct(F.transform(F.filter(F.concat("__links", "__anchors"), lambda x: has(x, "me")), lambda x: x["href"]))
    icon = lambda x: F.exists(x["rel"], lambda r: (r == "icon") | r.startswith("apple-touch-icon")) & x["href"].isNotNull()
    steps = steps.withColumns({
        "rel_me_links": me, "script_assets": F.transform("__assets", located), "authors": F.array_distinct(F.concat(of("author"), of("article:author"), of("profile:username"))),
        "favicon_links": F.array_distinct(F.transform(F.filter("__links", icon), lambda x: x.withField("rel", F.array_sort(F.array_distinct(x["rel"]))))),
        "__said": script_disclosures(F.col("__scripts"), at),
        "__social": social_profiles(F.array_join(F.concat(F.array(page), F.transform("__anchors", lambda x: x["href"]), me, F.flatten(F.map_values("meta_tags"))), "\n")),
    })
    named = lambda platform, values: F.transform(F.filter(values, lambda v: v != ""), lambda v: F.struct(F.lit(platform).alias("k"), v.alias("v")))
    spelt = lambda key: F.transform(F.filter(F.slice(of(key), 1, 1), lambda v: v.startswith("@")), lambda v: F.substring(v, 2, 200))
    channel = F.transform(F.slice(of("telegram:channel"), 1, 1), lambda v: F.trim(F.regexp_replace(v, "^@+", "")))
    pair = lambda field: F.transform("__social", lambda z: F.struct(z["k"].alias("k"), z[field].alias("v")))
    known = F.create_map(*[F.lit(x) for kv in VERIFICATION_META.items() for x in kv])
    proofs = F.flatten(F.transform(F.map_entries("meta_tags"), lambda e: F.transform(e["value"], lambda v: F.struct(F.element_at(known, e["key"]).alias("k"), v.alias("v")))))
    canonical = F.filter("__links", lambda x: has(x, "canonical"))
    fields = {
        "title": F.nullif(X.normal_space(decode_title(let(F.split(F.col("__bare"), "(?i)</title", 2), lambda p: F.when(F.size(p) > 1, F.regexp_extract(F.element_at(p, 1), r"(?is)<title(?=[\s>])[^<>]*>(.*)$", 1))))), F.lit("")), **{k: F.col(f"__ids.{k}") for k in TAG_IDS},
        "html_lang": F.lower(F.get(F.transform(tags(F.col("__bare"), "html"), lambda t: attribute(t, "lang")), F.lit(0))), "cms_generator": first("generator"), "author": F.get("authors", F.lit(0)), "authors": F.col("authors"),
        "fb_app_id": first("fb:app_id"), "twitter_site": first("twitter:site"), "twitter_creator": first("twitter:creator"), "social_links": _grouped(pair("l")),
        "social_handles": _grouped(F.concat(pair("v"), named("twitter_x", F.concat(spelt("twitter:site"), spelt("twitter:creator"))), named("telegram", channel))),
        "social_meta": F.map_filter("meta_tags", lambda k, v: k.rlike("^(?:og|twitter|fb|article|profile):")), "site_verifications": _grouped(F.filter(proofs, lambda p: p["k"].isNotNull())), "meta_tags": F.col("meta_tags"),
        "rel_me_links": F.col("rel_me_links"), "canonical_url": F.get(canonical, F.size(canonical) - 1)["href"], "favicon_links": F.col("favicon_links"), "script_assets": F.col("script_assets"),
        "script_urls": F.transform("script_assets", lambda a: a["url"]), "script_asset_hosts": _distinct(F.transform("script_assets", lambda a: a["host"])), "inline_source_map_urls": F.col("__said.source_map_urls"),
        "inline_bundlers": F.col("__said.bundlers"), "homepage_text_hash": F.when(page != "", X.text_hash(F.col("__text"))), "phone_numbers": F.array_sort(F.array_union(declared_phones(F.col("__bare"), F.col("__scripts"), F.col("meta_tags")), X.phones_said(F.col("__text")))),
    }
    return steps.select(*names, *[c.alias(k) for k, c in fields.items()])
