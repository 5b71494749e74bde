"""A home page, field by field."""

from linkloom.functions import pages as P

PAGE = """<!doctype html><HTML lang="De-AT"><head><title>
 Own &amp; Sons &#8211; &eacute;&#xE9; </title>
<!-- <meta name="generator" content="hidden"> -->
<meta name="Generator" content="Ghost 5.0"><meta property='og:title' content='A "B"'/><meta name=author content=Ann><meta name="article:author" content="Bo"><meta name="author" content="Ann">
<meta name="google-site-verification" content="g1"><meta name="google-site-verification" content="g2"><meta name="msvalidate.01" content="m1"><meta property="fb:app_id" content="77"><meta name="twitter:site" content="@own_site"><meta name="telegram:channel" content="@@chan">
<meta http-equiv="refresh" content="5"><meta itemprop="name" content=" x "><meta name="empty" content=""><meta name="og:phone_number" content="+49 30 555123">
<link rel="canonical" href="/a/../home?x=1&amp;y=2"><link rel="shortcut icon" href="img/f.ico" type="image/x-icon"><link rel="apple-touch-icon-precomposed" sizes="57x57" href="//cdn.test/i.png"><link rel=me href="https://mastodon.test/@own">
<script src="../js/app.min.js" async integrity="sha-1"></script><script defer src='https://cdn.test/_next/x.js'></script><script src="../js/app.min.js" async integrity="sha-1"></script>
<script>ga('create','UA-12345-1'); fbq('init', '123456789012'); ym(12345678, 'init'); ttq.load("ABCDEFGHIJKLMNOPQ"); webpackChunk.push(1);
//# sourceMappingURL=main.js.map
</script><script type="application/ld+json">{"@type":"Organization","telephone":"+43 1 2345987"}</script></head>
<body>G-ABCDEFGH12 logo-G-ABCDEFGH13.png GTM-ABC123 <a href="tel:0049%20">x</a><a href="tel:+49-89-1230987">call</a><a rel="nofollow me" href="https://own.test/about">me</a>
<a href="https://t.me/own_channel">t</a> <a href="https://t.me/share">no</a> <a href="https://www.instagram.com/own.page/?x=1">i</a> <a href="https://facebook.com/profile.php?id=1">f</a> https://x.com/own_x. ca-PUB-1234567890123456
<span itemprop="telephone">+41 44 668 18 01</span></body></html>"""


def read(spark, page, url="https://own.test/de/index.html"):
    return P.homepages(spark.createDataFrame([(page, url, 1)], "html string, url string, title int"), "html", "url").collect()[0]


def test_every_field(spark):
    r = read(spark, PAGE)
    assert r.title == "Own & Sons – éé" and r.html_lang == "de-at" and r.cms_generator == "Ghost 5.0"
    assert r.author == "Ann" and r.authors == ["Ann", "Bo"] and r.fb_app_id == "77" and r.twitter_site == "@own_site" and r.twitter_creator is None
    assert r.google_analytics == ["G-ABCDEFGH12", "UA-12345-1"] and r.gtm_ids == ["GTM-ABC123"] and r.facebook_pixel == ["123456789012"]
    assert r.tiktok_pixel == ["ABCDEFGHIJKLMNOPQ"] and r.yandex_metrika == ["12345678"] and r.adsense_ids == ["ca-pub-1234567890123456"]
    assert r.site_verifications == {"google": ["g1", "g2"], "bing": ["m1"]}
    assert r.meta_tags["og:title"] == ['A "B"'] and r.meta_tags["refresh"] == ["5"] and r.meta_tags["name"] == ["x"] and "empty" not in r.meta_tags
    assert set(r.social_meta) == {"og:title", "article:author", "fb:app_id", "twitter:site", "og:phone_number"}
    assert r.social_handles == {"telegram": ["own_channel", "chan"], "instagram": ["own.page"], "twitter_x": ["own_x", "own_site"], "mastodon": ["own"]}
    assert r.social_links["instagram"] == ["https://www.instagram.com/own.page"]
    assert r.rel_me_links == ["https://mastodon.test/@own", "https://own.test/about"] and r.canonical_url == "https://own.test/home?x=1&y=2"
    assert [(f.href, f.rel, f.type, f.sizes) for f in r.favicon_links] == [("https://own.test/de/img/f.ico", ["icon", "shortcut"], "image/x-icon", None), ("https://cdn.test/i.png", ["apple-touch-icon-precomposed"], None, "57x57")]
    assert r.script_urls == ["https://own.test/js/app.min.js", "https://cdn.test/_next/x.js"] and r.script_asset_hosts == ["own.test", "cdn.test"]
    one, two = r.script_assets
    assert (one.path, one.filename, one.integrity, one["async"], one.defer) == ("/js/app.min.js", "app.min.js", "sha-1", True, False) and two.defer and not two["async"]
    assert r.inline_source_map_urls == ["https://own.test/de/main.js.map"] and r.inline_bundlers == ["webpack"]
    assert {"+49891230987", "+41446681801", "+4312345987", "+4930555123"} <= set(r.phone_numbers) and len(r.homepage_text_hash) == 64


def test_edges(spark):
    for page in (None, ""):
        r = read(spark, page, None)
        assert r.title is None and r.meta_tags == {} and r.script_assets == [] and r.homepage_text_hash is None and r.phone_numbers == []
    hostile = read(spark, "<meta name='a' content='b" * 20_000 + "<a href=\"" * 20_000 + "<script>" * 5_000 + "<!--" * 5_000 + "<title>" * 5_000)
    assert hostile.title is None


def test_references(spark):
    from pyspark.sql import functions as F

    cases = {"a &amp; b &lt; &#65;&#x1F600; &copy &bogus; &#0; &amp;lt;": "a & b < A😀 &copy &bogus; � &lt;", "": "", "none": "none", "&": "&", "&&amp;": "&&"}
    got = spark.createDataFrame([(k,) for k in cases], "t string").select("t", P.unescape(F.col("t")).alias("u")).collect()
    assert {r.t: r.u for r in got} == cases
