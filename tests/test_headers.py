"""Headers of responses, and origins of older documents."""

import json

from pyspark.sql import functions as F

from linkloom.functions import headers as N
from linkloom.operators import projection as R


def test_fingerprint(spark):
    sent = [("Server", "nginx"), ("X-Powered-By", "PHP"), ("SET-COOKIE", "sid=1; Path=/; HttpOnly"), ("Set-Cookie", "a=2; Expires=Thu, 01 Jan 2026 00:00:00 GMT, b=3; path=/, Path=x"), ("set-cookie", "sid=9"), ("server", "second"), ("X-Drupal-Cache", "HIT"), ("x-drupal-cache", "MISS"), ("Empty", None), (None, "x"), ("Server", "third")]
    rows = spark.createDataFrame([(1, sent), (2, None), (3, [])], "i int, h array<struct<name:string,value:string>>").select("i", N.http_fingerprint(F.col("h")).alias("f")).select("i", "f.*").orderBy("i").collect()
    full = rows[0]
    assert (full.server, full.x_powered_by, full.content_security_policy) == ("nginx", "PHP", None)
    assert full.set_cookie_names == ["sid", "a", "b"] and full.x_drupal_headers == {"x-drupal-cache": ["HIT", "MISS"]}
    assert full.header_order == ["server", "x-powered-by", "set-cookie", "set-cookie", "set-cookie", "server", "x-drupal-cache", "x-drupal-cache", "server"]
    assert full.header_names == ["server", "x-powered-by", "set-cookie", "x-drupal-cache"] and full.headers["Server"] == "third" and full.headers["server"] == "second"
    for r in rows[1:]:
        assert r.headers == {} and r.header_order == r.header_names == r.set_cookie_names == [] and r.x_drupal_headers == {} and r.server is None


def test_origins_of_older_documents(spark):
    hit = lambda ip: {"hits": [{"ip": ip, "source": "s", "asn": "AS1"}]}
    docs = [
        {"input": "a.test", "timestamp": "2024", "censys": hit("10.0.0.1")}, {"input": "b.test", "timestamp": "2024", "censys": hit("10.0.0.2"), "origin_candidates": {"censys": hit("10.0.0.3")}},
        {"input": "c.test", "timestamp": "2024", "shodan": hit("10.0.0.4"), "origin_candidates": {"censys": hit("10.0.0.5")}}, {"input": "d.test", "timestamp": "2024", "censys": "none"},
    ]
    parsed = R.parsed(spark.createDataFrame([(str(i), json.dumps(d)) for i, d in enumerate(docs)], "run string, json string"))
    found = {(r.src, r.dst) for r in R.edges(parsed).where("kind = 'resolves_to'").collect()}
    assert found == {("a.test", "10.0.0.1"), ("b.test", "10.0.0.3"), ("c.test", "10.0.0.4"), ("c.test", "10.0.0.5")}
