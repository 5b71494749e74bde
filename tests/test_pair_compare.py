"""The whole comparison of document pairs on a few rows."""

from linkloom import constants as K
from linkloom.operators import identifiers as I

CERT, SSH = K.CERT_PATHS[0], K.SSH_PATH


def table(spark, schema, rows):
    return spark.createDataFrame(rows, schema)


def compared(spark, matches, **more):
    m = table(spark, "a string, b string, path string, n_values long", [(a, b, p, 1) for a, b, p in matches])
    return {(r.a, r.b): r for r in I.compare_pairs(m, **more).collect()}


def test_parts_add_up(spark):
    cert = table(spark, "a string, b string, cert_quality string", [("1", "2", "weak"), ("1", "3", "junk")])
    fresh = table(spark, "a string, b string, freshness string", [("1", "2", "historical")])
    refer = table(spark, "a string, b string, ip string, relationship string", [("1", "2", "x", "shared_referrer"), ("1", "2", "y", "both_third_party"), ("4", "5", "x", "mixed"), ("6", "7", "x", "shared_referrer")])
    labels = table(spark, "a string, b string, n_labels long, weight int", [("1", "2", 2, 16), ("8", "9", 9, 40)])
    got = compared(spark, [("1", "2", CERT), ("1", "2", "dns.A"), ("1", "3", CERT)], certificates=cert, addresses=fresh, referrers=refer, labels=labels)
    points = int(K.PATH_WEIGHTS[CERT] * 0.3) + int(K.PATH_WEIGHTS["dns.A"] * 0.3)
    assert got["1", "2"].score == points + 50 + 20 + 16 and got["1", "2"].match_count == 2 and got["1", "2"].label_weight == 16
    assert got["1", "3"].score == 0 and got["1", "3"].cert_quality == "junk" and got["1", "3"].strength == "moderate"
    assert (got["4", "5"].score, got["4", "5"].strength, got["6", "7"].score, got["8", "9"].score) == (0, "weak", 50, 40)


def test_platform_keys(spark):
    """A key says nothing of the owner once either side is on a shared platform."""
    on = lambda *docs: table(spark, "doc string", [(d,) for d in docs])
    plain = compared(spark, [("1", "2", SSH)])["1", "2"]
    assert plain.strength == "strong" and plain.score == K.PATH_WEIGHTS[SSH]
    for doc in "12":
        demoted = compared(spark, [("1", "2", SSH)], platforms=on(doc, doc))["1", "2"]
        assert demoted.score == int(K.PATH_WEIGHTS[SSH] * 0.2) and demoted.strength == "moderate"


def test_strong_certificate_and_nothing(spark):
    cert = table(spark, "a string, b string, cert_quality string", [("1", "2", "strong")])
    assert compared(spark, [("1", "2", CERT)], certificates=cert)["1", "2"].strength == "strong"
    assert compared(spark, []) == {}
