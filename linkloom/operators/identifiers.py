"""Identifier comparison, document-pair matching and discovery ranking."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.scoring import confidence, one_of
from ..storage import written


def frequency(identifiers: DataFrame) -> DataFrame:
    """How many domains hold each identifier, and what follows from that:
    normal, downweighted or excluded, and the multiplier.

    identifiers: domain, type, category, value."""
    counted = identifiers.groupBy("type", "category", "value").agg(F.countDistinct("domain").alias("domains"))
    down = one_of(F.col("category"), {k: float(v[0]) for k, v in K.FREQUENCY_RULES.items()}, F.lit(4.0))
    out = one_of(F.col("category"), {k: float(v[1]) for k, v in K.FREQUENCY_RULES.items()}, F.lit(16.0))
    n = F.col("domains").cast("double")
    status = F.when(n > out, "excluded").when(n > down, "downweighted").otherwise("normal")
    return counted.withColumn("status", status).withColumn("multiplier", F.when(n > out, 0.0).when(n > down, F.greatest(F.lit(0.2), down / n)).otherwise(1.0))


def identifier_score(tier: Column, category: Column, multiplier: Column, bonus: Column | None = None) -> Column:
    base = one_of(tier, {k: float(v) for k, v in K.TIER_SCORES.items()}, F.lit(12.0)) + one_of(category, {k: float(v) for k, v in K.CATEGORY_SCORES.items()}, F.lit(0.0))
    base = base if bonus is None else base + bonus
    held = F.least(F.lit(100.0), F.greatest(F.lit(1.0), base))
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.bround(held * multiplier, 0)))


def score_label(score: Column) -> Column:
    return F.when(score >= 85, "high").when(score >= 60, "medium").when(score >= 30, "low").otherwise("very_low")


def shared_points(identifiers: DataFrame, freq: DataFrame, timing: DataFrame | None = None) -> DataFrame:
    """Evidence of pairs of domains (a < b): a, b, tier, category, points for
    each shared identifier that is not excluded, and for certificates issued close
    together (timing: of issuance_timing()).

    identifiers: domain, type, tier, category, value. Values over the limit of
    their category go before the join, which bounds its groups."""
    rows = telling(identifiers, freq)
    x, y = rows.alias("x"), rows.select(F.col("domain").alias("b"), "type", "value").alias("y")
    shared = x.join(y, ["type", "value"]).where("domain < b").select(F.col("domain").alias("a"), "b", "tier", "category", identifier_score(F.col("tier"), F.col("category"), F.col("multiplier")).alias("points"))
    return shared if timing is None else with_timing(shared, timing)


def telling(identifiers: DataFrame, freq: DataFrame) -> DataFrame:
    """Identifiers that two domains or more share and that are not excluded, with
    their multiplier."""
    kept = freq.where("status <> 'excluded' AND domains >= 2").select("type", "value", "multiplier")
    return identifiers.select("domain", "type", "tier", "category", "value").distinct().join(kept, ["type", "value"])


def with_timing(shared: DataFrame, timing: DataFrame) -> DataFrame:
    """Evidence of pairs, with certificates issued close together as further pieces
    of it. shared: of shared_points(); timing: of issuance_timing()."""
    near = F.col("within") == "24h"
    tier, tls_ct = F.when(near, "tier_3").otherwise("tier_4"), F.lit("tls_ct")
    points = identifier_score(tier, tls_ct, F.lit(1.0), F.when(near, 6).otherwise(2))
    return shared.unionByName(timing.select(*_pair(shared), tier.alias("tier"), tls_ct.alias("category"), points.alias("points")))


def evidence(shared: DataFrame, certs: DataFrame, day_limit: int = 7) -> DataFrame:
    """with_timing() of all pairs whose certificates were issued close together,
    those that share nothing else too. Both sides are dealt by cell, so that what
    is summed by pair needs no further shuffle.

    shared: of shared_points(); certs: domain, issuer, issued (timestamp)."""
    blocks = timing_blocks(certs, day_limit)
    dealt = shared.withColumn("cell", _cell(_block("a", blocks), _block("b", blocks), blocks)).repartition(blocks * blocks, "cell")
    return with_timing(dealt, _all_timing(certs, blocks, day_limit))


def _pair(points: DataFrame) -> list[str]:
    """What a pair is summed by: the cell too, if its evidence is dealt by cell."""
    return [c for c in ("cell", "a", "b") if c in points.columns]


def tier_sums(points: DataFrame) -> DataFrame:
    """Per pair and tier: the sum of the points, 100 at most, its label, and the
    number of pieces of evidence. points: of shared_points()."""
    sums = points.groupBy(*_pair(points), "tier").agg(F.least(F.lit(100.0), F.sum("points")).alias("score"), F.count(F.lit(1)).alias("n_evidence"))
    return sums.select("a", "b", "tier", F.round("score", 2).alias("score"), "n_evidence").withColumn("label", score_label(F.col("score")))


def compare(identifiers: DataFrame, freq: DataFrame, timing: DataFrame | None = None) -> DataFrame:
    """Pairs of domains with what they share: the sum of all points, with bonuses
    for different kinds and tiers, 100 at most."""
    return compared(shared_points(identifiers, freq, timing))


def compared(points: DataFrame) -> DataFrame:
    """compare() from the evidence of pairs, with or without timing."""
    by = _pair(points)
    dealt = points if "cell" in by else points.repartition("a", "b")
    kinds = dealt.groupBy(*by, "tier", "category").agg(F.sum("points").alias("total"), F.count(F.lit(1)).alias("n_shared"))
    tiers = kinds.groupBy(*by, "tier").agg(F.sum("total").alias("total"), F.count(F.when(F.col("tier").isNotNull() & F.col("category").isNotNull(), 1)).alias("kinds"), F.sum("n_shared").alias("n_shared"))
    pairs = tiers.groupBy(*by).agg(F.sum("total").alias("total"), F.sum("kinds").alias("kinds"), F.count("tier").alias("tiers"), F.sum("n_shared").alias("n_shared"))
    score = F.least(F.lit(100.0), F.col("total") + 4 * (F.col("kinds") - 1) + 6 * (F.col("tiers") - 1))
    return pairs.select("a", "b", "n_shared", F.round(score, 2).alias("score")).withColumn("label", score_label(F.col("score")))


def sharing(points: DataFrame) -> DataFrame:
    """a, b: the pairs that share an identifier. points: of shared_points()."""
    return points.select("a", "b").distinct()


#: Pairs of certificates that meet in one cell of _all_timing(), about.
CELL_PAIRS = 4_000_000


def issuance_timing(certs: DataFrame, pairs: DataFrame | None = None, day_limit: int = 7) -> DataFrame:
    """Pairs of domains with certificates of one issuer issued close together
    (not at once): the closest pair per two domains and issuer, of those within
    a day and of those further apart each.

    certs: domain, issuer, issued (timestamp). Without pairs all pairs (a < b) are
    found, whose number grows with the square of an issuer's certificates in a
    week. pairs: a, b, that are asked for, such as those of sharing(); rows then
    grow with the pairs and the certificates of each domain, not with the customers
    of an issuer. Certificates meet by domain, issuer and bucket or neighbouring
    bucket of day_limit days. Nulls meet nothing."""
    if pairs is None:
        return _all_timing(certs, timing_blocks(certs, day_limit), day_limit).drop("cell")
    width = day_limit * 86_400
    t = F.unix_timestamp("issued")
    left = certs.select(F.col("domain").alias("a"), "issuer", t.alias("ta"), F.floor(t / width).alias("bucket")).distinct()
    right = certs.select(F.col("domain").alias("b"), "issuer", t.alias("tb"), F.explode(_around(t, width)).alias("bucket")).distinct()
    asked = pairs.select("a", "b").where("a <> b").distinct()
    return _closest(left.join(asked, "a").join(right, ["b", "issuer", "bucket"]), ["a", "b"], day_limit)


def timing_blocks(certs: DataFrame, day_limit: int = 7) -> int:
    """Into how many blocks domains are dealt, so that a cell (a block against a
    block) has about CELL_PAIRS certificates that meet; these are counted first."""
    bucket = F.floor(F.unix_timestamp("issued") / (day_limit * 86_400))
    n = certs.where("issuer IS NOT NULL AND issued IS NOT NULL").groupBy("issuer", bucket.alias("bucket")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    around = n.select("issuer", F.explode(F.array(F.col("bucket") - 1, F.col("bucket"), F.col("bucket") + 1)).alias("bucket"), F.col("n").alias("m"))
    meet = n.join(around, ["issuer", "bucket"]).agg(F.sum(F.col("n") * F.col("m"))).first()[0] or 0.0
    return max(8, math.ceil(math.sqrt(meet / CELL_PAIRS)))


def _all_timing(certs: DataFrame, blocks: int, day_limit: int) -> DataFrame:
    """issuance_timing() of all pairs, with the cell that each is found in. Every
    certificate goes to one row and one column of cells, so a large issuer's
    customers are spread and a pair's certificates are in one task. They meet by
    grouping, which keeps to the cells where a join would deal them anew."""
    width = day_limit * 86_400
    rows = certs.where("domain IS NOT NULL AND issuer IS NOT NULL AND issued IS NOT NULL").select("domain", "issuer", F.unix_timestamp("issued").alias("t")).distinct()
    own, other = _block("domain", blocks), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    spread = rows.withColumn("own", own).withColumn("other", other)
    sides = F.explode(F.array(F.struct(F.lit(True).alias("left"), _cell(F.col("own"), F.col("other"), blocks).alias("cell")), F.struct(F.lit(False).alias("left"), _cell(F.col("other"), F.col("own"), blocks).alias("cell"))))
    dealt = spread.select("domain", "issuer", "t", sides.alias("s")).select("s.cell", "s.left", "domain", "issuer", "t").repartition(blocks * blocks, "cell")
    at = dealt.withColumn("bucket", F.explode(F.when(F.col("left"), F.array(F.floor(F.col("t") / width))).otherwise(_around(F.col("t"), width))))
    one = F.struct("domain", "t")
    groups = at.groupBy("cell", "issuer", "bucket").agg(F.collect_list(F.when(F.col("left"), one)).alias("x"), F.collect_list(F.when(~F.col("left"), one)).alias("y")).where("size(x) > 0 AND size(y) > 0")
    met = groups.select("cell", "issuer", "y", F.explode("x").alias("x")).select("cell", "issuer", "x", F.explode("y").alias("y")).select("cell", "issuer", F.col("x.domain").alias("a"), F.col("x.t").alias("ta"), F.col("y.domain").alias("b"), F.col("y.t").alias("tb"))
    return _closest(met.where("a < b"), ["cell", "a", "b"], day_limit)


def _around(t: Column, width: int) -> Column:
    return F.array(F.floor(t / width) - 1, F.floor(t / width), F.floor(t / width) + 1)


def _block(domain: str, blocks: int) -> Column:
    return F.pmod(F.hash(domain), F.lit(blocks))


def _cell(row: Column, column: Column, blocks: int) -> Column:
    return row * blocks + column


def _closest(met: DataFrame, by: list[str], day_limit: int) -> DataFrame:
    gap = F.abs(F.col("ta") - F.col("tb"))
    within = F.when(gap <= 86_400, "24h").otherwise(f"{day_limit}d")
    return met.where((gap > 0) & (gap <= day_limit * 86_400)).groupBy(*by, "issuer", within.alias("within")).agg(F.min(gap).alias("seconds"))


# ---- walks over compared domains, without their pairs ----

#: What timing alone gives a pair, at least.
TIMING_POINTS = 30.0


def walk(identifiers: DataFrame, certs: DataFrame, seeds: DataFrame | None = None, depth: int = 2, min_score: float = 20.0, day_limit: int = 7) -> DataFrame:
    """Domains (node) that are reached from seeds (node) in at most depth steps over
    pairs of compared(), timing of all pairs included, that score min_score: node and
    hop_distance. Without seeds: from the first domain that has such a pair.

    What is reached by timing is found by the nearest certificates of the frontier
    before and after each other one, so no pairs of certificates are made, and
    identifiers are compared of the frontier and what is not reached yet alone. As
    timing alone has to be enough for a step, min_score is at most TIMING_POINTS.
    identifiers: of telling(), written, as they are read several times."""
    if min_score > TIMING_POINTS:
        raise ValueError(f"min_score: at most {TIMING_POINTS}")
    issued = certs.where("domain IS NOT NULL AND issuer IS NOT NULL AND issued IS NOT NULL").select("domain", "issuer", F.unix_timestamp("issued").alias("t")).distinct()
    seen = written((first_linked(identifiers, issued, min_score, day_limit) if seeds is None else seeds.select("node").distinct()).withColumn("hop_distance", F.lit(0)), "seeds")
    frontier = seen
    for n in range(1, depth + 1):
        timed = written(_timed_near(issued, frontier, seen, day_limit), "timed")
        met = seen.select("node").unionByName(timed)
        like = _points_between(identifiers.join(frontier.select(F.col("node").alias("domain")), "domain", "left_semi"), identifiers.join(met.select(F.col("node").alias("domain")), "domain", "left_anti"))
        alike = compared(like).where(F.col("score") >= min_score).select(F.col("b").alias("node")).distinct()
        frontier = written(timed.unionByName(alike).withColumn("hop_distance", F.lit(n)), "frontier")
        seen = seen.unionByName(frontier)
    return seen


def first_linked(identifiers: DataFrame, issued: DataFrame, min_score: float, day_limit: int) -> DataFrame:
    """The first domain (node) that has a pair, looked for among the first few, then
    among more and more of those after them. issued: domain, issuer, t."""
    width = day_limit * 86_400
    domains = written(issued.select("domain").unionByName(identifiers.select("domain")).distinct(), "domains")
    left, many = domains, 16
    while True:
        some = written(left.orderBy("domain").limit(many), "some")
        last = some.agg(F.max("domain")).first()[0]
        if last is None:
            return domains.select(F.col("domain").alias("node")).limit(0)
        x = issued.join(F.broadcast(some) if many <= 4096 else some, "domain", "left_semi").select(F.col("domain").alias("a"), "issuer", F.col("t").alias("ta"), F.explode(_around(F.col("t"), width)).alias("bucket"))
        met = x.join(issued.withColumn("bucket", F.floor(F.col("t") / width)), ["issuer", "bucket"]).where((F.col("a") != F.col("domain")) & F.abs(F.col("ta") - F.col("t")).between(1, width)).select("a")
        like = compared(_points_between(identifiers.join(some, "domain", "left_semi"), identifiers)).where(F.col("score") >= min_score).select("a")
        first = met.unionByName(like).agg(F.min("a").alias("node")).first()[0]
        if first is not None:
            return domains.where(F.col("domain") == first).select(F.col("domain").alias("node"))
        left, many = domains.where(F.col("domain") > last), many * 16


def _timed_near(issued: DataFrame, frontier: DataFrame, seen: DataFrame, day_limit: int) -> DataFrame:
    """Domains (node) not seen with a certificate issued close to one of the
    frontier's by the same issuer, not at once."""
    width = day_limit * 86_400
    marks = issued.join(frontier.select(F.col("node").alias("domain")), "domain", "left_semi").select("issuer", "t").distinct()
    marks = marks.select(F.lit(None).cast("string").alias("domain"), "issuer", F.explode(_around(F.col("t"), width)).alias("bucket"), "t", F.col("t").alias("mark"))
    others = issued.join(seen.select(F.col("node").alias("domain")), "domain", "left_anti").select("domain", "issuer", F.floor(F.col("t") / width).alias("bucket"), "t", F.lit(None).cast("long").alias("mark"))
    week = Window.partitionBy("issuer", "bucket")
    before = F.max("mark").over(week.orderBy("t").rangeBetween(Window.unboundedPreceding, -1))
    after = F.min("mark").over(week.orderBy(F.desc("t")).rangeBetween(Window.unboundedPreceding, -1))
    near = others.unionByName(marks).withColumns({"before": before, "after": after}).where("domain IS NOT NULL")
    return near.where((F.col("t") - F.col("before") <= width) | (F.col("after") - F.col("t") <= width)).select(F.col("domain").alias("node")).distinct()


def _points_between(some: DataFrame, others: DataFrame) -> DataFrame:
    """Evidence of pairs of one domain of some (a) and another of others (b), as the
    smaller one has it. Both: of telling()."""
    x, y = some.alias("x"), others.alias("y")
    met = x.join(y, (F.col("x.type") == F.col("y.type")) & (F.col("x.value") == F.col("y.value")) & (F.col("x.domain") != F.col("y.domain")))
    of = lambda c: F.when(F.col("x.domain") < F.col("y.domain"), F.col(f"x.{c}")).otherwise(F.col(f"y.{c}"))
    return met.select(F.col("x.domain").alias("a"), F.col("y.domain").alias("b"), of("tier").alias("tier"), of("category").alias("category"), identifier_score(of("tier"), of("category"), F.col("x.multiplier")).alias("points"))


# ---- document pairs ----


def _told(facts: DataFrame) -> DataFrame:
    return facts.where("value IS NOT NULL AND trim(value) NOT IN ('', '0', 'false', 'none', 'null')").distinct()


def common_values(facts: DataFrame, most: int = K.MOST_OWNERS) -> DataFrame:
    """What path_matches() leaves out as too common: path, value and the number of
    documents n. facts: doc, path, value."""
    return _told(facts).groupBy("path", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)


def path_matches(facts: DataFrame, most: int | None = K.MOST_OWNERS) -> DataFrame:
    """Values that two documents share at a path: a, b, path, n_values.

    facts: doc, path, value. Meets on (path, value); empty values do not count.
    Values of more documents than most say nothing of a pair and go before pairs
    are made, which bounds their groups; common_values() lists them. None: all stay.
    The result is dealt by a, so that what follows by a, or a and b, needs no
    further shuffle."""
    return _meetings(facts, most).repartition("a").groupBy("a", "b", "path").agg(F.count(F.lit(1)).alias("n_values"))


def _meetings(facts: DataFrame, most: int | None, *tags: str) -> DataFrame:
    """a, b, path for each value that two documents share, with columns tags of b's.
    A value's documents are counted where they lie, and if they are few put in one
    row, in which its pairs are made without a shuffle."""
    one = F.struct("doc", *tags)
    at = Window.partitionBy("path", "value")
    rows = facts.where("doc IS NOT NULL AND path IS NOT NULL").repartition("path", "value")
    rows = _told(rows.select("doc", "path", "value", *tags)).withColumn("n", F.count(F.lit(1)).over(at)).where("n >= 2")
    if most is None:
        rows = rows.select("path", "value", one.alias("x"))
        return rows.join(rows.withColumnRenamed("x", "y"), ["path", "value"]).where("x.doc < y.doc").select(F.col("x.doc").alias("a"), F.col("y.doc").alias("b"), "path", *[F.col(f"y.{t}").alias(t) for t in tags])
    owners = rows.where(F.col("n") <= most).groupBy("path", "value").agg(F.array_sort(F.collect_list(one)).alias("owners"))
    first = owners.select("path", "owners", F.posexplode("owners").alias("i", "x"))
    both = first.select("path", "x", F.explode(F.slice("owners", F.col("i") + 2, F.size("owners"))).alias("y"))
    return both.select(F.col("x.doc").alias("a"), F.col("y.doc").alias("b"), "path", *[F.col(f"y.{t}").alias(t) for t in tags])


def path_weight(path: Column, cert_mult: Column, ip_mult: Column, platform: Column) -> Column:
    """Weight of a shared path, cut down (to whole numbers) where the shared
    certificate, address or key says little."""
    weight = one_of(path, {k: float(v) for k, v in K.PATH_WEIGHTS.items()}, F.lit(float(K.DEFAULT_PATH_WEIGHT)))
    mult = F.when(path.isin(*K.CERT_PATHS), cert_mult).when(path == K.SSH_PATH, cert_mult * F.when(platform, 0.2).otherwise(1.0)).when(path.isin(*K.IP_PATHS), ip_mult).otherwise(1.0)
    return (weight * mult).cast("int")


def certificate_quality(matched: Column, relevant: Column, abandoned: Column) -> Column:
    return F.when(~matched, "n/a").when(abandoned, "junk").when(~relevant, "weak").otherwise("strong")


def certificate_multiplier(quality: Column) -> Column:
    return F.when(quality == "junk", 0.0).when(quality == "weak", 0.3).otherwise(1.0)


def freshness(shared: Column, current_a: Column, current_b: Column) -> Column:
    """Whether shared addresses are current on both sides; arrays."""
    both = F.array_intersect(current_a, current_b)
    now, old = F.size(F.array_intersect(shared, both)), F.size(F.array_except(shared, both))
    return F.when(F.size(shared) == 0, "n/a").when(old == 0, "current").when(now == 0, "historical").otherwise("mixed")


def freshness_multiplier(quality: Column) -> Column:
    return F.when(quality == "historical", 0.3).when(quality == "mixed", 0.7).otherwise(1.0)


def common_labels(labels: DataFrame, most: int = K.MOST_OWNERS) -> DataFrame:
    """What label_overlap() leaves out as too common: label and its owners n."""
    return labels.where("label IS NOT NULL").select("owner", "label").distinct().groupBy("label").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)


def label_overlap(labels: DataFrame, common: tuple[str, ...] = (), most: int | None = K.MOST_OWNERS) -> DataFrame:
    """Distinctive labels that two owners share: their number and weight.

    labels: owner, label. Labels of more owners than most are not distinctive and
    go before the join, which bounds its groups; common_labels() lists them.
    None: all stay."""
    rows = labels.where(~F.col("label").isin(*common) if common else F.lit(True)).select("owner", "label").distinct()
    owners = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    rows = rows.join((owners if most is None else owners.where(F.col("n") <= most)).select("label"), "label")
    pairs = rows.join(rows.select(F.col("owner").alias("b"), "label"), "label").where("owner < b")
    counted = pairs.groupBy(F.col("owner").alias("a"), "b").agg(F.count(F.lit(1)).alias("n_labels"))
    return counted.withColumn("weight", F.least(F.lit(K.LABEL_CAP), F.col("n_labels") * K.LABEL_WEIGHT).cast("int"))


def pair_strength(paths: Column, confidence: Column, cert_quality: Column, platform: Column) -> Column:
    """strong, moderate or weak for a pair, from its array of shared paths."""
    has = lambda *p: F.arrays_overlap(paths, F.array(*[F.lit(x) for x in p]))
    strong = ((cert_quality == "strong") & has(K.CERT_PATHS[0])) | (has(K.SSH_PATH) & ~platform) | has(*K.DECISIVE_PATHS) | (confidence >= 65)
    heavy = has(*[p for p, w in K.PATH_WEIGHTS.items() if w >= 30])
    return F.when(strong, "strong").when((confidence >= 35) | heavy, "moderate").otherwise("weak")


def compare_pairs(matches: DataFrame, certificates: DataFrame | None = None, addresses: DataFrame | None = None, platforms: DataFrame | None = None, referrers: DataFrame | None = None, labels: DataFrame | None = None) -> DataFrame:
    """The whole comparison of document pairs: a, b, score, confidence, strength,
    match_count, cert_quality, freshness, label_weight.

    matches: of path_matches(); certificates: a, b, cert_quality; addresses: a, b,
    freshness; platforms: doc, of documents on platforms whose keys are not their
    owners'; referrers: a, b, ip, relationship; labels: of label_overlap(). A pair
    is compared if any of matches, referrers and labels has it; what is not given
    of it counts as n/a. Each table is summed by pair before they meet."""
    none = F.lit("n/a")
    pairs = matches.select("a", "b", "path")
    pairs = pairs.withColumn("cert_quality", none) if certificates is None else pairs.join(certificates.select("a", "b", "cert_quality"), ["a", "b"], "left").fillna("n/a", ["cert_quality"])
    pairs = pairs.withColumn("freshness", none) if addresses is None else pairs.join(addresses.select("a", "b", "freshness"), ["a", "b"], "left").fillna("n/a", ["freshness"])
    pairs = pairs.withColumn("platform", F.lit(False))
    for side in ("a", "b") if platforms is not None else ():
        pairs = pairs.join(platforms.select(F.col("doc").alias(side)).distinct().withColumn("__on", F.lit(True)), side, "left").withColumn("platform", F.col("platform") | F.coalesce("__on", F.lit(False))).drop("__on")
    weight = path_weight(F.col("path"), certificate_multiplier(F.col("cert_quality")), freshness_multiplier(F.col("freshness")), F.col("platform"))
    summed = pairs.groupBy("a", "b").agg(F.sum(weight).alias("points"), F.count(F.lit(1)).alias("match_count"), F.collect_set("path").alias("paths"), F.first("cert_quality").alias("cert_quality"), F.first("freshness").alias("freshness"), F.first("platform").alias("platform"))
    for name, table in (("bonus", referrers), ("label_weight", labels)):
        if table is None:
            summed = summed.withColumn(name, F.lit(0))
        else:
            points = referrer_bonus(F.col("relationship")) if name == "bonus" else F.col("weight")
            summed = summed.join(table.groupBy("a", "b").agg(F.sum(points).alias(name)), ["a", "b"], "outer")
    score = (F.coalesce("points", F.lit(0)) + F.coalesce("bonus", F.lit(0)) + F.coalesce("label_weight", F.lit(0))).cast("long")
    scored = summed.withColumn("score", score).withColumn("confidence", confidence(score.cast("double")))
    quality, fresh = F.coalesce("cert_quality", none), F.coalesce("freshness", none)
    held = F.coalesce("paths", F.array().cast("array<string>"))
    return scored.select(
        "a", "b", "score", "confidence", pair_strength(held, F.col("confidence"), quality, F.coalesce("platform", F.lit(False))).alias("strength"), F.coalesce("match_count", F.lit(0)).cast("long").alias("match_count"),
        quality.alias("cert_quality"), fresh.alias("freshness"), F.coalesce("label_weight", F.lit(0)).cast("long").alias("label_weight"),
    )


def referrer_bonus(relationship: Column) -> Column:
    """What pages that refer to both documents add to their score."""
    return F.when(relationship == "shared_referrer", 50).when(relationship == "both_third_party", 20).otherwise(0)


# ---- discovery ----


def selector_rank(candidates: DataFrame, too_common: int = 500) -> DataFrame:
    """Candidates with a band: 0 useful, 1 unknown, 2 too common, 3 useless; the
    order is band, prior down, value. candidates: class, value, prior, hits."""
    hits = F.col("hits")
    band = F.when(hits.isNull(), 1).when(hits <= 1, 3).when(hits > too_common, 2).otherwise(0)
    return candidates.withColumn("band", band)


def one_per_class(ranked: DataFrame) -> DataFrame:
    by = Window.partitionBy("class").orderBy("band", F.desc("prior"), "value")
    return ranked.withColumn("n", F.row_number().over(by)).where("n = 1").drop("n")


def pivot_score(hits: Column) -> Column:
    """Worth of a pivot by how many domains hold it."""
    return F.when(hits.isNull(), 4).when(hits <= 2, 9).when(hits <= 5, 8).when(hits <= 20, 6).when(hits <= 100, 4).otherwise(2)


def sibling_pick(candidates: DataFrame, limit: int = 5) -> DataFrame:
    """Up to `limit` other apexes per target: certificate names before pages,
    each apex once. candidates: target, apex, branch, pos."""
    first = candidates.where("apex <> target").groupBy("target", "apex").agg(F.min(F.struct("branch", "pos")).alias("at"))
    by = Window.partitionBy("target").orderBy("at", "apex")
    return first.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= limit).select("target", "apex", F.col("at.branch").alias("branch"), "rank")


def followup_pick(hosts: DataFrame, keywords: tuple[str, ...], cap: int = 50, limit: int = 20, content_slots: int = 5) -> DataFrame:
    """Subdomains worth a look: the best by keywords, with some places kept for
    those without any. hosts: target, host."""
    score = sum((F.col("host").contains(k).cast("int") for k in keywords), F.lit(0))
    by = Window.partitionBy("target").orderBy(F.desc("score"), "host")
    probe = hosts.withColumn("score", score).withColumn("n", F.row_number().over(by)).where(F.col("n") <= cap).withColumn("content", F.col("score") == 0)
    tier = Window.partitionBy("target", "content").orderBy(F.desc("score"), "host")
    tiered = probe.withColumn("t", F.row_number().over(tier)).withColumn("first", F.col("content") & (F.col("t") <= content_slots))
    final = Window.partitionBy("target").orderBy(F.desc("first"), F.desc("score"), "host")
    return tiered.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= limit).select("target", "host", "score", "rank")
