"""Operator 1: mix sources to target weights.

Every document gets a hash-random key. Keys are cut into ranges within each
source, word counts are summed by (source, range), and a prefix sum over those
sums finds the one range where a source's budget ends; only that range is
sorted down to the row. The decision per source is then a number of whole
epochs, a cut key and the words of the document at the cut, so texts are never
shuffled and a source with most of the rows is spread over all its ranges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, hex_digits, materialize, read, word_count

#: Rows that one key range of a source should hold.
RANGE_ROWS = 50_000


def mix_key(doc_id: Column, size: Column, seed: str) -> Column:
    """Hash-random key: rows with one id and size share it."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), size.cast("string")))


def targets(sizes: DataFrame, weights: Sequence[int] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """Per source its target: weights repeat over the sources by code point
    (null last) and share all words; a target stops at cap times the source's
    size and the excess goes to the others by weight.

    sizes: one row per source (source, source_size, n_docs). The windows here
    run over one row per source, never over documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    all_rows = Window.partitionBy()
    w = F.element_at(F.array(*[F.lit(int(x)) for x in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sizes.withColumn("w", w.cast("long")).withColumn("cap", F.col("source_size") * cap)
    # Sources reach their caps in the order of cap / weight.
    by_level = Window.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    left = ranked.withColumns(
        {
            "total": F.sum("source_size").over(all_rows),
            "caps_before": F.coalesce(F.sum("cap").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
            "w_from": F.sum("w").over(by_level.rowsBetween(0, Window.unboundedFollowing)),
        }
    )
    capped = F.col("cap").cast("double") * F.col("w_from") <= F.col("w").cast("double") * (F.col("total") - F.col("caps_before"))
    marked = left.withColumn("capped", capped).withColumns(
        {
            "all_caps": F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(all_rows), F.lit(0)),
            "free_w": F.sum(F.when(~F.col("capped"), F.col("w"))).over(all_rows),
        }
    )
    share = (F.col("w") * (F.col("total") - F.col("all_caps"))).cast("double") / F.col("free_w").cast("double")
    return marked.withColumn("target", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(share)).select("source", "source_size", "n_docs", "target")


def plan(sized: DataFrame, weights: Sequence[int] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """Per source: source_size, target, whole epochs, the key where the last
    epoch is cut, and the words taken there from each row with that key.

    sized: a written table (source, key, size), read three times.
    """
    per_source = materialize(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs")), "mix-sources")
    goal = targets(per_source, weights, cap)
    budget = F.floor("target").cast("long")
    empty = F.col("source_size") == 0
    goal = goal.withColumn("epochs", F.when(empty, F.lit(0)).otherwise(F.floor(budget / F.when(empty, F.lit(1)).otherwise(F.col("source_size")))).cast("long"))
    goal = materialize(goal.withColumn("rest", budget - F.col("epochs") * F.col("source_size")), "mix-targets")

    digits = hex_digits(sized.count(), RANGE_ROWS)
    ranged = sized.withColumn("range", F.substring("key", 1, digits))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranged.groupBy("source", "range").agg(F.sum("size").alias("words")).withColumn("start", F.coalesce(F.sum("words").over(before), F.lit(0)))
    goals = broadcast_if_small(goal, 64)
    cut_range = (
        ranges.alias("r")
        .join(goals.alias("g"), F.col("r.source").eqNullSafe(F.col("g.source")))
        .where((F.col("start") <= F.col("rest")) & (F.col("rest") < F.col("start") + F.col("words")))
        .select("r.source", "range", F.col("rest") - F.col("start"))
        .toDF("source", "range", "left")
    )
    cut_range = broadcast_if_small(materialize(cut_range, "mix-cuts"), 64)
    keys = (
        ranged.alias("d")
        .join(cut_range.alias("c"), F.col("d.source").eqNullSafe(F.col("c.source")) & (F.col("d.range") == F.col("c.range")))
        .groupBy("d.source", "d.key", "c.left")
        .agg(F.sum("d.size").alias("words"), F.count(F.lit(1)).alias("rows"))
    )
    in_range = Window.partitionBy("source").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    cut = (
        keys.withColumn("at", F.coalesce(F.sum("words").over(in_range), F.lit(0)))
        .where((F.col("at") <= F.col("left")) & (F.col("left") < F.col("at") + F.col("words")))
        .select(F.col("source").alias("cut_source"), F.col("key").alias("cut_key"), F.floor((F.col("left") - F.col("at")) / F.col("rows")).cast("long").alias("cut_words"))
    )
    return goal.join(cut, F.col("source").eqNullSafe(F.col("cut_source")), "left").select("source", "source_size", "target", "epochs", "cut_key", "cut_words")


def taken(size: Column, key: Column) -> Column:
    """Words that the mix takes from a row, given its source's plan."""
    last = F.when(key < F.col("cut_key"), size).when(key == F.col("cut_key"), F.col("cut_words")).otherwise(F.lit(0))
    return (F.col("epochs") * size + F.coalesce(last, F.lit(0))).cast("long")


def mix(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), cap: int = 3, seed: str = "mix") -> DataFrame:
    """How many words a mix takes from each row of docs (doc_id, text, source).

    Returns doc_id, size, source_size, target, taken. The words taken from a
    source are its target rounded down (less at most one word for each row that
    ties at the cut). Same input, same result, whatever the partitions.

    Null or empty text: size 0, takes 0. Null source: a source of its own, last.
    Null doc_id: keyed as the word "null". Rows repeated whole: each counts;
    those at the cut share its words evenly. Empty table: empty result. Other
    columns are ignored.
    """
    size = word_count(F.col("text"))
    sized = docs.select("doc_id", "source", size.alias("size")).withColumn("key", mix_key(F.col("doc_id"), F.col("size"), seed))
    sized = materialize(sized, "mix-sizes")
    decided = broadcast_if_small(materialize(plan(sized, weights, cap), "mix-plan"), 128)
    joined = sized.alias("d").join(decided.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")))
    return joined.select("d.doc_id", "d.size", "p.source_size", "p.target", taken(F.col("size"), F.col("key")).alias("taken"))


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word (n >= 1)."""
    words = F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    return F.array_join(F.slice(words, F.lit(1), n.cast("int")), "")


def mixed_documents(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), cap: int = 3, seed: str = "mix") -> DataFrame:
    """The mix itself, in the columns of docs: a row for each whole epoch of a
    document, and for the document at a source's cut the words up to it.
    Rows of size 0 carry nothing and go. Nulls and ties as in mix()."""
    names, made = docs.columns, "__mix_"
    keyed = docs.withColumn(f"{made}size", word_count(F.col("text"))).withColumn(f"{made}key", mix_key(F.col("doc_id"), F.col(f"{made}size"), seed))
    sized = materialize(keyed.select("source", F.col(f"{made}size").alias("size"), F.col(f"{made}key").alias("key")), "mix-sizes")
    decided = plan(sized, weights, cap)
    decided = materialize(decided.select(*[F.col(c).alias(f"{made}{'by' if c == 'source' else c}") for c in decided.columns]), "mix-plan")
    size, key, epochs, cut = (F.col(f"{made}{c}") for c in ("size", "key", "epochs", "cut_key"))
    part = F.when(key == cut, F.col(f"{made}cut_words")).otherwise(F.lit(0))
    whole = epochs + F.when(key < cut, F.lit(1)).otherwise(F.lit(0))
    times = F.when(whole > 0, F.array_repeat(F.lit(None).cast("long"), whole.cast("int"))).otherwise(F.array().cast("array<bigint>"))
    pieces = F.concat(times, F.when((part > 0) & (part < size), F.array(part)).otherwise(F.array().cast("array<bigint>")))
    joined = keyed.join(broadcast_if_small(decided, 128), F.col("source").eqNullSafe(F.col(f"{made}by"))).where(size > 0)
    rows = joined.withColumn(f"{made}n", F.explode(pieces))
    text = F.when(F.col(f"{made}n").isNull(), F.col("text")).otherwise(first_words(F.col("text"), F.col(f"{made}n")))
    rows = rows.withColumn("text", text)
    if "n_chars" in names:
        rows = rows.withColumn("n_chars", F.when(F.col(f"{made}n").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return rows.select(*names)


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), k AS (
  SELECT *, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || CAST(size AS VARCHAR)) AS key FROM d
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM k GROUP BY source
), r AS (
  SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT) AS w, 3 * source_size AS cap FROM s
), l AS (
  SELECT *, sum(source_size) OVER () AS total,
    coalesce(sum(cap) OVER (ORDER BY CAST(cap AS DOUBLE) / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS caps_before,
    sum(w) OVER (ORDER BY CAST(cap AS DOUBLE) / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_from
  FROM r
), m AS (
  SELECT *, CAST(cap AS DOUBLE) * w_from <= CAST(w AS DOUBLE) * (total - caps_before) AS capped FROM l
), f AS (
  SELECT *, coalesce(sum(CASE WHEN capped THEN cap END) OVER (), 0) AS all_caps, sum(CASE WHEN NOT capped THEN w END) OVER () AS free_w FROM m
), t AS (
  SELECT source, source_size, CASE WHEN capped THEN CAST(cap AS DOUBLE) ELSE CAST(w * (total - all_caps) AS DOUBLE) / CAST(free_w AS DOUBLE) END AS target FROM f
), b AS (
  SELECT *, CAST(floor(target) AS BIGINT) AS budget, CASE WHEN source_size = 0 THEN 0 ELSE CAST(floor(target) AS BIGINT) // source_size END AS epochs FROM t
), p AS (
  SELECT source, key, sum(size) AS words, count(*) AS n FROM k GROUP BY source, key
), c AS (
  SELECT *, coalesce(sum(words) OVER (PARTITION BY source ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at FROM p
)
SELECT k.doc_id, k.size, b.source_size, b.target,
  CAST(b.epochs * k.size + CASE
    WHEN c.at + c.words <= b.budget - b.epochs * b.source_size THEN k.size
    WHEN c.at <= b.budget - b.epochs * b.source_size THEN (b.budget - b.epochs * b.source_size - c.at) // c.n
    ELSE 0 END AS BIGINT) AS taken
FROM k JOIN b ON k.source IS NOT DISTINCT FROM b.source
JOIN c ON c.source IS NOT DISTINCT FROM k.source AND c.key = k.key
"""
