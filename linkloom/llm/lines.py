"""Operator 7: lines that spread over many sites.

Each line's sites go into a HyperLogLog sketch, merged by aggregation; lines
whose estimate lies near the threshold get an exact distinct count. A line over
the threshold stays in the document of the smallest id and goes from all others.
DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, broadcast_if_small, materialize, read

#: A line is boilerplate from so many distinct sites on, if it has so many words.
MIN_SITES, MIN_WORDS = 5, 3
#: Sketch size as a power of two; its relative error is 1.04 / 2**(LG_K / 2).
LG_K = 8


def trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\n\x0b\x0c\r"))


def line_key(line: Column) -> list[Column]:
    """96 bits that identify a trimmed line."""
    return [F.xxhash64(line).alias("h"), F.hash(line).alias("g")]


def lines_of(docs: DataFrame, site: str, min_words: int) -> DataFrame:
    """doc_id, whole (hash of the text), site and key of every line with words
    enough."""
    line = docs.select("doc_id", F.xxhash64("text").alias("whole"), F.col(site).alias("site"), F.explode(F.split("text", "\n")).alias("line")).withColumn("line", trimmed(F.col("line")))
    return line.where(F.col("line").rlike(r"[\x20\x09-\x0D]+".join([WORD] * max(1, min_words)))).select("doc_id", "whole", "site", *line_key(F.col("line")))


def boilerplate(found: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K) -> DataFrame:
    """h, g, keeper of the lines on min_sites distinct sites or more; keeper is
    the smallest doc_id that has the line. A null site is no site. found: a
    written table of lines_of()."""
    sketch = F.hll_sketch_agg(F.col("site").cast("string"), F.lit(lg_k))
    band = max(1, math.ceil(4 * 1.04 / 2 ** (lg_k / 2) * min_sites))
    counted = found.groupBy("h", "g").agg(F.hll_sketch_estimate(sketch).alias("sites"), F.min("doc_id").alias("keeper"))
    spread = materialize(counted.where(F.col("sites") >= min_sites - band), "spread")
    near = broadcast_if_small(spread.where(F.col("sites") < min_sites + band).select("h", "g"), 24)
    exact = found.join(near, ["h", "g"], "left_semi").groupBy("h", "g").agg(F.countDistinct("site").alias("exact"))
    sure = spread.where(F.col("sites") >= min_sites + band).select("h", "g", "keeper")
    return sure.union(spread.join(exact.where(F.col("exact") >= min_sites), ["h", "g"]).select("h", "g", "keeper"))


def cleaned(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES, min_words: int = MIN_WORDS, made: str = "__line_") -> DataFrame:
    """docs with text cleaned, and columns n_lines and n_removed under `made`."""
    found = materialize(lines_of(docs, site, min_words), "lines")
    lines = materialize(boilerplate(found, min_sites), "boilerplate")
    hits = found.join(broadcast_if_small(lines, 32), ["h", "g"]).where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    # By id and text: rows that share an id, or have none, are dealt by their texts.
    removed = hits.groupBy(F.col("doc_id").alias(f"{made}id"), F.col("whole").alias(f"{made}whole")).agg(F.collect_set(F.struct("h", "g")).alias(f"{made}gone"))
    # Merged at every size: what is removed grows with the corpus.
    same = F.col("doc_id").eqNullSafe(F.col(f"{made}id")) & (F.xxhash64("text") == F.col(f"{made}whole"))
    joined = docs.join(materialize(removed, "removed").hint("merge"), same, "left")
    parts, gone = F.split("text", "\n"), F.col(f"{made}gone")
    stay = F.filter(parts, lambda x: ~F.array_contains(gone, F.struct(*line_key(trimmed(x)))))
    n = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(parts)).cast("long")
    hit = gone.isNotNull() & F.col("text").isNotNull()
    left = joined.withColumn(f"{made}stay", F.when(hit, stay)).withColumn(f"{made}n_lines", n)
    left = left.withColumn(f"{made}n_removed", F.when(hit, n - F.size(f"{made}stay")).otherwise(F.lit(0)).cast("long"))
    return left.withColumn("text", F.when(hit, F.array_join(f"{made}stay", "\n")).otherwise(F.col("text"))).drop(f"{made}id", f"{made}whole", f"{made}gone", f"{made}stay")


def clean(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES, min_words: int = MIN_WORDS) -> DataFrame:
    """Every row of docs (doc_id, text, site column) without boilerplate lines.

    Returns doc_id, n_lines (0 for null text), n_removed, text. Lines are
    compared without white space at their ends; lines of fewer than min_words
    words are left alone.

    Null text stays null; empty text stays. Null site: counts as no site, its
    documents are cleaned all the same. Null doc_id: never the keeper unless all
    of a line's rows have none. Rows of the keeper's id keep the line, and
    repeats within a document. Empty table: empty result.
    """
    docs = docs.select("doc_id", F.col(site).alias("source"), "text")
    return cleaned(docs, "source", min_sites, min_words, "").select("doc_id", "n_lines", "n_removed", "text")


def cleaned_documents(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES, min_words: int = MIN_WORDS) -> DataFrame:
    """The rows of docs with text cleaned, in their own columns; documents of
    which nothing is left go, as copies of what stays elsewhere."""
    names, made = docs.columns, "__line_"
    out = cleaned(docs, site, min_sites, min_words, made)
    out = out.where((F.col(f"{made}n_removed") == 0) | (trimmed(F.col("text")) != ""))
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(F.col(f"{made}n_removed") == 0, F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*names)


def op7_site_spread_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean(read(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, text FROM documents
), l AS (
  SELECT rid, doc_id, source, i, line, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS key
  FROM (SELECT rid, doc_id, source, unnest(range(len(string_split(text, chr(10))))) AS i, unnest(string_split(text, chr(10))) AS line FROM d WHERE text IS NOT NULL)
), spread AS (
  SELECT key, min(doc_id) AS keeper FROM l WHERE len(regexp_extract_all(key, '[^\x20\x09-\x0D]+')) >= 3
  GROUP BY key HAVING count(DISTINCT source) >= 5
), marked AS (
  SELECT l.*, s.key IS NOT NULL AND l.doc_id IS DISTINCT FROM s.keeper AS gone FROM l LEFT JOIN spread s ON l.key = s.key
), t AS (
  SELECT rid, count(*) AS n_lines, sum(CAST(gone AS INTEGER)) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '') AS text FROM marked GROUP BY rid
)
SELECT d.doc_id, CAST(coalesce(t.n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(t.n_removed, 0) AS BIGINT) AS n_removed, t.text FROM d LEFT JOIN t USING (rid)
"""
