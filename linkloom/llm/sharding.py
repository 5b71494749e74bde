"""Operator 4: weighted rendezvous hashing. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, read

#: Rows that one key range of a shard should hold while slots are numbered.
RANGE_ROWS = 100_000


def _unit(text: Column) -> Column:
    """A number in (0, 1) from the first 52 bits of a hash."""
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(2**52))


def rendezvous(key: Column, weights: Sequence[float], seed: str = "shard") -> Column:
    """The shard of a key: each shard draws a number from key and shard alone,
    scored weight / -ln(draw), and the highest score wins. A new shard takes
    only keys that it wins itself; all others stay where they are. A null key
    is keyed as the word "null". Shards of weight 0 get nothing."""
    scores = [
        F.struct((F.lit(float(w)) / -F.log(_unit(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null")), F.lit(f":{i}"))))).alias("score"), F.lit(-i).alias("n"))
        for i, w in enumerate(weights)
        if w > 0
    ]
    return (-F.greatest(*scores)["n"]).cast("int") if len(scores) > 1 else (-scores[0]["n"]).cast("int")


def numbered(df: DataFrame, group: str, order: Sequence[str], name: str) -> DataFrame:
    """df with gapless numbers from 0 within each group, by `order`. Rows are
    dealt to ranges of the whole order, which are counted and prefix-summed, so
    no task sorts a whole group, nor all rows of one key. df: a written table; the
    last column of order should differ from row to row."""
    ranges = max(1, -(-df.count() // RANGE_ROWS))
    ranged = materialize(df.repartitionByRange(ranges, group, *order).withColumn("__range", F.spark_partition_id()), "ranges")
    before = Window.partitionBy(group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy(group, "__range").agg(F.count(F.lit(1)).alias("__n")).withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    inside = Window.partitionBy(group, "__range").orderBy(*order)
    return ranged.join(starts, [group, "__range"]).withColumn(name, (F.col("__start") + F.row_number().over(inside) - 1).cast("long")).drop("__range", "__start")


def shard(docs: DataFrame, weights: Sequence[float], grown: Sequence[float] | None = None, seed: str = "shard") -> DataFrame:
    """Shards of the rows of docs (doc_id, text) by doc_id alone.

    Returns doc_id, size (UTF-8 bytes of the text plus 8), text_crc32, law,
    shard, slot (gapless from 0 within the shard) and grown_shard: the shard
    once the shards are those of `grown` (the old ones and more).

    Null text: no bytes, checksum 0. Null doc_id: all such rows share a shard.
    Repeated ids share a shard and get slots of their own, by size and checksum.
    Empty table: empty result. Other columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    grown = list(grown if grown is not None else [*weights, weights[-1]])
    keyed = docs.select(
        "doc_id", (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(text).alias("text_crc32"), F.lit("key").alias("law"), rendezvous(F.col("doc_id"), weights, seed).alias("shard"),
        rendezvous(F.col("doc_id"), grown, seed).alias("grown_shard"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).alias("__key"), F.monotonically_increasing_id().alias("__row"),
    )
    slots = numbered(materialize(keyed, "shards"), "shard", ["__key", "doc_id", "size", "text_crc32", "__row"], "slot")
    return slots.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op4_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(read(spark, sf_dir, "documents"), [1.0] * 24)


OP4_SQL = r"""
WITH tab AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM (SELECT CAST(range AS BIGINT) AS i FROM range(256)))
), d AS (
  SELECT doc_id, coalesce(text, '') AS text, strlen(coalesce(text, '')) + 8 AS size, coalesce(CAST(doc_id AS VARCHAR), 'null') AS k FROM documents
), draws AS (
  SELECT k, s, 1.0::DOUBLE / -ln((('0x' || substr(md5('shard:' || k || ':' || s), 1, 13))::BIGINT::DOUBLE + 0.5::DOUBLE) / 4503599627370496::DOUBLE) AS score
  FROM (SELECT DISTINCT k FROM d), (SELECT range AS s FROM range(25))
), placed AS (
  SELECT k, CAST(arg_max(s, score) FILTER (WHERE s < 24) AS INTEGER) AS shard, CAST(arg_max(s, score) AS INTEGER) AS grown_shard FROM draws GROUP BY k
), sums AS (
  SELECT text, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, strlen(text)), lambda i: ('0x' || substr(hex(encode(text)), 2 * i + 1, 2))::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) AS text_crc32
  FROM (SELECT DISTINCT text FROM d), tab
)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'key' AS law, shard,
  CAST(row_number() OVER (PARTITION BY shard ORDER BY md5(k), doc_id, size, text_crc32) - 1 AS BIGINT) AS slot, grown_shard
FROM d JOIN placed USING (k) JOIN sums USING (text)
"""
