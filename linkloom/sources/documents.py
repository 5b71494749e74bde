"""Scan documents as rows, and idempotent sinks for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def from_fields(fields: DataFrame) -> DataFrame:
    """run, json: documents put together from rows of one field each (run, key,
    value as JSON text); of a key given twice the last (by seq) counts."""
    last = fields.groupBy("run", "key").agg(F.max_by("value", "seq").alias("value"))
    member = F.concat(F.to_json(F.struct(F.col("key").alias("k"))).substr(F.lit(6), F.length(F.to_json(F.struct(F.col("key").alias("k")))) - 6), F.lit(":"), F.coalesce("value", F.lit("null")))
    members = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("key", member.alias("m")))), lambda x: x["m"]), ",")
    return last.groupBy("run").agg(F.concat(F.lit("{"), members, F.lit("}")).alias("json"))


def hydrated(documents: DataFrame, headers: DataFrame) -> DataFrame:
    """Documents (run, json) with input, type and timestamp, from the header
    (run, input, type, timestamp) where the document lacks them."""
    get = lambda k: F.coalesce(F.get_json_object("json", f"$.{k}"), F.col(f"h_{k}"))
    heads = headers.select("run", *[F.col(k).alias(f"h_{k}") for k in ("input", "type", "timestamp")])
    return documents.join(heads, "run", "left").select("run", "json", *[get(k).alias(k) for k in ("input", "type", "timestamp")])


def read_directory(spark: SparkSession, path: str) -> DataFrame:
    """run (the file's name), json: a folder of documents, one to a file."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("json"))
    return files.select(F.regexp_extract("file", r"([^/]+?)(?:\.json)?$", 1).alias("run"), "json")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows of both, one for each key, the last by `order`."""
    by = Window.partitionBy(*keys).orderBy(F.desc(order))
    return old.unionByName(new).withColumn("__n", F.row_number().over(by)).where("__n = 1").drop("__n")


def merged_payload(old: Column, new: Column) -> Column:
    """Two maps as one; the new value of a key counts."""
    return F.map_concat(F.map_filter(old, lambda k, v: ~F.array_contains(F.map_keys(new), k)), new)


def replace_runs(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Stored facts with those of the fresh runs in place of theirs."""
    return stored.join(fresh.select("run").distinct(), "run", "left_anti").unionByName(fresh)


def append_once(stored: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows, and new ones whose keys are not there yet."""
    return stored.unionByName(rows.dropDuplicates(keys).join(stored.select(*keys), keys, "left_anti"))


# ---- exports ----


def write_pairs(pairs: DataFrame, path: str) -> None:
    """Pairs as JSON lines, partitioned by strength, and their summary."""
    pairs.write.mode("overwrite").partitionBy("strength").json(f"{path}/pairs")
    pairs.groupBy("strength").agg(F.count(F.lit(1)).alias("pairs"), F.max("score").alias("max_score")).write.mode("overwrite").json(f"{path}/summary")


def graph_elements(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """GEXF 1.2 elements, a line each, as a text column: nodes (node, kind) and
    edges (a, b, score); edge width grows with the score, from 1 to 8."""
    esc = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    width = F.least(F.lit(8), F.greatest(F.lit(1), F.floor(F.col("score") / 30)))
    one = nodes.select(F.format_string('<node id="%s" label="%s" kind="%s"/>', esc(F.col("node")), esc(F.col("node")), F.col("kind")).alias("value"))
    two = edges.select(F.format_string('<edge id="%s--%s" source="%s" target="%s" weight="%d"/>', esc(F.col("a")), esc(F.col("b")), esc(F.col("a")), esc(F.col("b")), width).alias("value"))
    return one.unionByName(two)
