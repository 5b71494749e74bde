"""Target lists and feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import host as H
from ..storage import small, written

#: Social and sharing sites: never a target by themselves.
SOCIAL = ("facebook.com", "instagram.com", "linkedin.com", "odysee.com", "ok.ru", "reddit.com", "rumble.com", "t.me", "telegram.me", "telegram.org", "threads.net", "tiktok.com", "twitter.com", "vk.com", "x.com", "youtube.com", "youtu.be")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """row, target: the first column of CSV files, cleaned, without blanks and
    byte order marks. Rows are numbered in file order."""
    raw = spark.read.csv(path, header=False).select(F.monotonically_increasing_id().alias("row"), F.regexp_replace("_c0", "^﻿", "").alias("raw"))
    return raw.select("row", H.clean_target(F.col("raw")).alias("target")).where("target IS NOT NULL AND target <> ''")


def first_seen(targets: DataFrame) -> DataFrame:
    """Targets once each, where they come first. targets: row, target."""
    return targets.groupBy("target").agg(F.min("row").alias("row"))


def normalized(targets: DataFrame) -> DataFrame:
    """upload_row (from 1), target, target_type of a list (row, target), each
    target once, at its first row; what is neither host nor address goes."""
    host = H.host_of(F.col("target"))
    rows = targets.select("row", host.alias("target"), H.target_kind(host).alias("target_type")).where("target_type IS NOT NULL")
    once = rows.groupBy("target", "target_type").agg(F.min("row").alias("row"))
    # Numbers follow from counts per range of rows, not from one sorted task.
    ranged = once.withColumn("range", F.floor(F.col("row") / 100_000))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("range").agg(F.count(F.lit(1)).alias("n")).withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inside = Window.partitionBy("range").orderBy("row", "target")
    return ranged.join(starts, "range").select((F.col("start") + F.row_number().over(inside)).alias("upload_row"), "target", "target_type")


def batches(targets: DataFrame, known: DataFrame, tiers: DataFrame, size: int = 250) -> DataFrame:
    """New targets in batches, those with a tier first; size 0 makes one batch.
    targets: target, labels; known: target; tiers: target, tier."""
    new = targets.join(known.select("target").distinct(), "target", "left_anti").join(small(tiers), "target", "left")
    if not size:
        return new.withColumn("batch", F.lit(0))
    # Numbers follow from counts per range of the order, not from one sorted task.
    order = [F.col("tier").asc_nulls_last(), F.col("target")]
    ranged = written(new.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "targets")
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = ranged.groupBy("__range").agg(F.count(F.lit(1)).alias("__n")).withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    n = F.col("__start") + F.row_number().over(Window.partitionBy("__range").orderBy(*order)) - 1
    return ranged.join(starts, "__range").withColumn("batch", F.floor(n / size).cast("int")).drop("__range", "__start")


def channel_domains(channels: DataFrame) -> DataFrame:
    """Domains of website channels, with all their labels and lowest tier.

    channels: id, types (array), name, aliases (array), refs (array of URLs),
    labels (array)."""
    website = F.exists(F.coalesce("types", F.array().cast("array<string>")), lambda t: F.lower(t).contains("website"))
    names = F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")), F.coalesce("refs", F.array().cast("array<string>")))
    rows = channels.where(website).select("labels", F.explode(names).alias("n")).select("labels", H.host_of(F.col("n")).alias("domain"))
    good = rows.where((H.target_kind(F.col("domain")) == "domain") & ~H.under_any(F.col("domain"), SOCIAL))
    merged = good.groupBy("domain").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("labels", F.array().cast("array<string>")))))).alias("labels"))
    return merged.withColumn("tier", H.tier_from_labels(F.col("labels")))
