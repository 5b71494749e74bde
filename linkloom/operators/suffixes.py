"""Registrable domains by a table of public suffix rules.

Rules are data: plain suffixes, wildcards (`*.x`) and exceptions (`!y.x`), with
those of private registries marked. A host is opened into its suffixes, which are
joined with the rules; of what matches, an exception wins, then the longest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import host as H
from ..storage import small

#: Labels of a host that are looked at, from its end; rules are shorter by far.
MOST_LABELS = 12


def parsed_rules(lines: DataFrame) -> DataFrame:
    """suffix, rule (plain, wildcard, exception), private of the lines (value) of
    a rule file, with its order (line). Comments (//) and what follows a blank on
    a line have no say; private rules stand between the marks that hold the words
    BEGIN PRIVATE and END PRIVATE. Repeated rules count once, as public if any is."""
    marked = F.when(F.col("value").rlike("^// *=+BEGIN PRIVATE"), 1).when(F.col("value").rlike("^// *=+END PRIVATE"), 0)
    # One short file: a window over all of it is meant.
    section = lines.withColumn("private", F.coalesce(F.last(marked, True).over(Window.partitionBy(F.lit(0)).orderBy("line")), F.lit(0)) == 1)
    text = F.lower(F.regexp_extract(F.trim("value"), r"^(\S+)", 1))
    rules = section.where(~F.col("value").rlike(r"^\s*(//|$)")).withColumn("text", text)
    kind = F.when(F.col("text").startswith("!"), "exception").when(F.col("text").startswith("*."), "wildcard").otherwise("plain")
    return rules.select(F.regexp_replace("text", r"^(!|\*\.|\.)", "").alias("suffix"), kind.alias("rule"), "private").groupBy("suffix", "rule").agg(F.min("private").alias("private"))


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rules of a file in the usual format."""
    lines = spark.read.option("lineSep", "\n").text(path).coalesce(1)
    return parsed_rules(lines.withColumn("line", F.monotonically_increasing_id()))


def suffix_lengths(hosts: DataFrame, rules: DataFrame, private: bool = True) -> DataFrame:
    """host, n: labels of the public suffix of each distinct host (host). Where no
    rule matches it is the last label."""
    labels = F.split("host", r"\.")
    size = F.least(F.size(labels), F.lit(MOST_LABELS))
    opened = hosts.select("host").distinct().select("host", F.size(labels).alias("size"), F.explode(F.sequence(F.lit(1), size)).alias("n"), labels.alias("labels"))
    suffix = F.array_join(F.slice("labels", F.col("size") - F.col("n") + 1, F.col("n")), ".")
    kept = rules if private else rules.where("NOT private")
    found = opened.select("host", "size", "n", suffix.alias("suffix")).join(small(kept.select("suffix", "rule")), "suffix")
    # An exception counts above every length; it takes one label less.
    weight = F.when(F.col("rule") == "exception", 1000 + F.col("n") - 1).when(F.col("rule") == "plain", F.col("n")).when(F.col("size") > F.col("n"), F.col("n") + 1)
    best = found.groupBy("host").agg(F.max(weight).alias("best"))
    joined = hosts.select("host").distinct().join(best, "host", "left")
    return joined.select("host", F.coalesce(F.pmod("best", F.lit(1000)), F.lit(1)).alias("n"))


def registrable(rows: DataFrame, column: str, rules: DataFrame, name: str = "rd", private: bool = True, apexes: Sequence[str] = ()) -> DataFrame:
    """rows with the registrable domain of a column of hosts: the public suffix
    and the label before it. Null for addresses, suffixes themselves, hosts with
    empty labels and null. apexes: suffixes that count as one domain with all below.

    Each distinct host is looked up once, whatever the number of its rows."""
    host = F.regexp_replace(F.lower(F.trim(column)), r"^(\*\.)|\.$", "")
    keyed = rows.withColumn("__host", host)
    fit = keyed.where(~H.is_ip(F.col("__host")) & F.col("__host").rlike(r"^[^.\s]+(\.[^.\s]+)+$")).select(F.col("__host").alias("host"))
    found = suffix_lengths(fit, rules, private)
    labels = F.split("host", r"\.")
    take = lambda n: F.array_join(F.slice(labels, F.size(labels) - n + 1, n), ".")
    rd = F.when(F.size(labels) > F.col("n"), take(F.col("n") + 1))
    if apexes:
        suffix = take(F.col("n"))
        rd = F.when(suffix.isin(*apexes), suffix).otherwise(rd)
    known = found.select(F.col("host").alias("__host"), rd.alias(name))
    return keyed.join(known, "__host", "left").drop("__host")


def reentered(entities: DataFrame, rules: DataFrame, private: bool = True, apexes: Sequence[str] = ()) -> DataFrame:
    """Entities (kind, value, rd, …) with domains and kinds by the rules: an apex
    is a domain, what lies below one a subdomain; others stay as they are."""
    named = registrable(entities.drop("rd"), "value", rules, "rd", private, apexes)
    host = F.col("kind").isin("domain", "subdomain")
    kind: Column = F.when(host & (F.col("rd") == F.col("value")), "domain").when(host, "subdomain").otherwise(F.col("kind"))
    return named.withColumn("kind", kind).select(entities.columns)
