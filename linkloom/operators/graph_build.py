"""Graph tables from raw rows: merged windows, degrees, and which selectors are
too common to mean anything."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import host as H
from ..functions.scoring import CONFIG, degree_ceiling


def merge_observations(rows: DataFrame) -> DataFrame:
    """One row per (entity, kind, value, source): windows only widen, nulls have
    no say. rows: those, first_seen, last_seen (ISO texts)."""
    return rows.groupBy("entity", "kind", "value", "source").agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.count(F.lit(1)).alias("n_rows"))


def merge_entities(rows: DataFrame) -> DataFrame:
    """One row per (kind, value); the registrable domain is the first known."""
    return rows.groupBy("kind", "value").agg(F.max("rd").alias("rd"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


def merge_edges(rows: DataFrame) -> DataFrame:
    """One row per (src, dst, kind), with the source of its first sighting."""
    first = F.min_by("source", F.struct("first_seen", "source"))
    return rows.groupBy("src", "dst", "kind").agg(first.alias("source"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


def widened(old: DataFrame, new: DataFrame) -> DataFrame:
    """Stored observations with a batch merged in: the same as merging all."""
    cols = ["entity", "kind", "value", "source", "first_seen", "last_seen"]
    return merge_observations(old.select(cols).unionByName(new.select(cols))).drop("n_rows")


def selector_degrees(observations: DataFrame, selectors: DataFrame | None = None) -> DataFrame:
    """Distinct entities per selector; 0 for listed selectors without any."""
    degrees = observations.select("entity", "kind", "value").distinct().groupBy("kind", "value").agg(F.count("entity").alias("degree"))
    if selectors is None:
        return degrees
    return selectors.select("kind", "value").distinct().join(degrees, ["kind", "value"], "left").fillna(0, ["degree"])


def ip_degrees(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Distinct registrable domains that resolve to each address."""
    owners = entities.where("rd IS NOT NULL").select(F.col("value").alias("src"), "rd")
    return edges.where("kind = 'resolves_to'").join(owners, "src").groupBy(F.col("dst").alias("ip")).agg(F.countDistinct("rd").alias("degree"))


def certificate_owners(sans: DataFrame) -> DataFrame:
    """Distinct owners per certificate: registrable domains, or the name itself
    where there is none. sans: sha256, san."""
    name = H.tls_identity(F.col("san"))
    return sans.groupBy("sha256").agg(F.countDistinct(F.coalesce(H.registrable_domain(name), name)).alias("owners"), F.min(placeholder_name(name).cast("int")).alias("only_placeholders"))


def placeholder_name(name: Column) -> Column:
    return H.low_signal_tls(name) | H.contains_any(name, K.LOW_HOSTING)


def bundled_selectors(sans: DataFrame, ceiling: int = CONFIG.san_owner_ceiling) -> DataFrame:
    """Selectors (kind, value) of certificates with too many owners, or with
    placeholder names alone: the certificate and all its names."""
    bad = certificate_owners(sans).where((F.col("owners") > ceiling) | (F.col("only_placeholders") == 1)).select("sha256")
    names = sans.join(bad, "sha256", "left_semi").select(F.lit("tls_san").alias("kind"), H.tls_identity(F.col("san")).alias("value"))
    return names.unionByName(bad.select(F.lit("tls_cert_sha256").alias("kind"), F.col("sha256").alias("value"))).distinct()


def list_rules(kind: Column, value: Column) -> dict[str, Column]:
    """The denylist rules that look at a selector alone."""
    noise = (*K.CDN_ASNS, *K.HOSTING_ASNS, *K.MAIL_ASNS)
    return {
        "noise_asn": (kind == "asn") & value.isin(*noise),
        "boring_nameserver": (kind == "nameserver") & H.boring_nameserver(value),
        "low_signal_san": (kind == "tls_san") & placeholder_name(H.tls_identity(value)),
    }


def denied(kind: Column, value: Column, degree: Column, bundled: Column, cfg: K.Config = CONFIG) -> Column:
    """Whether a selector never makes a link. One expression, for full builds
    and for single batches."""
    out = (degree > degree_ceiling(kind, value, cfg)) | bundled
    for rule in list_rules(kind, value).values():
        out = out | rule
    return out


def selectors(observations: DataFrame, sans: DataFrame | None = None, cfg: K.Config = CONFIG, only: DataFrame | None = None, owners: DataFrame | None = None, noisy: DataFrame | None = None) -> DataFrame:
    """kind, value, degree, attributing of every selector, or of the touched
    ones (kind, value) alone.

    Addresses (kind `shared_ip`) count registrable domains, which are in a column
    rd or come from owners (value, rd); they attribute unless they are in noisy
    (value) or more domains share them than a pool has."""
    if only is not None:
        observations = observations.join(only, ["kind", "value"], "left_semi")
    degrees = selector_degrees(observations.where("kind <> 'shared_ip'"))
    addresses = None
    if owners is not None or "rd" in observations.columns:
        at = observations.where("kind = 'shared_ip'")
        if "rd" not in observations.columns:
            at = at.join(owners.select(F.col("value").alias("entity"), "rd"), "entity")
        addresses = at.where("rd IS NOT NULL").groupBy("kind", "value").agg(F.countDistinct("rd").alias("degree"))
        marked = F.lit(False)
        if noisy is not None:
            addresses = addresses.join(noisy.select("value").distinct().withColumn("__noisy", F.lit(True)), "value", "left")
            marked = F.coalesce(F.col("__noisy"), F.lit(False))
        addresses = addresses.select("kind", "value", "degree", (~marked & (F.col("degree") <= cfg.ip_noise_degree)).alias("attributing"))
    bundled = F.lit(False)
    if sans is not None:
        marks = bundled_selectors(sans, cfg.san_owner_ceiling).withColumn("bundled", F.lit(True))
        degrees, bundled = degrees.join(marks, ["kind", "value"], "left"), F.coalesce(F.col("bundled"), F.lit(False))
    out = degrees.select("kind", "value", "degree", (~denied(F.col("kind"), F.col("value"), F.col("degree"), bundled, cfg)).alias("attributing"))
    return out if addresses is None else out.unionByName(addresses)


def latest(rows: DataFrame, by: Sequence[str], *order: Column) -> DataFrame:
    """The first row of each group in an order."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("__n = 1").drop("__n")
