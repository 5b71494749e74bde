"""Connected components by alternating large-star and small-star.

Edges live in tables all the way; each round is two group-bys and two joins, and
is written out, so that a lost executor costs one round at most. The number of
rounds is logarithmic in practice. No node's neighbours are gathered in one
place: a star's centre is found by a minimum, which combines before the shuffle,
and joined back, which Spark can split where one node has very many edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, new_path, remove


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One half-round over edges (u, v) with u > v."""
    if large:
        near = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges
    centres = near.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("m"))
    joined = near.join(centres, "u")
    if large:  # larger neighbours move to the smallest node around
        return joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    moved = joined.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(centres.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (u, v); a component is named by
    its smallest node. Edges may repeat, point either way or be loops; null ends
    are no edges. No edges: an empty table."""
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    spark, path, last = edges.sparkSession, new_path(edges.sparkSession, "edges"), None
    edges = materialize(edges, "edges", path=path)
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last or now[0] == 0:
            break
        last, old, path = now, path, new_path(spark, "edges")
        edges = materialize(_stars(_stars(edges, True), False), "edges", path=path)
        remove(spark, old)
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(edges.select("v", "v").distinct())
