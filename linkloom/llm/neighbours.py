"""Operator 5: nearest neighbours by an inverted multi-index.

Unit vectors are rotated so that both halves hold equal shares of the variance,
cut in two, and the halves quantised apart; a cell is a pair of centroids. A
query visits cells by the sum of its two distances, taken from a heap, until
they hold a tenth of the vectors, and those are reranked by exact cosine on the
original vectors. Equal vectors are indexed once, with their smallest ids, so
copies fill no cell; large cells are split over several shelves.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, read

#: The codebooks are fitted on about so many vectors at most, those of the
#: smallest hashes; every vector is indexed.
SAMPLE = 32_768
#: Centroids of a half: as many as there are vectors, up to this. The fewer
#: vectors to a cell, the nearer the order of visits is to that of distances.
MAX_CENTROIDS = 2048
#: A query looks at this share of all distinct vectors, LEAST at least; 1.0 is
#: an exact search.
SHARE, LEAST = 0.1, 64
#: Vectors to a shelf; neighbouring centroids to a run, which the heap takes up
#: together.
SHELF_ROWS, RUN = 8192, 32


def usable(vector: str) -> F.Column:
    """Not null, finite in all components, and not zero."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & finite & F.exists(v, lambda x: x != 0)


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows at length 1, without overflow on the way."""
    v = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def nearest(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The nearest centroid of each point, a bounded block of points at a time."""
    return np.concatenate([distances(points[at : at + 2048], centroids).argmin(axis=1) for at in range(0, len(points), 2048)]) if len(points) else np.zeros(0, np.int64)


def distances(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (points**2).sum(1)[:, None] - 2 * points @ centroids.T + (centroids**2).sum(1)


def fit(points: np.ndarray, k: int, rounds: int = 5, seed: int = 5) -> np.ndarray:
    """k-means centroids of points, ordered along their widest direction, so
    that neighbours in number are near in space."""
    centroids = points[np.random.default_rng(seed).choice(len(points), k, replace=False)].copy()
    for _ in range(rounds if k < len(points) else 0):
        near = nearest(points, centroids)
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, points)
        n = np.bincount(near, minlength=k)[:, None]
        centroids = np.where(n > 0, sums / np.maximum(n, 1), centroids).astype(points.dtype)
    axis = np.linalg.eigh(np.cov(centroids.T).reshape(centroids.shape[1], -1))[1][:, -1] if k > 1 else np.ones(centroids.shape[1])
    return centroids[np.argsort(centroids @ axis, kind="stable")]


def rotation(units: np.ndarray) -> np.ndarray:
    """Columns: principal axes, dealt so that both halves get equal shares of
    the (log) variance."""
    d = units.shape[1]
    var, axes = np.linalg.eigh(np.cov(units.T) if len(units) > 1 else np.eye(d))
    load, halves, room = [0.0, 0.0], [[], []], [max(1, d // 2), d - max(1, d // 2)]
    log = np.log(np.maximum(var, 1e-12))
    for i in np.argsort(-var, kind="stable"):
        side = min((h for h in (0, 1) if len(halves[h]) < room[h]), key=lambda h: (load[h], h))
        halves[side].append(i)
        load[side] += log[i] - log.min()
    return axes[:, halves[0] + halves[1]]


def traverse(first: np.ndarray, second: np.ndarray, sizes: np.ndarray, wanted: int) -> tuple[np.ndarray, float]:
    """The filled cells (row-major pairs of centroids) with the smallest sums of
    the two distances that hold `wanted` vectors, and the largest of those sums.

    Both lists of centroids are sorted by distance and cut into runs; a heap
    gives the pairs of runs by their smallest sum, so a cell is final once its
    sum is below that of the next pair."""
    one, two, k = np.argsort(first, kind="stable"), np.argsort(second, kind="stable"), len(second)
    a, b = first[one], second[two]
    grid = sizes.reshape(len(first), k)
    heap, taken = [(a[0] + b[0], 0, 0)], []
    seen, check = 0, wanted
    while heap:
        bound, i, j = heapq.heappop(heap)
        if seen >= check:
            sums, held = np.concatenate([t[0] for t in taken]), np.concatenate([t[2] for t in taken])
            if held[sums < bound].sum() >= wanted:
                break
            check = seen + max(1, wanted // 16)
        rows, cols = one[i : i + RUN], two[j : j + RUN]
        held = grid[rows[:, None], cols]
        x, y = np.nonzero(held)
        if len(x):
            n = held[x, y]
            taken.append((a[i + x] + b[j + y], rows[x] * k + cols[y], n))
            seen += int(n.sum())
        if j + RUN < len(b):
            heapq.heappush(heap, (a[i] + b[j + RUN], i, j + RUN))
        if j == 0 and i + RUN < len(a):
            heapq.heappush(heap, (a[i + RUN] + b[0], i + RUN, 0))
    if not taken:
        return np.zeros(0, np.int64), -np.inf
    sums, cells, held = (np.concatenate(x) for x in zip(*taken))
    order = np.argsort(sums, kind="stable")
    last = min(int(np.searchsorted(np.cumsum(held[order]), wanted)), len(order) - 1)
    reach = sums[order[last]]
    return cells[sums <= reach], float(reach)


def matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(np.float64)


class MultiIndex:
    """Rotation, codebooks of both halves, and the filled cells (at most
    MAX_CENTROIDS squared) with their sizes and shelves."""

    def __init__(self, turn: np.ndarray, first: np.ndarray, second: np.ndarray):
        self.turn, self.first, self.second, self.half = turn, first, second, first.shape[1]

    def halves(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        turned = units @ self.turn
        return turned[:, : self.half], turned[:, self.half :]

    def cells(self, units: np.ndarray) -> np.ndarray:
        one, two = self.halves(units)
        return nearest(one, self.first) * len(self.second) + nearest(two, self.second)

    def fill(self, cells: np.ndarray, sizes: np.ndarray) -> None:
        """Take the filled cells' sizes; lay cells out on shelves of SHELF_ROWS."""
        order = np.argsort(cells)
        self.filled, self.counts = cells[order].astype(np.int32), sizes[order].astype(np.int32)
        self.parts = np.maximum(1, -(-self.counts // SHELF_ROWS)).astype(np.int32)
        self.shelf = ((np.cumsum(self.counts, dtype=np.int64) - self.counts) // SHELF_ROWS).astype(np.int32)  # a large cell also takes those after its first

    def sizes(self) -> np.ndarray:
        every = np.zeros(len(self.first) * len(self.second), np.int32)
        every[self.filled] = self.counts
        return every

    def shelves(self, cells: np.ndarray) -> np.ndarray:
        """The shelves that hold any of some filled cells."""
        at = np.searchsorted(self.filled, cells)
        first, parts = self.shelf[at], self.parts[at]
        return np.unique(np.concatenate([first, *[np.arange(f, f + p) for f, p in zip(first[parts > 1], parts[parts > 1])]]))

    def shelf_of(self, cells: np.ndarray, salt: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.filled, cells)
        return self.shelf[at] + salt % self.parts[at]


def build(vectors: DataFrame, dim: int) -> tuple[MultiIndex, DataFrame]:
    """The index of a written table of distinct vectors (vid, embedding), and
    the table with cells."""
    n = vectors.count()
    few = F.xxhash64("vid").bitwiseAND(F.lit(0x3FFFFFFF)) <= int(min(1.0, SAMPLE / max(n, 1)) * 0x3FFFFFFF)
    sample = vectors.where(few).select("vid", "embedding").toPandas().sort_values("vid")["embedding"]
    units = unit(matrix(sample))
    k, half = min(MAX_CENTROIDS, len(units)), max(1, dim // 2)
    turn = rotation(units)
    turned = (units @ turn).astype(np.float32)
    index = MultiIndex(turn, fit(turned[:, :half], k), fit(turned[:, half:], k))

    def place(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if len(part):
                yield part.assign(cell=index.cells(unit(matrix(part["embedding"]))))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in vectors.schema)
    placed = materialize(vectors.mapInPandas(place, f"{schema}, cell long"), "cells")
    sizes = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).toPandas()
    index.fill(sizes["cell"].to_numpy(np.int64), sizes["n"].to_numpy(np.int64))
    return index, placed


def search(vectors: DataFrame, every: int = 50, k: int = 5, share: float = SHARE) -> DataFrame:
    """The k nearest of every vector whose vec_id is divisible by `every`.

    vectors: vec_id, embedding. Returns query_id, rank (from 1), vec_id, score
    (cosine in double precision), the nearest first, ties to the smaller vec_id;
    all candidates if fewer than k. A query's own vec_id is no candidate. share:
    of the distinct vectors, how many a query looks at; at 1.0 the search is
    exact.

    Null, zero and non-finite vectors, null ids, and vectors of another length
    than most take no part. Repeated rows count once. Equal vectors: all found
    with any of them. Empty table: empty result. Other columns are ignored.
    """
    spark = vectors.sparkSession
    valid = vectors.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & usable("embedding"))
    lengths = valid.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if lengths is None or lengths["dim"] < 2:
        return spark.createDataFrame([], schema) if lengths is None else search(vectors.select("vec_id", F.concat("embedding", F.array(F.lit(0.0).cast("float"))).alias("embedding")), every, k, share)
    valid = valid.where(F.size("embedding") == lengths["dim"])

    # Distinct vectors, each with the k + 1 smallest ids that hold it: an answer
    # never needs more of them.
    smallest = F.dense_rank().over(Window.partitionBy("embedding").orderBy("vec_id"))
    ids = valid.withColumn("n", smallest).where(F.col("n") <= k + 1).groupBy("embedding").agg(F.sort_array(F.collect_set("vec_id")).alias("ids"))
    asked = valid.where(F.col("vec_id") % every == 0).distinct()
    distinct = materialize(ids.withColumn("vid", F.element_at("ids", 1)), "vectors")
    index, placed = build(distinct, lengths["dim"])
    asked = materialize(asked.join(distinct.select("embedding", "vid"), "embedding").select("vec_id", "vid"), "queries")
    asking = placed.join(asked.select("vid").distinct(), "vid", "left_semi")
    wanted = int(min(index.counts.sum(), max(LEAST, np.ceil(share * index.counts.sum()))))
    kind = distinct.schema["embedding"].dataType.simpleString()
    row = f"shelf int, vid long, embedding {kind}, ids array<long>, cell long, reach double"

    def probe(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A row for each shelf that a query visits: reach is the sum of its
        furthest cell."""
        sizes = index.sizes()
        for part in parts:
            for at in range(0, len(part), 256):
                some = part.iloc[at : at + 256]
                one, two = index.halves(unit(matrix(some["embedding"])))
                hits, reaches = zip(*[traverse(a, b, sizes, wanted) for a, b in zip(distances(one, index.first), distances(two, index.second))])
                shelves = [index.shelves(cells) for cells in hits]
                out = some.assign(reach=reaches, shelf=shelves)[["shelf", "vid", "embedding", "ids", "cell", "reach"]].explode("shelf")
                out["ids"] = None
                yield out.astype({"shelf": "int32"})

    def lay_out(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield part.assign(shelf=index.shelf_of(part["cell"].to_numpy(), part["vid"].to_numpy() % 1_000_003), reach=None)[["shelf", "vid", "embedding", "ids", "cell", "reach"]]

    def rerank(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Shelves one after another, each followed by its queries in batches:
        a task holds one shelf and one batch."""
        shelf, held, loaded = -1, [], None
        for part in parts:
            out = []
            for number, rows in part.groupby("shelf", sort=True):
                if number != shelf:
                    shelf, held, loaded = number, [], None
                entries, asks = rows[rows["reach"].isna()], rows[rows["reach"].notna()]
                if len(entries):
                    held.append(entries)
                if not len(asks) or not held:
                    continue
                if loaded is None:
                    every_entry = pd.concat(held)
                    cells = every_entry["cell"].to_numpy()
                    own, codes = every_entry["ids"].to_list(), (cells // len(index.second), cells % len(index.second))
                    loaded = unit(matrix(every_entry["embedding"]))
                    smallest_id = np.array([x[0] for x in own])
                for at in range(0, len(asks), 256):
                    some = asks.iloc[at : at + 256]
                    vectors_ = unit(matrix(some["embedding"]))
                    one, two = index.halves(vectors_)
                    one, two = distances(one, index.first), distances(two, index.second)
                    for vid, vector, reach, a, b in zip(some["vid"], vectors_, some["reach"], one, two):
                        near = np.flatnonzero(a[codes[0]] + b[codes[1]] <= reach + 1e-9)
                        scores = loaded[near] @ vector
                        if len(near) > k + 1:
                            top = scores >= np.partition(scores, -(k + 1))[-(k + 1)]
                            near, scores = near[top], scores[top]
                        best = np.lexsort((smallest_id[near], -scores))[: k + 1]
                        out += [(vid, i, float(scores[r])) for r in best for i in own[near[r]]]
            yield pd.DataFrame(out, columns=["vid", "vec_id", "score"]).astype({"vid": "int64", "vec_id": "int64", "score": "float64"})

    entries = placed.select("vid", "embedding", "ids", "cell").mapInPandas(lay_out, row)
    probes = asking.select("vid", "embedding", "ids", "cell").mapInPandas(probe, row)
    shelved = entries.unionByName(probes).repartition("shelf").sortWithinPartitions("shelf", F.col("reach").isNotNull())
    found = shelved.mapInPandas(rerank, "vid long, vec_id long, score double")
    best = Window.partitionBy("vid").orderBy(F.desc("score"), "vec_id")
    top = materialize(found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1).drop("n"), "found")
    answers = asked.select(F.col("vec_id").alias("query_id"), "vid").join(top, "vid").where("vec_id <> query_id")
    ranked = answers.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_multi_index_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read(spark, sf_dir, "embeddings"))
