"""Operator 8: near-duplicate documents by MinHash.

Texts of the same words collapse first. Distinct texts get 128 universal hash
minima, banded 32 by 4. A bucket links its members to its smallest one; links
are confirmed on full shingle sets, and components follow. Buckets that then
still hold several components are searched again: members outside the bucket's
main component are held against the members of others, by signature and then on
full sets, block by block, until the components are linked. Where that would copy
large buckets many times, rounds of further centres, each tried with its whole
bucket, go before it as long as they help. So no pair above the similarity is
left untried, and no group that is linked makes all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, materialize, read
from .components import connected_components
from .kernels import normal_words, shingle_sets, signature, text_key

BANDS, ROWS = 32, 4
SIZE, PERCENT = 5, 75
#: Agreeing minima, of 128, below which a pair of similarity 0.75 falls once in
#: a million: the mean 96 less 4.7 deviations.
LEAST_AGREE = 73
#: Members of a bucket that are compared in one task.
BLOCK = 1024
#: Rows of small buckets that are worked in one call.
SHELF = 4000
#: Copies of a member, on average, above which centres are tried before blocks.
COPIES = 4


def features(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, size: int = SIZE) -> DataFrame:
    """doc_id, raw (hash of the text as it is), key (of its words), n_shingles
    and sig of every row; key and sig are null without words."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            lines = [normal_words(x or b"") for x in part.pop("text")]
            counts, sigs = [], []
            for found in shingle_sets(lines, size):
                counts.append(len(found))
                sigs.append(signature(found, bands * rows) if len(found) else None)
            yield part.assign(key=[text_key(x) if x else None for x in lines], n_shingles=np.array(counts, np.int64), sig=sigs)

    texts = docs.select("doc_id", F.xxhash64("text").alias("raw"), F.col("text").cast("binary").alias("text"))
    return texts.mapInPandas(run, f"doc_id {kind}, raw long, key binary, n_shingles long, sig array<int>")


def candidate_sets(docs: DataFrame, wanted: DataFrame, size: int = SIZE) -> DataFrame:
    """node, shingles (sorted 64-bit hashes) of the wanted (node, rep, raw): the
    text of one row of each."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            lines = [normal_words(x) for x in part.pop("text")]
            yield part.assign(shingles=[x.tobytes() for x in shingle_sets(lines, size)])

    texts = docs.select(F.col("doc_id").alias("rep"), F.xxhash64("text").alias("raw"), F.col("text").cast("binary").alias("text"))
    found = texts.join(wanted, ["rep", "raw"]).select("node", "text")
    return found.mapInPandas(run, "node long, shingles binary").groupBy("node").agg(F.first("shingles").alias("shingles"))


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (u, v) whose full sets are as similar as percent asks."""
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            ok = []
            for a, b in zip(part["a"], part["b"]):
                x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                both = 0
                if percent * max(len(x), len(y)) <= 100 * min(len(x), len(y)):
                    both = len(x) + len(y) - len(np.unique(np.concatenate((x, y))))
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            yield part.loc[ok, ["u", "v"]]

    one = pairs.join(sets.select(F.col("node").alias("u"), F.col("shingles").alias("a")), "u")
    two = one.join(sets.select(F.col("node").alias("v"), F.col("shingles").alias("b")), "v")
    return two.select("u", "v", "a", "b").mapInPandas(run, "u long, v long")


def more_links(members: DataFrame, copied: int, bands: int, rows: int, percent: int = PERCENT, least_agree: int | None = LEAST_AGREE) -> DataFrame:
    """Links (u, v) between different components of a bucket: members outside
    the bucket's main component against all others. Signatures rule most pairs
    out; the rest are counted on the full sets, where they are, until the two
    components are linked. A pair is looked at in the first band that it shares.

    members: bucket, band, node, lab, main (label), blocks, block, ask_blocks,
    sig, shingles. copied: the rows that they make here. least_agree: of 128
    minima, how many must agree for a pair to be counted; None counts all pairs.
    """
    least = (least_agree or 0) * bands * rows // (BANDS * ROWS)

    def bucket_links(band: int, asks: pd.DataFrame, gives: pd.DataFrame, out: list[tuple[int, int]]) -> None:
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root.get(x, x) != x:
                x = root[x]
            return x

        sigs = np.stack(gives["sig"].to_numpy())
        nodes, labs = gives["node"].tolist(), gives["lab"].tolist()
        sets = [np.frombuffer(x, np.uint64) for x in gives["shingles"]]
        sizes = np.array([len(x) for x in sets])
        for node, lab, sig, raw in zip(asks["node"], asks["lab"], asks["sig"], asks["shingles"]):
            equal = sigs == np.asarray(sig, np.int32)
            near = np.flatnonzero(equal.sum(axis=1) >= least)
            if not len(near):
                continue
            near = near[equal[near].reshape(len(near), bands, rows).all(axis=2).argmax(axis=1) == band]
            mine, own = np.frombuffer(raw, np.uint64), find(lab)
            for k in near[np.argsort(-equal[near].sum(axis=1), kind="stable")].tolist():
                if find(labs[k]) == own:
                    continue
                n = len(mine) + int(sizes[k])
                if 100 * min(len(mine), int(sizes[k])) < percent * max(len(mine), int(sizes[k])):
                    continue
                at = np.minimum(np.searchsorted(sets[k], mine), sizes[k] - 1)
                both = int((sets[k][at] == mine).sum())
                if 100 * both >= percent * (n - both):
                    out.append((node, nodes[k]))
                    root[own] = find(labs[k])
                    own = find(lab)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int]] = []
        for _, one in part.groupby(["bucket", "i", "j"], sort=False):
            asks = one["asks"].to_numpy()
            if asks.any() and not asks.all():
                bucket_links(int(one["band"].iat[0]), one[asks], one[~asks], out)
        return pd.DataFrame(out, columns=["u", "v"], dtype="int64")

    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    cols = ["bucket", "band", "node", "lab", "sig", "shingles"]
    # Asking members have blocks of their own, so that a few of them copy the others once.
    asks = members.where(F.col("lab") != F.col("main")).select(*cols, F.lit(True).alias("asks"), F.pmod(F.xxhash64("node"), F.col("ask_blocks")).cast("int").alias("i"), every("blocks").alias("j"))
    gives = members.select(*cols, F.lit(False).alias("asks"), every("ask_blocks").alias("i"), F.col("block").alias("j"))
    shelves = max(1, copied // SHELF)  # several small buckets to a call
    pairs = asks.union(gives).withColumn("shelf", F.pmod(F.xxhash64("bucket", "i", "j"), F.lit(shelves))).groupBy("shelf").applyInPandas(run, "u long, v long")
    return pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def open_buckets(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of the buckets of more than two (one pair has been tried) that
    hold more than one component."""
    named = buckets.join(labels, "node", "left").select("bucket", "band", "node", F.coalesce("component", "node").alias("lab"))
    sizes = named.groupBy("bucket", "lab").agg(F.count(F.lit(1)).alias("n"))
    mixed = sizes.groupBy("bucket").agg(F.count(F.lit(1)).alias("labs"), F.sum("n").alias("n"), F.max("n").alias("n_main"), F.max_by("lab", F.struct("n", "lab")).alias("main")).where("labs > 1 AND n > 2")
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    members = named.join(mixed.select("bucket", "main", blocks(F.col("n")).alias("blocks"), blocks(F.col("n") - F.col("n_main")).alias("ask_blocks")), "bucket")
    return members.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))


def spread(members: DataFrame) -> tuple[int, int]:
    """Members of open buckets, and the rows that more_links() makes of them."""
    n, copied = members.agg(F.count(F.lit(1)), F.sum(F.col("ask_blocks") + F.when(F.col("lab") != F.col("main"), F.col("blocks")).otherwise(0))).first()
    return n, copied or 0


def star_pairs(members: DataFrame, turn: int) -> DataFrame:
    """Pairs (u, v) of two centres of each open bucket, one of its main component
    and one of the others, with the members of all other components: at most two
    pairs a member. Each turn takes other centres."""
    by = F.struct(F.xxhash64("node", F.lit(turn)), "node", "lab")
    outside = F.col("lab") != F.col("main")
    centres = members.groupBy("bucket").agg(F.array(F.min(F.when(~outside, by)), F.min(F.when(outside, by))).alias("c")).select("bucket", F.explode("c").alias("c"))
    centres = centres.select("bucket", F.col("c.node").alias("centre"), F.col("c.lab").alias("own"))
    pairs = members.join(centres, "bucket").where(F.col("lab") != F.col("own"))
    return pairs.select(F.greatest("node", "centre").alias("u"), F.least("node", "centre").alias("v")).distinct()


def components_of(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, size: int = SIZE, percent: int = PERCENT, least_agree: int | None = LEAST_AGREE) -> tuple[DataFrame, DataFrame]:
    """Two written tables: the features of every row, and (key, component_id)
    of every class of texts with the same words."""
    feats = materialize(features(docs, bands, rows, size), "features")
    found = feats.where(F.col("key").isNotNull() & F.col("doc_id").isNotNull())
    classes = found.groupBy("key").agg(F.min(F.struct("doc_id", "raw")).alias("first"), F.first("sig").alias("sig"))
    classes = materialize(classes.select("key", F.col("first.doc_id").alias("rep"), F.col("first.raw").alias("raw"), "sig", F.monotonically_increasing_id().alias("node")), "classes")  # written, so nodes are fixed and no two are the same
    band = F.posexplode(F.array(*[F.xxhash64(F.lit(i), *[F.element_at("sig", i * rows + k + 1) for k in range(rows)]) for i in range(bands)]))
    banded = classes.select("node", band.alias("band", "bucket"))
    shared = banded.groupBy("bucket").agg(F.min("node").alias("pivot"), F.max("node").alias("top")).where("pivot < top").select("bucket", "pivot")
    buckets = materialize(banded.join(shared, "bucket"), "buckets")

    pairs = buckets.where("node <> pivot").select(F.col("node").alias("u"), F.col("pivot").alias("v")).distinct()
    wanted = classes.select("node", "rep", "raw").join(buckets.select("node").distinct(), "node", "left_semi")
    sets = materialize(candidate_sets(docs, wanted, size), "sets")
    links = materialize(confirmed(pairs, sets, percent), "links")
    labels = connected_components(links)
    members = materialize(open_buckets(buckets, labels), "open")
    (n, copied), last, turn = spread(members), None, 0
    while copied > COPIES * n and (last is None or copied < 0.75 * last):
        more = materialize(confirmed(star_pairs(members, turn), sets, percent), "links")
        if more.isEmpty():
            break
        links = links.union(more)
        labels = connected_components(links)
        members = materialize(open_buckets(buckets, labels), "open")
        last, turn = copied, turn + 1
        n, copied = spread(members)
    if n:
        members = members.join(classes.select("node", "sig"), "node").join(sets, "node")
        more = materialize(more_links(members, copied, bands, rows, percent, least_agree), "links")
        if not more.isEmpty():
            links = links.union(more)
            labels = connected_components(links)
    labels = materialize(labels, "labels")
    placed = classes.join(labels, "node", "left").select("key", "rep", F.coalesce("component", "node").alias("component"))
    least = placed.groupBy("component").agg(F.min("rep").alias("component_id"))
    return feats, materialize(placed.join(least, "component").select("key", "component_id"), "components")


def link(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, size: int = SIZE, percent: int = PERCENT, least_agree: int | None = LEAST_AGREE) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs. More bands
    of fewer rows, and least_agree=None, leave less to chance.

    A document's set is its distinct shingles of `size` words, A-Z lower-cased;
    documents are linked where 100 * intersection >= percent * union, and
    component_id is the smallest doc_id that links reach.

    Null, empty or blank text: no shingles, its own component. Fewer words than
    a shingle: the words are one. Null doc_id: takes no part, component null,
    kept. Rows that repeat a doc_id are documents of their own, by their texts.
    Empty table: empty result. Other columns are ignored.
    """
    feats, placed = components_of(docs, bands, rows, size, percent, least_agree)
    rows_out = feats.join(placed, "key", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
    return rows_out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def kept_documents(docs: DataFrame) -> DataFrame:
    """One row of docs for each group of near copies, that of the smallest
    doc_id, in the columns of docs. Rows without a doc_id or words stay."""
    feats, placed = components_of(docs)
    kept = feats.join(placed, "key").where("doc_id = component_id").groupBy("doc_id", "key").agg(F.min("raw").alias("raw"))
    kept = materialize(kept.select(F.col("doc_id").alias("__near_id"), F.col("raw").alias("__near_raw")).distinct(), "kept")
    keyed = docs.withColumn("__near_text", F.xxhash64("text"))
    alone = F.col("doc_id").isNull() | ~F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    one = keyed.where(~alone).join(kept, (F.col("doc_id") == F.col("__near_id")) & (F.col("__near_text") == F.col("__near_raw")), "left_semi")
    return one.dropDuplicates(["doc_id", "__near_text"]).unionByName(keyed.where(alone)).drop("__near_text")


def op8_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(read(spark, sf_dir, "documents"))
