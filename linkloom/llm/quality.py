"""Operator 10: quality rules with host-level verdicts.

Each document is measured once; rule failures are summed by host, every host's
failure rates are shrunk towards an empirical beta prior, whose spread is that
of the hosts' rates less what chance alone gives them, and hosts that are surely
worse than the prior by a given factor lose all documents.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, broadcast_if_small, materialize, read, word_count

_WORD = re.compile(WORD)
#: Documents of more words than this count their windows with arrays.
_LONG = 20_000
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
#: A host goes if its shrunk rate of failures, less CERTAINTY standard deviations
#: of its posterior, is above WORSE times the prior's mean, and above LEAST_RATE.
WORSE, LEAST_RATE, CERTAINTY = 3.0, 0.2, 2.0
PRIOR_DOCS = 10


def _covered(starts, size: int = 5) -> int:
    """Positions covered by windows of `size` at ascending starts."""
    n = end = 0
    for i in starts:
        n += i + size - max(end, i)
        end = i + size
    return n


def repeated_words(words: list[str]) -> int:
    """Words in windows of five that the text has twice or more."""
    if len(words) < 6:
        return 0
    if len(words) > _LONG:
        ids: dict[str, int] = {}
        one = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
        rank = one
        for k in range(1, 5):  # exact ranks of windows of k + 1 words
            rank = np.unique(rank[:-1] * len(ids) + one[k:], return_inverse=True)[1].astype(np.int64)
        return _covered(np.flatnonzero(np.bincount(rank)[rank] > 1).tolist())
    windows = list(zip(words, words[1:], words[2:], words[3:], words[4:]))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    return _covered(i for i, w in enumerate(windows) if counts[w] > 1)


def _repeats(text: str) -> F.Column:
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([repeated_words(_WORD.findall(x)) if x else 0 for x in texts], dtype="int64")

    run.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "long")(text)


def measures(text: str) -> dict[str, F.Column]:
    """The measures of a text by name; null counts as empty. Repeated windows
    alone need Python."""
    whole = F.coalesce(F.col(text), F.lit(""))
    without = lambda chars: F.length(F.translate(whole, chars, "")).cast("long")
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(WORD))
    return {
        "n_words": word_count(whole),
        "word_chars": without(" \t\n\x0b\f\r"),
        "n_symbols": F.length(whole).cast("long") - without("#*$%&|<>"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": _repeats(text),
        "n_lines": F.size(lines).cast("long"),
    }


def failures(m: str) -> dict[str, F.Column]:
    """The rules: each true where a document fails it."""
    n, chars, symbols, dups, repeats, lines = (F.col(f"{m}{c}") for c in MEASURES)
    return {"short": n < 10, "repeats": 100 * repeats > 20 * n, "symbols": 10 * symbols > n, "dup_lines": 10 * dups > 3 * lines, "lengths": (chars < 2 * n) | (chars > 12 * n)}


def host_verdicts(measured: DataFrame, host: str, m: str = "", worse: float = WORSE, least: float = LEAST_RATE, certainty: float = CERTAINTY) -> DataFrame:
    """Hosts to reject, from a written table of measured documents: one row each
    (host).

    The prior of a rule is beta(a, b) with the mean of the hosts' rates, hosts
    weighing by their documents, PRIOR_DOCS at most, so that neither the many
    small ones nor a hot one sets it, and with the spread that is left of their
    variance without binomial noise: of a rate p of n documents, E(p - mean)^2 =
    t + (mean (1 - mean) - t) / n, summed by weight and solved for t. Hosts with
    no more spread than chance gives get their common rate. A host's rate is then
    (failed + a) / (all + a + b). A null host is a host of its own."""
    rules = list(failures(m))
    hosts = materialize(measured.groupBy(F.col(host).alias("host")).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c.cast("long")).alias(k) for k, c in failures(m).items()]), "hosts")
    n, w = F.col("n"), F.least("n", F.lit(PRIOR_DOCS))
    sums = hosts.agg(*[F.sum(c).alias(k) for k, c in {"w": w, "ww": w * w, "w_n": w / n, "ww_n": w * w / n}.items()], *[F.sum(w * (F.col(k) / n) ** e).alias(f"{k}{e}") for k in rules for e in (1, 2)]).first()
    bad = F.lit(False)
    for k in rules if sums["w"] else ():
        mean = sums[f"{k}1"] / sums["w"]
        noise = sums["w_n"] - sums["ww_n"] / sums["w"]
        left = sums["w"] - sums["ww"] / sums["w"] - noise
        spread = (sums[f"{k}2"] - sums["w"] * mean * mean - mean * (1 - mean) * noise) / left if left > 1e-9 else 0.0
        weight = min(max(mean * (1 - mean) / spread - 1, 1.0), 1e6) if spread > 0 else 1e6
        rate = (F.col(k) + F.lit(mean * weight)) / (F.col("n") + F.lit(weight))
        bad = bad | (rate - certainty * F.sqrt(rate * (1 - rate) / (F.col("n") + F.lit(weight + 1))) > max(least, worse * mean))
    return hosts.where(bad).select("host")


def judge(docs: DataFrame, host: str = "source", worse: float = WORSE, least: float = LEAST_RATE, certainty: float = CERTAINTY) -> DataFrame:
    """Measures and verdict for each row of docs (doc_id, text, host column).

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_lines, base_failed, host_rejected, kept.

    Null or empty text: all counts 0, base_failed. Null doc_id and repeated rows:
    each row is judged by itself. Null host: one host of its own. Empty table:
    empty result. Other columns are ignored.
    """
    made = "__q_"
    measured = docs.select("doc_id", F.col(host).alias(f"{made}host"), *[c.alias(k) for k, c in measures("text").items()])
    measured = materialize(measured, "quality")
    return _with_verdict(measured, f"{made}host", "", worse, least, certainty).select("doc_id", *MEASURES, "base_failed", "host_rejected", "kept")


def _with_verdict(measured: DataFrame, host: str, m: str, *limits: float) -> DataFrame:
    rules = failures(m)
    rejected = materialize(host_verdicts(measured, host, m, *limits).select(F.col("host").alias(f"{m}__rejected"), F.lit(True).alias(f"{m}host_rejected")), "bad-hosts")
    joined = measured.join(broadcast_if_small(rejected, 256), F.col(host).eqNullSafe(F.col(f"{m}__rejected")), "left").drop(f"{m}__rejected")
    joined = joined.withColumn(f"{m}host_rejected", F.coalesce(F.col(f"{m}host_rejected"), F.lit(False)))
    joined = joined.withColumn(f"{m}base_failed", rules["short"] | rules["repeats"])
    return joined.withColumn(f"{m}kept", ~F.col(f"{m}base_failed") & ~F.col(f"{m}host_rejected"))


def kept_documents(docs: DataFrame, host: str = "source", worse: float = WORSE, least: float = LEAST_RATE, certainty: float = CERTAINTY) -> DataFrame:
    """The rows of docs that judge() keeps, in their own columns."""
    names, made = docs.columns, "__q_"
    measured = docs.select(*names, *[c.alias(f"{made}{k}") for k, c in measures("text").items()])
    measured = materialize(measured, "quality", "zstd")
    return _with_verdict(measured, host, made, worse, least, certainty).where(F.col(f"{made}kept")).select(*names)


def op10_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), dup AS (
  SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid
), grams AS (
  SELECT rid, i, list_slice(w, i, i + 4) AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) > 4)
), twice AS (
  SELECT rid, i FROM grams QUALIFY count(*) OVER (PARTITION BY rid, g) > 1
), rep AS (
  SELECT rid, count(DISTINCT p) AS n_repeat_words FROM (SELECT rid, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY rid
), m AS (
  SELECT rid, doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines
  FROM d LEFT JOIN dup USING (rid) LEFT JOIN rep USING (rid)
), f AS (
  SELECT *, n_words < 10 AS r1, 100 * n_repeat_words > 20 * n_words AS r2, 10 * n_symbols > n_words AS r3, 10 * n_dup_lines > 3 * n_lines AS r4, word_chars < 2 * n_words OR word_chars > 12 * n_words AS r5 FROM m
), h AS (
  SELECT source, rule, count(*) AS n, sum(CAST(failed AS INTEGER)) AS bad FROM (
    SELECT source, unnest([1, 2, 3, 4, 5]) AS rule, unnest([r1, r2, r3, r4, r5]) AS failed FROM f) GROUP BY source, rule
), p AS (
  SELECT rule, sum(w) AS w, sum(w * w) AS ww, sum(w::DOUBLE / n) AS w_n, sum((w * w)::DOUBLE / n) AS ww_n, sum(w * (bad::DOUBLE / n)) AS s1, sum(w * (bad::DOUBLE / n) ^ 2) AS s2 FROM (SELECT *, least(n, 10) AS w FROM h) GROUP BY rule
), q AS (
  SELECT *, s1 / w AS mean, w_n - ww_n / w AS noise FROM p
), t AS (
  SELECT rule, mean, CASE WHEN w - ww::DOUBLE / w - noise > 1e-9 THEN (s2 - w * mean * mean - mean * (1 - mean) * noise) / (w - ww::DOUBLE / w - noise) ELSE 0 END AS spread FROM q
), k AS (
  SELECT rule, mean, CASE WHEN spread > 0 THEN least(greatest(mean * (1 - mean) / spread - 1, 1), 1e6) ELSE 1e6 END AS weight FROM t
), v AS (
  SELECT source, bool_or(rate - 2 * sqrt(rate * (1 - rate) / (n + weight + 1)) > greatest(0.2::DOUBLE, 3 * mean)) AS host_rejected
  FROM (SELECT *, (bad + mean * weight) / (n + weight) AS rate FROM h JOIN k USING (rule)) GROUP BY source
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, r1 OR r2 AS base_failed, host_rejected, NOT (r1 OR r2 OR host_rejected) AS kept
FROM f JOIN v ON f.source IS NOT DISTINCT FROM v.source
"""
