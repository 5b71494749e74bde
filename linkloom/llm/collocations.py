"""Operator 12: phrase collocations by hierarchical pair naming.

Texts are read once and laid out as blocks of word numbers. Level by level, each
block lists its distinct pairs of adjacent frequent (k-1)-grams with their counts;
the pairs of all blocks meet by a hash, are counted, and those that are frequent
get an id, which goes back to the blocks that asked and stands for the k-gram
there. An id's row keeps the ids of both parents (the k-gram without its last and
without its first word), through which cuts and longer phrases are found.

What is shuffled are a block's distinct pairs, packed into arrays by hash range;
texts and positions never are. A block and a hash range are of bounded size, and
a pair has one entry for each block, however common it is.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, new_path, read, remove

#: Phrases of 2 to LONGEST words, found LEAST times or more.
LONGEST, LEAST = 4, 30
#: A phrase goes if a longer one that holds it is found PERCENT % as often.
PERCENT = 80
#: Phrases reported for each language.
TOP = 2000
#: A score of 1 is this many.
UNIT = 2_000_000
#: Tokens in a block; bytes of text for each hash range.
BLOCK, RANGE_BYTES = 1 << 21, 8 << 20
#: Groups of more rows than this are cut before they are ranked.
RANKED = 200_000

_END = b"\xff"  # of a piece; no byte of UTF-8
_LETTERS = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz" + _END * 10)

_LAID = "block long, lang string, n_words long, held binary, seq binary, range int, words binary, counts binary, idx binary"
_PAIRS = "block long, lang string, held binary, seq binary, range int, first long, lefts binary, rights binary, counts binary"
_NAMES = "lang string, id long, word string, `left` long, `right` long, a long, block long, idx binary, ids binary"


def tokens_of(text: str | None) -> list[bytes]:
    """Words with A-Z in lower case, and _END where a piece ends."""
    return (text or "").encode().translate(_LETTERS).replace(_END, b" \xff ").split()


def squeezed(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unsqueezed(data: bytes) -> bytes:
    return pa.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)


def packed(values: np.ndarray) -> bytes:
    """Numbers of 0 and more, byte by byte of their weight, in as few bytes as
    the largest needs."""
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    return bytes([width]) + squeezed(values.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes())


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(unsqueezed(data[1:]), np.uint8).reshape(data[0], -1)
    values = np.zeros((planes.shape[1], 8), np.uint8)
    values[:, : data[0]] = planes.T
    return values.view("<i8").reshape(-1)


def rising(values: np.ndarray) -> bytes:
    """Numbers of 0 and more that never fall, packed as their steps."""
    return packed(np.diff(values, prepend=0))


def risen(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data))


def sequence_of(seq: np.ndarray) -> tuple[bytes, bytes]:
    """Which places of a sequence hold a number (others are -1), and the numbers."""
    return len(seq).to_bytes(8, "little") + squeezed(np.packbits(seq >= 0).tobytes()), packed(seq[seq >= 0])


def sequence_from(held: bytes, numbers: bytes) -> np.ndarray:
    n = int.from_bytes(held[:8], "little")
    seq = np.full(n, -1, np.int64)
    seq[np.unpackbits(np.frombuffer(unsqueezed(held[8:]), np.uint8), count=n).astype(bool)] = unpacked(numbers)
    return seq


def _table(rows: list[tuple], schema: list[tuple[str, pa.DataType]]) -> pa.Table:
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.table([pa.array(c, t) for c, (_, t) in zip(columns, schema)], names=[n for n, _ in schema])


def _schema(ddl: str) -> list[tuple[str, pa.DataType]]:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    return [(n.strip("`"), kinds[t]) for n, t in (x.split() for x in ddl.split(", "))]


def laid_out(docs: DataFrame, ranges: int, block: int = BLOCK) -> DataFrame:
    """Blocks of docs (text, lang): a row with the numbers of a block's words
    (none where a piece ends), and for each hash range a row with the distinct
    words that fall there, their counts and numbers. Common words have small
    numbers."""
    schema = _schema(_LAID)

    def flush(number: int, lang: str, vocabulary: dict[bytes, int], parts: list[np.ndarray]) -> pa.RecordBatch:
        seq, words = np.concatenate(parts), list(vocabulary)
        counts = np.bincount(seq, minlength=len(words))
        counts[vocabulary[_END]] = 0
        order = np.argsort(-counts, kind="stable")  # the end mark comes last
        renamed = np.empty(len(words), np.int64)
        renamed[order] = np.arange(len(words))
        renamed[vocabulary[_END]] = -1
        rows = [(number, lang, int(counts.sum()), *sequence_of(renamed[seq]), None, None, None, None)]
        order = order[: len(words) - 1]
        ranged = np.fromiter((zlib.crc32(words[i]) % ranges for i in order), np.int64, len(order))
        at = np.argsort(ranged, kind="stable")
        for idx in np.split(at, np.flatnonzero(np.diff(ranged[at])) + 1) if len(at) else ():
            rows.append((number, lang, 0, None, None, int(ranged[idx[0]]), squeezed(_END.join(words[i] for i in order[idx])), packed(counts[order[idx]]), rising(idx)))
        return _table(rows, schema).combine_chunks().to_batches()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        words: dict[str, defaultdict] = {}
        parts: dict[str, list[np.ndarray]] = defaultdict(list)
        held: dict[str, int] = defaultdict(int)
        for batch in batches:
            for text, lang in zip(batch.column("text"), batch.column("lang").to_pylist()):
                found = tokens_of(text.as_py())
                if not found:
                    continue
                if lang not in words:
                    words[lang] = defaultdict()
                    words[lang].default_factory = words[lang].__len__
                found.append(_END)
                parts[lang].append(np.fromiter(map(words[lang].__getitem__, found), np.int32, len(found)))
                held[lang] += len(found)
                if held[lang] >= block:
                    yield flush(number, lang, words.pop(lang), parts.pop(lang))
                    held[lang], number = 0, number + 1
        for lang in list(words):
            yield flush(number, lang, words.pop(lang), parts.pop(lang))
            number += 1

    return docs.select("text", F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang")).mapInArrow(run, _LAID)


def named_words(laid: DataFrame, ranges: int, least: int) -> DataFrame:
    """Names of the frequent words, and which words of which block they are."""
    schema = _schema(_NAMES)

    def run(table: pa.Table) -> pa.Table:
        rows = [(b, lang, unsqueezed(words).split(_END), unpacked(c).tolist(), risen(i)) for b, lang, words, c, i in zip(*(table.column(n).to_pylist() for n in ("block", "lang", "words", "counts", "idx")))]
        total: dict[str, dict[bytes, int]] = defaultdict(lambda: defaultdict(int))
        for _, lang, words, counts, _ in rows:
            of = total[lang]
            for w, c in zip(words, counts):
                of[w] += c
        base, out, ids = table.column("range")[0].as_py(), [], {}
        for lang in sorted(total):
            for w in sorted(w for w, a in total[lang].items() if a >= least):
                ids[lang, w] = base + len(ids) * ranges
                out.append((lang, ids[lang, w], w.decode(), None, None, total[lang][w], None, None, None))
        for block, lang, words, _, idx in rows:
            named = np.fromiter((ids.get((lang, w), -1) for w in words), np.int64, len(words))
            if (named >= 0).any():
                out.append((lang, None, None, None, None, None, block, rising(idx[named >= 0]), packed(named[named >= 0])))
        return _table(out, schema)

    return laid.where(F.col("range").isNotNull()).select("block", "lang", "range", "words", "counts", "idx").groupBy("range").applyInArrow(run, _NAMES)


def named_pairs(paired: DataFrame, ranges: int, least: int, last: bool) -> DataFrame:
    """Names of the frequent pairs, and (not for the last level) which pairs of
    which block they are."""
    schema = _schema(_NAMES)

    def run(table: pa.Table) -> pa.Table:
        blocks, langs, firsts = (table.column(n).to_pylist() for n in ("block", "lang", "first"))
        each = [[f(x) for x in table.column(n).to_pylist()] for n, f in (("lefts", risen), ("rights", unpacked), ("counts", unpacked))]
        sizes = [len(x) for x in each[0]]
        left, right, count = (np.concatenate(x) for x in each)
        order = np.lexsort((right, left))
        l, r = left[order], right[order]
        new = np.append(True, (l[1:] != l[:-1]) | (r[1:] != r[:-1]))
        starts, group = np.flatnonzero(new), np.cumsum(new) - 1
        total = np.add.reduceat(count[order], starts)
        frequent = total >= least
        name = np.where(frequent, table.column("range")[0].as_py() + (np.cumsum(frequent) - 1) * ranges, -1)
        row = np.repeat(np.arange(len(sizes)), sizes)[order][starts]
        out = [(langs[i], n, None, x, y, a, None, None, None) for i, n, x, y, a in zip(*(x[frequent].tolist() for x in (row, name, l[starts], r[starts], total)))]
        if not last:
            ids = np.empty(len(left), np.int64)
            ids[order] = name[group]
            for i, named in enumerate(np.split(ids, np.cumsum(sizes)[:-1])):
                some = np.flatnonzero(named >= 0)
                if len(some):
                    out.append((langs[i], None, None, None, None, None, blocks[i], rising(firsts[i] + some), packed(named[some])))
        return _table(out, schema)

    return paired.where(F.col("range").isNotNull()).select("block", "lang", "range", "first", "lefts", "rights", "counts").groupBy("range").applyInArrow(run, _NAMES)


def paired(laid: DataFrame, names: DataFrame, ranges: int, last: bool) -> DataFrame:
    """Each block with its grams replaced by their ids, paired with the next: a
    row with the numbers of a block's distinct pairs by position (not for the
    last level), and for each hash range a row with the pairs that fall there,
    in order, their counts and the number of the first."""
    schema = _schema(_PAIRS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, lang, held, numbers, answers in zip(*(batch.column(n) for n in ("block", "lang", "held", "seq", "answers"))):
                seq = sequence_from(held.as_py(), numbers.as_py())
                idx = np.concatenate([risen(x["idx"]) for x in answers.as_py()])
                ids = np.concatenate([unpacked(x["ids"]) for x in answers.as_py()])
                named = np.argsort(ids)
                idx, ids = idx[named], ids[named]
                dense = np.full(max(int(seq.max()), int(idx.max())) + 2, -1, np.int64)  # the last one is for -1
                dense[idx] = np.arange(len(ids))
                grams = dense[seq]
                at = np.flatnonzero((grams[:-1] >= 0) & (grams[1:] >= 0))
                if not len(at):
                    continue
                codes, inverse, counts = np.unique(grams[at] * len(ids) + grams[at + 1], return_inverse=True, return_counts=True)
                left, right = ids[codes // len(ids)], ids[codes % len(ids)]
                mixed = (left.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (right.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
                ranged = ((mixed >> np.uint64(29)) % np.uint64(ranges)).astype(np.int64)
                order = np.argsort(ranged, kind="stable")  # inside a range by left, then right
                rows = []
                if not last:
                    place = np.empty(len(order), np.int64)
                    place[order] = np.arange(len(order))
                    pairs = np.full(len(seq), -1, np.int64)
                    pairs[at] = place[inverse]
                    rows.append((block.as_py(), lang.as_py(), *sequence_of(pairs), None, None, None, None, None))
                first = 0
                for members in np.split(order, np.flatnonzero(np.diff(ranged[order])) + 1):
                    rows.append((block.as_py(), lang.as_py(), None, None, int(ranged[members[0]]), first, rising(left[members]), packed(right[members]), packed(counts[members])))
                    first += len(members)
                yield from _table(rows, schema).combine_chunks().to_batches()

    answers = names.where(F.col("block").isNotNull()).groupBy("block").agg(F.collect_list(F.struct("idx", "ids")).alias("answers"))
    return laid.where(F.col("seq").isNotNull()).select("block", "lang", "held", "seq").join(answers, "block").mapInArrow(run, _PAIRS)


def score_of(a: Column, l: Column, r: Column) -> Column:
    """floor(UNIT a / (l + r)) in exact decimals; the quotient fits a long."""
    wide = "decimal(19,0)"
    return F.call_function("div", F.lit(UNIT).cast("decimal(7,0)") * a.cast(wide), l.cast(wide) + r.cast(wide))


def candidates(levels: list[DataFrame]) -> DataFrame:
    """All candidates: lang, id, k, phrase, a, l, r, score, from the names of each
    level. Parents are found by id; the parts of a cut are parents, their parents,
    or words."""
    words = levels[0].select("lang", "id", "a", F.col("word").alias("phrase"), F.col("word").alias("tail"), F.col("a").alias("first"), F.col("a").alias("last"), F.lit(None).cast("long").alias("la"), F.lit(None).cast("long").alias("ra"))
    whole, out = words, []
    for k, names in enumerate(levels[1:], 2):
        near = [whole.select(F.col("id").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in ("a", "phrase", "tail", "first", "last", "la", "ra")]) for side in ("left", "right")]
        joined = names.select("lang", "id", "left", "right", "a").join(near[0], "left").join(near[1], "right")
        cuts = [("left_first", "right_a"), *[("left_la", "right_ra")] * (k == 4), *[("left_a", "right_last")] * (k > 2)]
        if k > 4:
            raise ValueError("phrases of four words at most")
        scored = [F.struct(score_of(F.col("a"), F.col(l), F.col(r)).alias("score"), F.lit(cut).alias("cut"), F.col(l).alias("l"), F.col(r).alias("r")) for cut, (l, r) in enumerate(cuts, 1)]
        best = scored[0] if len(scored) == 1 else F.least(*scored)
        whole = joined.select(
            "lang", "id", "a", F.concat_ws(" ", "left_phrase", "right_tail").alias("phrase"), F.col("right_tail").alias("tail"), F.col("left_first").alias("first"), F.col("right_last").alias("last"),
            F.col("left_a").alias("la"), F.col("right_a").alias("ra"), best.alias("best"), "left", "right",
        )
        whole = materialize(whole, f"phrases-{k}", "zstd")
        out.append(whole)
    kept = []
    for i, level in enumerate(out):
        if i + 1 < len(out):  # an extension by one word is at least as frequent as any longer one
            longer = out[i + 1].select(F.col("left").alias("id"), "a").union(out[i + 1].select(F.col("right").alias("id"), "a")).groupBy("id").agg(F.max("a").alias("longer"))
            level = level.join(longer, "id", "left").withColumn("dropped", F.coalesce(F.col("longer").cast("decimal(19,0)") * 100 >= F.col("a").cast("decimal(19,0)") * PERCENT, F.lit(False)))
        else:
            level = level.withColumn("dropped", F.lit(False))
        kept.append(level.select("lang", "id", F.lit(i + 2).alias("k"), "phrase", "a", F.col("best.l").alias("l"), F.col("best.r").alias("r"), F.col("best.score").alias("score"), "dropped"))
    all_kept = kept[0]
    for level in kept[1:]:
        all_kept = all_kept.union(level)
    return all_kept


def ranked(found: DataFrame, top: int) -> DataFrame:
    """The first `top` rows of each lang by score, a and phrase, with their rank.
    Large tables are cut first: each of many shares keeps its first rows, until
    no group is large."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    while (shares := -(-found.count() // RANKED)) > 1:
        share = Window.partitionBy("lang", "__share").orderBy(*order)
        cut = found.withColumn("__share", F.pmod(F.xxhash64("phrase"), F.lit(shares))).withColumn("__rank", F.row_number().over(share))
        before, found = found, materialize(cut.where(F.col("__rank") <= top).drop("__share", "__rank"), "best")
        if found.count() == before.count():
            break
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, block: int = BLOCK, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The strongest phrases of each language of docs (text, lang).

    A phrase is 2 to 4 words in a row inside a piece, found `least` times or
    more, overlaps counted. Returns lang, rank, phrase, a (its count), l and r
    (counts of the two parts at the cut of the lowest score), n (words of the
    language), score = floor(2000000 a / (l + r)). Phrases inside a longer one
    that is found 80 % as often are left out.

    Null text: empty. Null lang: `und`. Repeated rows count each time. Ties go by
    a, then by the phrase's bytes. Very long texts are part of one block, very
    long words are words. Empty table or no frequent phrase: empty result. Other
    columns are ignored.
    """
    spark = docs.sparkSession
    ranges = max(1, -(-(docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0) // range_bytes))
    path = new_path(spark, "laid")
    laid = materialize(laid_out(docs, ranges, block), "laid", path=path)
    sizes = materialize(laid.groupBy("lang").agg(F.sum("n_words").alias("n")), "sizes")
    names = [materialize(named_words(laid, ranges, least), "words", "zstd")]
    for k in range(2, LONGEST + 1):
        old, path = path, new_path(spark, f"pairs-{k}")
        laid = materialize(paired(laid, names[-1], ranges, k == LONGEST), f"pairs-{k}", path=path)
        remove(spark, old)
        names.append(materialize(named_pairs(laid, ranges, least, k == LONGEST), f"names-{k}", "zstd"))
    remove(spark, path)
    found = materialize(candidates([x.where(F.col("id").isNotNull()) for x in names]).where(~F.col("dropped")), "candidates")
    return ranked(found, top).join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_pair_naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), g AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(list_slice(w, i, i + k - 1), ' '))) AS phrase FROM w, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k
), f AS (
  SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY lang, k, phrase
), sizes AS (
  SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang
), c AS (
  SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND a >= 30
), cuts AS (
  SELECT lang, k, phrase, a, j, array_to_string(list_slice(w, 1, j), ' ') AS p, array_to_string(list_slice(w, j + 1, k), ' ') AS q FROM c, (SELECT unnest([1, 2, 3]) AS j) WHERE j < k
), scored AS (
  SELECT cuts.lang, cuts.k, cuts.phrase, cuts.a, j, x.a AS l, y.a AS r, CAST((2000000::HUGEINT * cuts.a) // (x.a + y.a) AS BIGINT) AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.k = j AND x.phrase = p JOIN f y ON y.lang = cuts.lang AND y.k = cuts.k - j AND y.phrase = q
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1
), inside AS (
  SELECT lang, a, k AS longer, m, unnest(list_transform(range(1, k - m + 2), lambda i: array_to_string(list_slice(w, i, i + m - 1), ' '))) AS phrase FROM c, (SELECT unnest([2, 3]) AS m) WHERE m < k
), gone AS (
  SELECT DISTINCT c.lang, c.phrase FROM c JOIN inside i ON i.lang = c.lang AND i.phrase = c.phrase AND i.m = c.k WHERE 100::HUGEINT * i.a >= 80::HUGEINT * c.a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score
FROM best JOIN sizes USING (lang) WHERE (lang, phrase) NOT IN (SELECT (lang, phrase) FROM gone)
QUALIFY rank <= 2000
"""
