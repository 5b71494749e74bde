"""Operator 2: delta-maintained token counts.

Totals are the sum of signed deltas, one small table per batch, summed by source,
language and tokenizer version before it is written. A batch's table is written
under a name of its own; what commits it is a small file with the batch's id as
its name, renamed into place by an operation that fails where the name is taken.
So of two writers one wins, and a batch delivered again changes nothing. Every
FOLD_AFTER batches their tables are folded into one, with the list of their ids.
Texts are tokenised once, where they are read; old counts come from the ledger,
not from a scan of the corpus.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, new_path, read
from .tokens import ids_of

KEYS = ("source", "lang", "tokenizer_version")
VERSIONS = ("byte_bpe_50k", "byte_bpe_multi_50k")
#: Committed batches after which their tables are folded into one.
FOLD_AFTER = 32


class TokenRollup:
    """Additive totals in a folder that all executors share.

    folder/data/<name> holds tables of summed deltas; folder/commits/<batch id>
    names that of a committed batch; folder/folds/<number> names the tables of
    the totals and of the ids of all batches up to it.
    """

    def __init__(self, spark: SparkSession, folder: str, keys: Sequence[str] = KEYS, fold_after: int = FOLD_AFTER):
        self.spark, self.folder, self.keys, self.fold_after = spark, folder.rstrip("/"), tuple(keys), fold_after
        fs = spark._jvm.org.apache.hadoop.fs
        self._path, conf = fs.Path, spark._jsc.hadoopConfiguration()
        self._fs = self._path(self.folder).getFileSystem(conf)
        self._files = fs.FileContext.getFileContext(self._path(self.folder).toUri() if "://" in self.folder else self._fs.getUri(), conf)
        self._keep = spark.sparkContext._gateway.new_array(fs.Options.Rename, 0)  # no option: never onto a file

    def _listed(self, kind: str) -> list[str]:
        top = self._path(f"{self.folder}/{kind}")
        return sorted(x.getPath().getName() for x in self._fs.listStatus(top) if not x.getPath().getName().startswith((".", "_"))) if self._fs.exists(top) else []

    def _claim(self, kind: str, name: str, content: str) -> bool:
        """Make folder/kind/name with its content, all at once; False if it is
        there already."""
        done, aside = self._path(f"{self.folder}/{kind}/{name}"), self._path(f"{self.folder}/_aside/{uuid.uuid4().hex}")
        self._fs.mkdirs(done.getParent())
        out = self._fs.create(aside, True)
        out.write(bytearray(content.encode()))
        out.close()
        try:
            self._files.rename(aside, done, self._keep)
            return True
        except Py4JJavaError as error:
            if error.java_exception.getClass().getSimpleName() != "FileAlreadyExistsException":
                raise
            self._fs.delete(aside, False)
            return False

    def _content(self, kind: str, name: str) -> str:
        file = self._fs.open(self._path(f"{self.folder}/{kind}/{name}"))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(file, "UTF-8")
        finally:
            file.close()

    def committed(self) -> list[str]:
        """Ids of the committed batches."""
        return self._listed("commits")

    def commit(self, batch_id: str, events: DataFrame) -> bool:
        """Add a batch of events; False, and no change, if its id is known.

        events: kind (insert, delete or revise), the keys, tokens (the new
        count) and old_tokens (the count that it replaces or takes away). An
        insert adds a document, a delete takes one, a revision keeps it; null
        counts are 0, null keys are groups of their own; other kinds are an
        error.
        """
        if not re.fullmatch(r"[A-Za-z0-9][\w.-]*", batch_id):
            raise ValueError(f"not a batch id: {batch_id!r}")
        if self._fs.exists(self._path(f"{self.folder}/commits/{batch_id}")):
            return False
        kind = F.col("kind")
        known = F.when(kind == "insert", F.lit(1)).when(kind == "delete", F.lit(-1)).when(kind == "revise", F.lit(0))
        sign = F.coalesce(known, F.raise_error(F.concat(F.lit("unknown kind of event: "), F.coalesce(kind, F.lit("null")))).cast("int"))
        new = F.when(kind == "delete", F.lit(0)).otherwise(F.coalesce("tokens", F.lit(0)))
        old = F.when(kind == "insert", F.lit(0)).otherwise(F.coalesce("old_tokens", F.lit(0)))
        name = f"batch-{uuid.uuid4().hex}"
        events.groupBy(*self.keys).agg(F.sum(sign).cast("long").alias("n_docs"), F.sum(new - old).cast("long").alias("n_tokens")).write.parquet(f"{self.folder}/data/{name}")
        if not self._claim("commits", batch_id, name):  # another writer was first
            self._fs.delete(self._path(f"{self.folder}/data/{name}"), True)
            return False
        if len(self._open()) >= self.fold_after:
            self.fold()
        return True

    def _last_fold(self) -> tuple[int, str | None, set[str]]:
        """Number, table and batch ids of the last fold."""
        folds = [int(x) for x in self._listed("folds")]
        if not folds:
            return -1, None, set()
        name = self._content("folds", f"{max(folds):012d}")
        return max(folds), name, {r.batch for r in self.spark.read.parquet(f"{self.folder}/data/{name}-ids").collect()}

    def _open(self) -> list[str]:
        """Committed batches that no fold holds."""
        folded = self._last_fold()[2]
        return [x for x in self.committed() if x not in folded]

    def _sum(self, parts: list[str]) -> DataFrame:
        summed = self.spark.read.parquet(*[f"{self.folder}/data/{x}" for x in parts]).groupBy(*self.keys)
        return summed.agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where("n_docs <> 0 OR n_tokens <> 0")

    def fold(self) -> bool:
        """Fold all committed batches into one table; False if there is nothing
        to fold, or another writer folded meanwhile. Batches stay known by id."""
        number, table, ids = self._last_fold()
        fresh = [x for x in self.committed() if x not in ids]
        if not fresh:
            return False
        name = f"fold-{uuid.uuid4().hex}"
        self._sum([*([table] if table else []), *[self._content("commits", x) for x in fresh]]).write.parquet(f"{self.folder}/data/{name}")
        self.spark.createDataFrame([(x,) for x in sorted({*ids, *fresh})], "batch string").write.parquet(f"{self.folder}/data/{name}-ids")
        return self._claim("folds", f"{number + 1:012d}", name)

    def totals(self) -> DataFrame:
        """keys, n_docs, n_tokens over all committed batches; groups that came
        back to nothing are left out."""
        _, table, ids = self._last_fold()
        parts = [*([table] if table else []), *[self._content("commits", x) for x in self.committed() if x not in ids]]
        if not parts:
            raise ValueError("no batch is committed")
        return self._sum(parts)


def without_repeated_lines(text: str) -> str:
    """The text without lines that repeat an earlier one."""
    return "\n".join(dict.fromkeys(text.split("\n")))


def ledger(docs: DataFrame, versions: Sequence[str] = VERSIONS) -> DataFrame:
    """Token counts of every row of docs (doc_id, text, source, lang) for each
    tokenizer version: doc_id, source, lang, tokenizer_version, tokens, and
    revised (the count once repeated lines are gone; null if there are none).
    Null text counts 0."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            texts = part.pop("text")
            revised = [without_repeated_lines(x) if x and "\n" in x else x for x in texts]
            for version in versions:
                tokens = [len(ids_of(version, x)) for x in texts]
                again = [None if a == b else len(ids_of(version, b)) for a, b in zip(texts, revised)]
                yield part.assign(tokenizer_version=version, tokens=np.array(tokens, np.int64), revised=pd.array(again, "Int64"))

    return docs.select("doc_id", "source", "lang", "text").mapInPandas(run, f"doc_id {kind}, source string, lang string, tokenizer_version string, tokens long, revised long")


def maintain(docs: DataFrame, removed: DataFrame, folder: str, versions: Sequence[str] = VERSIONS) -> DataFrame:
    """Totals after four commits: every document is inserted; those with
    repeated lines are revised to the count without them; those in removed
    (doc_id) are deleted with the counts that they then have; and the last two
    batches are delivered once more, to no effect.

    Returns source, lang, tokenizer_version, n_docs, n_tokens. Null text: 0
    tokens. Null source or lang: groups of their own. Null doc_id: never removed.
    Repeated rows: each counts, and all rows of a removed id go. Empty table:
    empty result. Other columns are ignored.
    """
    spark = docs.sparkSession
    rows = materialize(ledger(docs, versions), "ledger")
    changed = rows.where("revised IS NOT NULL")
    gone = rows.join(removed.select("doc_id").where("doc_id IS NOT NULL").distinct(), "doc_id", "left_semi")
    batches = {
        "1-insert": rows.select(F.lit("insert").alias("kind"), *KEYS, "tokens", F.lit(None).cast("long").alias("old_tokens")),
        "2-revise": changed.select(F.lit("revise").alias("kind"), *KEYS, F.col("revised").alias("tokens"), F.col("tokens").alias("old_tokens")),
        "3-delete": gone.select(F.lit("delete").alias("kind"), *KEYS, F.lit(None).cast("long").alias("tokens"), F.coalesce("revised", "tokens").alias("old_tokens")),
    }
    rollup = TokenRollup(spark, folder)
    for batch_id in (*batches, "2-revise", "3-delete"):
        rollup.commit(batch_id, batches[batch_id])
    return rollup.totals()


def op2_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintain(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels").where("toxic = 1"), new_path(spark, "rollup"))
