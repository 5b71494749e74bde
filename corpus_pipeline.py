"""From raw documents to packed training sequences, stage by stage.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and
returns a DataFrame that is written as Parquet and read back as the next one's
docs. All but the last return the columns of documents; other columns pass
through them. An empty table gives an empty result in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from linkloom.llm import lines, mixing, neardup, packing, quality
from linkloom.llm.common import materialize, read


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules, or whose host is rejected, go: so do
    those of null, empty or short text. Null source: a host of its own. Repeated
    rows and rows without an id are judged one by one."""
    return quality.kept_documents(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that spread over many sources stay in one document; documents of
    nothing else go. Null and empty texts stay as they are. Null source: no site.
    Repeated rows keep or lose a line together."""
    return lines.cleaned_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the smallest id;
    of repeated rows one. Rows without an id, and texts without words, stay."""
    return neardup.kept_documents(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are repeated or cut to their target weights. Texts without words
    have nothing to take and go. Null source: a source of its own, the last.
    Rows without an id and repeated rows are taken like any other."""
    return mixing.mixed_documents(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces, placed in sequences. Null or empty text: the end id
    alone. Rows without an id and repeated rows are packed each by itself."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("source_mix", source_mix),
    ("best_fit_packing", best_fit_packing),
]

#: Near copies, the tokenizer and packing are beyond SQL; the tests hold each
#: stage against a brute-force version, and run() against the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES applied to documents, each stage's result written and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
