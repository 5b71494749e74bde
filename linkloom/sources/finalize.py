"""Finished scan documents, kept as one commit over many tables.

A batch is parsed once into a table of nested columns; every child table is a
select over the columns that it needs. The batch counts once its manifest stands,
which is written last: readers go by manifests, so of a batch that failed half way
nothing is seen, and the next delivery does it anew. The graph is derived from
what is committed and takes the batch after that, under the same number, so that
a failure there loses no document and a later delivery makes up for it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import host as H
from ..operators import links as L
from ..operators import projection as P
from ..storage import remove, small
from ..streaming.maintenance import OBSERVED, GraphStore


def graph_rows(docs: DataFrame) -> DataFrame:
    """Observations of parsed documents as a graph store takes them, addresses
    among them, with the registrable domain of each host."""
    rows = L.with_addresses(P.observations(docs), P.edges(docs))
    return rows.withColumn("rd", H.registrable_domain(F.col("entity"))).select(*OBSERVED.names)


class DocumentStore:
    """Batches of documents (run, json) and their child tables under a folder."""

    def __init__(self, spark: SparkSession, folder: str, graph: GraphStore | None = None):
        self.spark, self.folder, self.graph = spark, folder.rstrip("/"), graph
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, table: str, number: int) -> str:
        return f"{self.folder}/{table}/batch={number}"

    def _whole(self, table: str, number: int) -> bool:
        return self._fs.exists(self._path(f"{self._at(table, number)}/_SUCCESS"))

    def committed(self) -> list[int]:
        """Numbers of the batches that count."""
        top = self._path(f"{self.folder}/manifests")
        names = [x.getPath().getName() for x in self._fs.listStatus(top)] if self._fs.exists(top) else []
        numbers = [int(n.removeprefix("batch=")) for n in names if n.startswith("batch=")]
        return sorted(n for n in numbers if self._whole("manifests", n))

    def _write(self, rows: DataFrame, table: str, number: int) -> None:
        rows.write.mode("overwrite").parquet(self._at(table, number))

    def save(self, documents: DataFrame, number: int) -> None:
        """Keep a batch; fits foreachBatch. A batch that was done changes nothing."""
        done = number in self.committed()
        if done and (self.graph is None or number in self.graph.versions("dirty")):
            return
        if not (done and self._whole("parsed", number)):
            if not done:
                self._write(documents.select("run", "json"), "documents", number)
            self._write(P.parsed(self.spark.read.parquet(self._at("documents", number))), "parsed", number)
        docs = self.spark.read.parquet(self._at("parsed", number))
        if not done:
            tables = P.child_tables(docs)
            for name, rows in tables.items():
                self._write(rows, name, number)
            names = ["documents", *tables]
            self._write(self.spark.createDataFrame([(n,) for n in names], "table string").coalesce(1), "manifests", number)
        if self.graph is not None:
            self.graph.apply(graph_rows(docs), number)
        remove(self.spark, self._at("parsed", number))

    def read(self, table: str) -> DataFrame:
        """Rows of all batches that count. A run that came again has the rows of
        its last batch alone, in every table."""
        numbers = self.committed()
        if not numbers:
            raise ValueError("no batch is committed yet")
        of = lambda name: self.spark.read.option("basePath", f"{self.folder}/{name}").parquet(*[self._at(name, n) for n in numbers])
        rows = of(table)
        if len(numbers) > 1:
            seen = of("documents").groupBy("run").agg(F.max("batch").alias("last"), F.min("batch").alias("first"))
            again = seen.where("first < last").select("run", "last")
            rows = rows.join(small(again), "run", "left").where("last IS NULL OR batch = last").drop("last")
        return rows.drop("batch")
