"""A stored table of graphs, cut into buckets by graph, of which a save rewrites only its own."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException

from tieweave.session import materialize


class GraphTable:
    """Rows of all graphs, with a manifest of the folder that holds each bucket's current files.

    A write puts new files of the buckets it changes into a folder of its own, then adds one file to the
    manifest: (version, bucket, write).  That file is the commit.  A write that fails before leaves every reader
    with the old files, and earlier versions stay readable.  ``buckets`` is fixed when the table is made, so the
    manifest that the driver reads is at most that many rows.  One writer at a time.
    """

    MANIFEST = "version long, bucket int, write string"

    def __init__(self, spark: SparkSession, folder: str, schema: StructType, key: str = "graph_id", buckets: int = 64):
        self.spark, self.folder, self.schema, self.key, self.buckets = spark, folder, schema, key, buckets

    def bucket(self, graph: Column) -> Column:
        return F.pmod(F.xxhash64(graph.cast("string")), F.lit(self.buckets)).cast("int")

    def _manifest(self, version: int | None) -> DataFrame:
        try:
            rows = self.spark.read.schema(self.MANIFEST).parquet(f"{self.folder}/manifest")
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            rows = self.spark.createDataFrame([], self.MANIFEST)
        return rows if version is None else rows.where(F.col("version") <= version)

    def version(self) -> int:
        return self._manifest(None).agg(F.max("version")).first()[0] or 0

    def rows(self, version: int | None = None) -> DataFrame:
        """All rows of a version (the last one by default), with their ``bucket``."""
        last = self._manifest(version).groupBy("bucket").agg(F.max_by("write", "version").alias("write"))
        held = last.where(F.col("write").isNotNull()).collect()
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema)
        if not held:
            return self.spark.createDataFrame([], f"{kinds}, bucket int")
        paths = [f"{self.folder}/data/write={r['write']}/bucket={r['bucket']}" for r in held]
        reader = self.spark.read.schema(f"{kinds}, write string, bucket int").option("basePath", f"{self.folder}/data")
        return reader.parquet(*paths).drop("write")

    def of_graph(self, graph_id: str, version: int | None = None) -> DataFrame:
        """Rows of one graph: only its bucket's files are read."""
        own = self.rows(version).where(F.col("bucket") == self.bucket(F.lit(graph_id)))
        return own.where(F.col(self.key) == graph_id).drop("bucket")

    def save(self, rows: DataFrame) -> int:
        """The graphs in ``rows`` replace those of the same id; returns the new version.

        Rows without an id are added and replace nothing.  Without rows nothing changes.  They are worked out
        once: a table without a version has nothing to replace; else they are read twice, so they are written first.
        """
        rows = rows.select(*self.schema.names)
        if not self.version():
            return self._write(1, self._in_buckets(rows), set())
        rows = materialize(rows, "saved")
        return self._replace(rows.select(self.key).distinct(), rows)

    def delete(self, doomed: DataFrame) -> int:
        """Removes the graphs in ``doomed`` (the key column)."""
        return self._replace(doomed.select(self.key).distinct(), None)

    def fork(self, source_id: str, new_id: str) -> int:
        """A copy of one graph under another id; reads its bucket and writes the copy's."""
        return self.save(self.of_graph(source_id).withColumn(self.key, F.lit(new_id)))

    def _replace(self, graphs: DataFrame, rows: DataFrame | None) -> int:
        version = self.version() + 1
        key = self.bucket(F.col(self.key)).alias("bucket")
        touched = sorted(r["bucket"] for r in graphs.select(key).distinct().collect())
        if not touched:
            return version - 1
        kept = self.rows().where(F.col("bucket").isin(touched)).join(graphs, self.key, "left_anti")
        out = kept.select(*self.schema.names, "bucket")
        if rows is not None:
            out = out.unionByName(self._in_buckets(rows))
        return self._write(version, out, set(touched))

    def _in_buckets(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", self.bucket(F.col(self.key))).select(*self.schema.names, "bucket")

    def _write(self, version: int, out: DataFrame, touched: set[int]) -> int:
        """Writes the rows of the ``touched`` buckets, and of any others in ``out``, and commits them."""
        write = f"w{uuid.uuid4().hex}"
        # Salted, so that a graph with most rows is written by several tasks.
        salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in self.schema.names]), F.lit(16))
        out.repartition("bucket", salt).write.partitionBy("bucket").parquet(f"{self.folder}/data/write={write}")
        # A bucket that is left without rows has no folder: its entry names none.
        filled = {r["bucket"] for r in self._written(write)}
        entries = [(version, b, write if b in filled else None) for b in sorted(touched | filled)]
        if not entries:
            return version - 1
        self.spark.createDataFrame(entries, self.MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.folder}/manifest")
        return version

    def _written(self, write: str) -> list:
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema)
        path = f"{self.folder}/data/write={write}"
        return self.spark.read.schema(f"{kinds}, bucket int").parquet(path).select("bucket").distinct().collect()
