"""Token ids in ORC files: written in the order of the ids, read stripe by stripe."""

from __future__ import annotations

import uuid
import zlib
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tieweave.llm.common import slices, shuffle_partitions
from tieweave.llm.encoder import definition, encoder_of
from tieweave.session import shared_folder

ROWS = pa.schema(
    [
        ("doc_id", pa.int64()), ("part", pa.int32()), ("start_in_part", pa.int64()), ("n_tokens", pa.int32()),
        ("ids", pa.list_(pa.int32())),
    ]
)


def write_tokens(docs: DataFrame, vocabulary: str, path: str, end_id: int = 0) -> None:
    """Encodes ``docs`` (doc_id, text) into ORC files below ``path``, ascending by id.

    Ids go through ORC's integer run-length encoding (version 2).  Row indexes and Bloom filters
    on ``doc_id`` let a reader skip stripes and groups of rows by metadata.  ``part`` numbers the
    ranges of ids; ``start_in_part`` counts the ids before the document in its range.

    Null text counts as empty.  Null ids come first.  Equal ids are ordered by text.  An empty
    table gives files without rows.  Other columns are not read.
    """
    spark = docs.sparkSession
    shipped = spark.sparkContext.broadcast(definition(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, part, begun = encoder_of(shipped), TaskContext.get().partitionId(), 0
        for batch in batches:
            for piece in slices(batch, "text"):
                encoded = codec.encode(piece.column("text").to_pylist(), end_id)
                sizes = np.array([len(ids) // 4 for ids in encoded], dtype=np.int64)
                ends = np.cumsum(sizes)
                ids = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], ends]).astype(np.int32)),
                    pa.array(np.frombuffer(b"".join(encoded), dtype="<i4")),
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column("doc_id"), pa.array(np.full(len(sizes), part, np.int32)),
                        pa.array(begun + ends - sizes), pa.array(sizes.astype(np.int32)), ids,
                    ],
                    schema=ROWS,
                )
                begun += int(ends[-1])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ordered = rows.repartitionByRange(shuffle_partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(
        run, "doc_id long, part int, start_in_part long, n_tokens int, ids array<int>"
    ).write.option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01").option(
        "orc.create.index", "true"
    ).option("orc.row.index.stride", "1000").option("compression", "zstd").orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The written rows; splits follow stripes, and filters on ``doc_id`` prune by metadata."""
    kinds = "doc_id long, part int, start_in_part long, n_tokens int, ids array<int>"
    return spark.read.schema(kinds).orc(path)


def token_digest(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and crc32 of what the files hold."""
    rows = read_tokens(spark, path)
    # One row for each range of ids, hence as few as there are files.
    sizes = rows.groupBy("part").agg(F.max(F.col("start_in_part") + F.col("n_tokens")).alias("tokens"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select(
        F.col("part").alias("base_part"), F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base")
    )

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [("doc_id", pa.int64()), ("part", pa.int32()), ("start_in_part", pa.int64()), ("n_tokens", pa.int64()),
             ("ids_crc32", pa.int64())]
        )
        for batch in batches:
            ids = batch.column("ids")
            values = ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            offsets = ids.offsets.to_numpy()
            sums = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("part"), batch.column("start_in_part"),
                 pa.array(np.diff(offsets).astype(np.int64)), pa.array(sums, pa.int64())],
                schema=schema,
            )

    digests = rows.mapInArrow(crc, "doc_id long, part int, start_in_part long, n_tokens long, ids_crc32 long")
    return digests.join(F.broadcast(bases), digests["part"] == bases["base_part"]).select(
        "doc_id", (F.col("base") + F.col("start_in_part")).alias("start"), "n_tokens", "ids_crc32"
    )


def token_files(docs: DataFrame, vocabulary: str, end_id: int = 0) -> str:
    """Writes ``docs`` to a new folder of the shared one and returns its path."""
    spark = docs.sparkSession
    path = f"{shared_folder(spark)}/tieweave/{spark.sparkContext.applicationId}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, vocabulary, path, end_id)
    return path
