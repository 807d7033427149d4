"""Helpers the operators of this package share."""

from __future__ import annotations

from typing import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, wherever words are counted or shingled: no blank, tab, line or page break in it.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    """The user's statement of how wide a shuffle of this input should be."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def id_text(doc_id: str = "doc_id") -> Column:
    return F.col(doc_id).cast("string")


def pmod_of_id(divisor: int, doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo ``divisor``; null for a null id."""
    return F.pmod(F.crc32(id_text(doc_id)), F.lit(divisor))


def arrow_batches(schema: pa.Schema, columns: dict[str, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[field.name], type=field.type) for field in schema], schema=schema
    )


def slices(batch: pa.RecordBatch, text: str, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of ``batch`` of about ``most_bytes`` of text each, so that long texts do not pile up."""
    size = 0
    begin = 0
    lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0).to_pylist()
    for at, length in enumerate(lengths):
        size += length
        if size >= most_bytes:
            yield batch.slice(begin, at + 1 - begin)
            begin, size = at + 1, 0
    if begin < len(lengths):
        yield batch.slice(begin)


Batches = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
