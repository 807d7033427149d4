"""Drift snapshots as tables partitioned by snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tieweave.operators.drift import snapshot_columns, snapshot_tables

TABLES_SCHEMA = "table_key string, schema_name string, table_name string, row_count bigint, snapshot_id string"
COLUMNS_SCHEMA = (
    "table_key string, column_name string, data_type string, is_nullable boolean, "
    "ordinal_position int, snapshot_id string"
)


def save_snapshot(inventory: DataFrame, folder: str, snapshot_id: str) -> None:
    """Append the tables and columns of an inventory under ``snapshot_id``."""
    for name, frame in (("tables", snapshot_tables(inventory)), ("columns", snapshot_columns(inventory))):
        frame.withColumn("snapshot_id", F.lit(snapshot_id)).write.mode("append").partitionBy("snapshot_id").parquet(
            f"{folder}/{name}"
        )


def load_snapshot(spark: SparkSession, folder: str, snapshot_id: str) -> tuple[DataFrame, DataFrame]:
    """Tables and columns of a snapshot; both empty when there is none."""
    frames = []
    for name, schema in (("tables", TABLES_SCHEMA), ("columns", COLUMNS_SCHEMA)):
        try:
            frame = spark.read.schema(schema).parquet(f"{folder}/{name}")
        except AnalysisException:
            frame = spark.createDataFrame([], schema)
        frames.append(frame.where(F.col("snapshot_id") == snapshot_id).drop("snapshot_id"))
    return frames[0], frames[1]
