"""Catalogue relations of a remote database, read through Spark's JDBC source.

Only the information schema and the system views are read here; the filters below are
simple predicates, which Spark pushes to the remote side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tieweave.sources.catalog import Catalog, columns_from_declared

# Databases that belong to the server itself.
SYSTEM_DATABASES = ("master", "tempdb", "model", "msdb")


class JdbcSource:
    def __init__(self, spark: SparkSession, url: str, properties: dict[str, str] | None = None):
        self.spark, self.url, self.properties = spark, url, dict(properties or {})

    def read(self, relation: str) -> DataFrame:
        return self.spark.read.jdbc(self.url, relation, properties=self.properties)

    def databases(self) -> DataFrame:
        names = self.read("sys.databases").where(
            ~F.col("name").isin(*SYSTEM_DATABASES) & (F.col("state") == 0)
        )
        return names.select(F.col("name").alias("database")).orderBy("database")

    def tables(self) -> DataFrame:
        return base_tables(self.read("INFORMATION_SCHEMA.TABLES"))

    def columns(self) -> DataFrame:
        raw = self.read("INFORMATION_SCHEMA.COLUMNS")
        return columns_from_declared(
            raw.select(
                F.col("TABLE_SCHEMA").alias("schema_name"),
                F.col("TABLE_NAME").alias("table_name"),
                F.col("COLUMN_NAME").alias("column_name"),
                F.col("DATA_TYPE").alias("native_type"),
                F.col("IS_NULLABLE").alias("is_nullable"),
                F.col("ORDINAL_POSITION").alias("ordinal"),
            )
        )

    def foreign_keys(self) -> DataFrame:
        return resolve_foreign_keys(
            self.read("sys.foreign_keys"),
            self.read("sys.foreign_key_columns"),
            self.read("sys.columns"),
            self.object_names(),
        )

    def keys(self) -> DataFrame:
        return index_keys(
            self.read("sys.indexes"), self.read("sys.index_columns"), self.read("sys.columns"), self.object_names()
        )

    def object_names(self) -> DataFrame:
        tables = self.read("sys.tables").select("object_id", "schema_id", F.col("name").alias("table_name"))
        schemas = self.read("sys.schemas").select("schema_id", F.col("name").alias("schema_name"))
        return tables.join(schemas, "schema_id").select("object_id", "schema_name", "table_name")

    def row_counts(self) -> DataFrame:
        return partition_row_counts(self.read("sys.partitions"), self.object_names())

    def catalog(self, **partitioning) -> Catalog:
        """The remote tables as lazy DataFrames with their declared keys and nullability.

        ``partitioning`` goes to ``spark.read.jdbc`` for every table; without it a table is read
        by one task.  Only the descriptions of the tables come to the driver.
        """
        frames = {
            r["table_key"]: self.spark.read.jdbc(
                self.url, f"{bracketed(r['schema_name'])}.{bracketed(r['table_name'])}",
                properties=self.properties, **partitioning,
            )
            for r in self.tables().toLocalIterator()
        }
        known = self.columns().select("schema_name", "table_name", "column_name", "is_nullable")
        return Catalog(
            self.spark,
            frames,
            tuple(r.asDict() for r in self.keys().toLocalIterator()),
            tuple(r.asDict() for r in self.foreign_keys().toLocalIterator()),
            {(f"{s}.{t}", c): n for s, t, c, n in known.toLocalIterator()},
        )


def bracketed(name: str) -> str:
    return "[" + name.replace("]", "]]") + "]"


def base_tables(raw: DataFrame) -> DataFrame:
    return (
        raw.where(F.col("TABLE_TYPE") == "BASE TABLE")
        .select(
            F.concat_ws(".", "TABLE_SCHEMA", "TABLE_NAME").alias("table_key"),
            F.col("TABLE_SCHEMA").alias("schema_name"),
            F.col("TABLE_NAME").alias("table_name"),
        )
        .orderBy("schema_name", "table_name")
    )


def partition_row_counts(partitions: DataFrame, names: DataFrame) -> DataFrame:
    """Approximate rows per table: partition rows of the heap or the clustered index."""
    return (
        partitions.where(F.col("index_id").isin(0, 1))
        .join(names, "object_id")
        .groupBy(F.concat_ws(".", "schema_name", "table_name").alias("table_key"))
        .agg(F.sum("rows").alias("row_count"))
    )


def _named_columns(columns: DataFrame, names: DataFrame) -> DataFrame:
    own = columns.select("object_id", "column_id", F.col("name").alias("column_name"))
    return own.join(names, "object_id")


def index_keys(indexes: DataFrame, parts: DataFrame, columns: DataFrame, names: DataFrame) -> DataFrame:
    """One row per column of an index, named, with its place in it; included columns are none of it."""
    key = ["object_id", "index_id"]
    listed = indexes.select(*key, F.col("name").alias("key_name"), "is_primary_key", "is_unique")
    places = parts.where(F.col("key_ordinal") > 0).select(*key, "column_id", F.col("key_ordinal").cast("int"))
    rows = listed.join(places, key).join(_named_columns(columns, names), ["object_id", "column_id"])
    return rows.select(
        F.concat_ws(".", "schema_name", "table_name").alias("table_key"), "key_name",
        F.col("is_primary_key").cast("boolean"), F.col("is_unique").cast("boolean"), "column_name", "key_ordinal",
    ).orderBy("table_key", "key_name", "key_ordinal")


def resolve_foreign_keys(
    constraints: DataFrame, parts: DataFrame, columns: DataFrame, names: DataFrame
) -> DataFrame:
    """One row per column of a foreign key, with both sides named.

    Columns go by the id that the server gave them (``sys.columns``), which is not their
    position once a column has been dropped.
    """
    placed = _named_columns(columns, names)

    def side(role: str, object_col: str, column_col: str) -> DataFrame:
        return placed.select(
            F.col("object_id").alias(object_col),
            F.col("column_id").alias(column_col),
            F.col("schema_name").alias(f"{role}_schema"),
            F.col("table_name").alias(f"{role}_table"),
            F.col("column_name").alias(f"{role}_column"),
        )

    return (
        constraints.select(F.col("object_id").alias("constraint_object_id"), F.col("name").alias("constraint_name"))
        .join(parts, "constraint_object_id")
        .join(side("source", "parent_object_id", "parent_column_id"), ["parent_object_id", "parent_column_id"])
        .join(
            side("target", "referenced_object_id", "referenced_column_id"),
            ["referenced_object_id", "referenced_column_id"],
        )
        .select(
            "constraint_name", "source_schema", "source_table", "source_column",
            "target_schema", "target_table", "target_column",
        )
        .orderBy("source_schema", "source_table", "constraint_name")
    )
