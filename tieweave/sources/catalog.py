"""Catalogue of the tables under analysis and the inventory built from it."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce
from typing import Iterable, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tieweave.functions.families import declared_family, spark_family
from tieweave.session import local_frame

TABLES_SCHEMA = pa.schema(
    [("table_key", pa.string()), ("schema_name", pa.string()), ("table_name", pa.string())]
)
COLUMNS_SCHEMA = pa.schema(
    [
        ("col_id", pa.int32()),
        ("table_key", pa.string()),
        ("schema_name", pa.string()),
        ("table_name", pa.string()),
        ("column_name", pa.string()),
        ("native_type", pa.string()),
        ("family", pa.string()),
        ("is_nullable", pa.bool_()),
        ("ordinal", pa.int32()),
    ]
)
KEYS_SCHEMA = pa.schema(
    [
        ("table_key", pa.string()),
        ("key_name", pa.string()),
        ("is_primary_key", pa.bool_()),
        ("is_unique", pa.bool_()),
        ("column_name", pa.string()),
        ("key_ordinal", pa.int32()),
    ]
)
FOREIGN_KEYS_SCHEMA = pa.schema(
    [
        ("constraint_name", pa.string()),
        ("source_schema", pa.string()),
        ("source_table", pa.string()),
        ("source_column", pa.string()),
        ("target_schema", pa.string()),
        ("target_table", pa.string()),
        ("target_column", pa.string()),
    ]
)


@dataclass(frozen=True)
class Catalog:
    """Named DataFrames plus what is declared about them.

    ``tables`` maps ``schema.table`` to a lazy DataFrame.  Columns get a number in the
    order (table key, position); the wide relations of a run carry only that number.
    """

    spark: SparkSession
    tables: Mapping[str, DataFrame]
    keys: tuple[dict, ...] = ()
    foreign_keys: tuple[dict, ...] = ()
    nullable: Mapping[tuple[str, str], bool] = field(default_factory=dict)

    # -- where tables come from

    @classmethod
    def from_parquet(
        cls, spark: SparkSession, paths: Mapping[str, str], schema_name: str = "main", **declared
    ) -> "Catalog":
        # Reading a schema waits on file footers, so the tables are opened side by side.
        with ThreadPoolExecutor(max_workers=16) as pool:
            opened = list(pool.map(spark.read.parquet, paths.values()))
        keys = [f"{schema_name}.{name}" for name in paths]
        return cls(spark, dict(zip(keys, opened)), **declared)

    @classmethod
    def from_directory(
        cls, spark: SparkSession, folder: str, schema_name: str = "main", **declared
    ) -> "Catalog":
        """Every parquet file or folder right below ``folder`` is a table."""
        root = spark._jvm.org.apache.hadoop.fs.Path(folder)
        fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
        paths = {}
        for status in fs.listStatus(root):
            name = status.getPath().getName()
            if not name.startswith(("_", ".")):
                paths[name.removesuffix(".parquet")] = status.getPath().toString()
        return cls.from_parquet(spark, paths, schema_name, **declared)

    @classmethod
    def from_database(
        cls, spark: SparkSession, databases: Iterable[str], **declared
    ) -> "Catalog":
        """Every base table of the named databases of the session catalogue."""
        frames = {}
        for database in databases:
            for table in spark.catalog.listTables(database):
                if table.tableType in ("MANAGED", "EXTERNAL"):
                    frames[f"{database}.{table.name}"] = spark.table(f"`{database}`.`{table.name}`")
        return cls(spark, frames, **declared)

    def only(self, wanted: Iterable[str]) -> "Catalog":
        """The tables asked for, each once and in the order asked."""
        frames = {key: self.tables[key] for key in dict.fromkeys(wanted) if key in self.tables}
        return Catalog(self.spark, frames, self.keys, self.foreign_keys, self.nullable)

    # -- driver-side lists: as long as the schemas, never as long as the data

    def table_rows(self) -> list[dict]:
        rows = []
        for key in sorted(self.tables):
            schema_name, _, table_name = key.rpartition(".")
            rows.append({"table_key": key, "schema_name": schema_name, "table_name": table_name})
        return rows

    def column_rows(self) -> list[dict]:
        rows = []
        for table in self.table_rows():
            key = table["table_key"]
            for position, f in enumerate(self.tables[key].schema.fields, start=1):
                rows.append(
                    {
                        "col_id": len(rows),
                        **table,
                        "column_name": f.name,
                        "native_type": f.dataType.simpleString(),
                        "family": spark_family(f.dataType),
                        "is_nullable": self.nullable.get((key, f.name), f.nullable),
                        "ordinal": position,
                    }
                )
        return rows

    @classmethod
    def of_connections(cls, spark: SparkSession, catalogs: Mapping[str, "Catalog"]) -> "Catalog":
        """One catalogue over several connections; a table's key begins with its connection's name.

        So tables of equal names stay apart, and pairs across connections can be told.  Each
        DataFrame reads from its own source.
        """

        def moved(name: str, row: dict, *fields: str) -> dict:
            return {**row, **{f: f"{name}.{row[f]}" for f in fields}}

        parts = list(catalogs.items())
        return cls(
            spark,
            {f"{name}.{key}": frame for name, c in parts for key, frame in c.tables.items()},
            tuple(moved(name, k, "table_key") for name, c in parts for k in c.keys),
            tuple(moved(name, k, "source_schema", "target_schema") for name, c in parts for k in c.foreign_keys),
            {(f"{name}.{key}", column): n for name, c in parts for (key, column), n in c.nullable.items()},
        )

    # -- relations

    def tables_frame(self) -> DataFrame:
        return local_frame(self.spark, self.table_rows(), TABLES_SCHEMA)

    def columns_frame(self) -> DataFrame:
        return local_frame(self.spark, self.column_rows(), COLUMNS_SCHEMA)

    def keys_frame(self) -> DataFrame:
        return local_frame(self.spark, list(self.keys), KEYS_SCHEMA)

    def foreign_keys_frame(self) -> DataFrame:
        rows = local_frame(self.spark, list(self.foreign_keys), FOREIGN_KEYS_SCHEMA)
        return rows.orderBy("source_schema", "source_table", "constraint_name")

    def row_counts(self) -> DataFrame:
        """Rows per table, from one job that reads no column of any table.

        Empty tables have no row here.
        """
        marks = [df.select(F.lit(key).alias("table_key")) for key, df in self.tables.items()]
        if not marks:
            return self.spark.createDataFrame([], "table_key string, row_count long")
        return reduce(DataFrame.unionAll, marks).groupBy("table_key").agg(F.count(F.lit(1)).alias("row_count"))

    def inventory(self) -> DataFrame:
        return inventory(
            self.tables_frame(),
            self.columns_frame(),
            self.keys_frame(),
            self.foreign_keys_frame(),
            self.row_counts(),
        )


def list_databases(spark: SparkSession, system: Iterable[str] = ("global_temp",)) -> DataFrame:
    """Names of the user databases, in order."""
    names = [{"database": d.name} for d in spark.catalog.listDatabases()]
    frame = local_frame(spark, names, pa.schema([("database", pa.string())]))
    return frame.where(~F.col("database").isin(*system)).orderBy("database")


def key_list(keys: DataFrame) -> DataFrame:
    """One row per key with its columns in key order; unnamed keys are left out.

    A key has a handful of columns, so the array is bounded by the table's width.
    """
    return (
        keys.where(F.col("key_name").isNotNull())
        .groupBy("table_key", "key_name", "is_primary_key", "is_unique")
        .agg(F.sort_array(F.collect_list(F.struct("key_ordinal", "column_name"))).alias("parts"))
        .select(
            "table_key",
            "key_name",
            "is_primary_key",
            "is_unique",
            F.col("parts.column_name").alias("column_names"),
        )
    )


def inventory(
    tables: DataFrame,
    columns: DataFrame,
    keys: DataFrame,
    foreign_keys: DataFrame,
    row_counts: DataFrame,
    wanted: DataFrame | None = None,
    schemas: Iterable[str] | None = None,
) -> DataFrame:
    """One row per table with columns, keys, outgoing foreign keys and row count.

    ``wanted`` restricts to ``(schema_name, table_name)`` pairs, ``schemas`` to schema
    names.  Arrays are bounded by the width of a table.
    """
    if wanted is not None:
        pairs = wanted.select("schema_name", "table_name").distinct()
        tables = tables.join(pairs, ["schema_name", "table_name"], "left_semi")
    if schemas is not None:
        tables = tables.where(F.col("schema_name").isin(*schemas))
    per_columns = columns.groupBy("table_key").agg(
        F.sort_array(
            F.collect_list(
                F.struct("ordinal", "column_name", "native_type", "family", "is_nullable")
            )
        ).alias("columns")
    )
    listed = key_list(keys)
    per_keys = listed.groupBy("table_key").agg(
        F.sort_array(
            F.collect_list(
                F.struct(
                    (~F.col("is_primary_key")).alias("secondary"),
                    "key_name",
                    "is_primary_key",
                    "is_unique",
                    "column_names",
                )
            )
        ).alias("keys")
    )
    per_fks = (
        foreign_keys.withColumn("table_key", F.concat_ws(".", "source_schema", "source_table"))
        .groupBy("table_key")
        .agg(
            F.sort_array(
                F.collect_list(
                    F.struct(
                        "constraint_name", "source_column",
                        "target_schema", "target_table", "target_column",
                    )
                )
            ).alias("foreign_keys")
        )
    )
    joined = (
        tables.join(row_counts, "table_key", "left")
        .join(per_columns, "table_key", "left")
        .join(per_keys, "table_key", "left")
        .join(per_fks, "table_key", "left")
    )

    def or_empty(name: str):
        return F.coalesce(F.col(name), F.array().cast(joined.schema[name].dataType)).alias(name)

    full = joined.select(
        "table_key", "schema_name", "table_name",
        F.coalesce("row_count", F.lit(0)).alias("row_count"),
        or_empty("columns"), or_empty("keys"), or_empty("foreign_keys"),
    )
    return full.withColumn(
        "primary_key",
        F.flatten(
            F.transform(F.filter("keys", lambda k: k["is_primary_key"]), lambda k: k["column_names"])
        ),
    )


def columns_from_declared(declared: DataFrame) -> DataFrame:
    """Columns relation from declared columns, as an information schema lists them.

    Expects ``schema_name, table_name, column_name, native_type, is_nullable ('YES'/'NO'),
    ordinal``; the family follows from the declared type name.
    """
    return declared.select(
        F.concat_ws(".", "schema_name", "table_name").alias("table_key"),
        "schema_name",
        "table_name",
        "column_name",
        "native_type",
        declared_family(F.col("native_type")).alias("family"),
        (F.col("is_nullable") == "YES").alias("is_nullable"),
        F.col("ordinal").cast("int").alias("ordinal"),
    )
