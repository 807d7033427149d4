"""Column profiles and overlaps by stored sketches: an explicit mode beside the exact one.

A theta sketch of a column's typed keys has a fixed size, is built in each task and merged without a shuffle
of values.  Sketches of parts of a table add up to that of the whole, so a new file is scanned alone.
Counts of rows and of values are exact; numbers of distinct values are so below half the sketch's nominal size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tieweave.functions.scores import ratio
from tieweave.operators.values import TABLES_PER_PLAN, VALUE_KEYS, exploded, has_value
from tieweave.session import materialize
from tieweave.sources.catalog import Catalog

#: Nominal entries of a sketch are two to this power: a standard error of 0.8 %, 128 KB a sketch at most.
LG_ENTRIES = 14
SKETCHED = "file string, column_name string, row_count long, non_null_count long, sketch binary"


def key_hash() -> Column:
    """64 bits of a typed key and its kind; null for a null value.  Equal values of different types meet."""
    kinds = [F.when(F.col(key).isNotNull(), F.xxhash64(F.lit(n), F.col(key))) for n, key in enumerate(VALUE_KEYS)]
    return F.coalesce(*kinds)


def _sketched(values: DataFrame, *by: str) -> DataFrame:
    return values.groupBy(*by).agg(
        F.count("*").alias("row_count"),
        F.count(F.when(has_value(), 1)).alias("non_null_count"),
        F.theta_sketch_agg(key_hash(), LG_ENTRIES).alias("sketch"),
    )


def column_sketches(catalog: Catalog) -> DataFrame:
    """(col_id, row_count, non_null_count, sketch) of every column, by one scan of each table.

    A column of an empty table has no row.
    """
    by_table: dict[str, list[dict]] = {}
    for column in catalog.column_rows():
        by_table.setdefault(column["table_key"], []).append(column)
    if not by_table:
        return catalog.spark.createDataFrame([], "col_id int, row_count long, non_null_count long, sketch binary")
    scans = [_sketched(exploded(catalog.tables[key], columns, False), "col_id") for key, columns in by_table.items()]
    batches = [reduce(DataFrame.unionByName, scans[i : i + TABLES_PER_PLAN]) for i in range(0, len(scans), TABLES_PER_PLAN)]
    return reduce(DataFrame.unionByName, [materialize(batch, "sketches") for batch in batches])


def fold_files(spark: SparkSession, folder: str, store: str) -> int:
    """Adds the sketches of those Parquet files of ``folder`` to ``store`` that it doesn't have; returns their number.

    Only new files are read.  They are added in one write, so a fold that fails adds none, and one that is
    repeated finds nothing new.  Files are taken to stay as they are.  One fold at a time.
    """
    table = spark.read.parquet(folder)
    names = [n for n in table.columns if n != "_file"]
    done = {r.file for r in stored(spark, store).select("file").distinct().collect()}
    new = [path for path in table.inputFiles() if path not in done]
    if not new:
        return 0
    columns = [{"col_id": n, "column_name": name} for n, name in enumerate(names)]
    rows = spark.read.schema(table.schema).parquet(*new).select("*", F.col("_metadata.file_path").alias("_file"))
    by_file = _sketched(exploded(rows, columns, False, keep=["_file"]), "_file", "col_id")
    listed = F.element_at(F.array(*[F.lit(name) for name in names]), F.col("col_id") + 1)
    added = by_file.select(
        F.col("_file").alias("file"), listed.alias("column_name"), "row_count", "non_null_count", "sketch"
    )
    # An empty file has no rows to sketch, but is known from now on.
    empty = spark.createDataFrame([(path,) for path in new], "file string").join(added.select("file").distinct(), "file", "left_anti")
    added.unionByName(empty, allowMissingColumns=True).write.mode("append").parquet(store)
    return len(new)


def stored(spark: SparkSession, store: str) -> DataFrame:
    """The rows of a store, none if it is not there yet."""
    try:
        return spark.read.schema(SKETCHED).parquet(store)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], SKETCHED)


def merged(sketches: DataFrame, *by: str) -> DataFrame:
    """One sketch for each of ``by`` out of those of its parts."""
    return sketches.where(F.col("sketch").isNotNull()).groupBy(*by).agg(
        F.sum("row_count").alias("row_count"), F.sum("non_null_count").alias("non_null_count"),
        F.theta_union_agg("sketch", LG_ENTRIES).alias("sketch"),
    )


def is_exact(estimate: Column) -> Column:
    """Whether a number of distinct values is none of a sample's: a sketch samples beyond its nominal size only."""
    return estimate < (1 << LG_ENTRIES) // 2


def estimated_profiles(sketches: DataFrame) -> DataFrame:
    """Adds to rows with a sketch: distinct_estimate, exact, null_ratio, unique_ratio, and the mode ``estimate``."""
    distinct = F.theta_sketch_estimate("sketch")
    return sketches.select(
        *[c for c in sketches.columns if c != "sketch"],
        distinct.alias("distinct_estimate"),
        is_exact(distinct).alias("exact"),
        ratio(F.col("row_count") - F.col("non_null_count"), F.col("row_count")).alias("null_ratio"),
        F.least(F.lit(1.0), ratio(distinct, F.col("non_null_count"))).alias("unique_ratio"),
        F.lit("estimate").alias("mode"),
    )


def estimated_overlaps(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """(source_col, target_col, shared_estimate, union_estimate, exact) for ``pairs`` of column ids.

    Two sketches are met for each pair, no values.  Pairs with a column without a sketch are left out.
    """
    side = lambda end: sketches.select(F.col("col_id").alias(f"{end}_col"), F.col("sketch").alias(end))
    met = pairs.select("source_col", "target_col").join(side("source"), "source_col").join(side("target"), "target_col")
    shared = F.theta_sketch_estimate(F.theta_intersection("source", "target"))
    union = F.theta_sketch_estimate(F.theta_union("source", "target", LG_ENTRIES))
    return met.select(
        "source_col", "target_col", shared.alias("shared_estimate"), union.alias("union_estimate"),
        is_exact(union).alias("exact"),
    )
