"""Differences between two inventories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def snapshot_tables(inventory: DataFrame) -> DataFrame:
    return inventory.select("table_key", "schema_name", "table_name", "row_count")


def snapshot_columns(inventory: DataFrame) -> DataFrame:
    return inventory.select("table_key", F.inline("columns")).select(
        "table_key", "column_name", F.col("native_type").alias("data_type"), "is_nullable",
        F.col("ordinal").alias("ordinal_position"),
    )


def _sides(current: DataFrame, previous: DataFrame) -> DataFrame:
    return current.withColumn("is_new", F.lit(True)).unionByName(previous.withColumn("is_new", F.lit(False)))


def column_changes(
    current_tables: DataFrame, current: DataFrame, previous_tables: DataFrame, previous: DataFrame
) -> DataFrame:
    """One row per changed column of the tables in both snapshots.

    A column may change its type and its nullability at once, which gives two rows.  Both
    snapshots are one union with the side on each row, so each is read once.  Columns are dealt out by
    their table, so that they are grouped and meet the tables of both in one shuffle and one sort.
    """
    is_new, fields = F.col("is_new"), ("data_type", "is_nullable")
    tables = _sides(current_tables.select("table_key"), previous_tables.select("table_key"))
    common = tables.groupBy("table_key").agg(
        F.bool_or("is_new").alias("is_now"), F.bool_or(~is_new).alias("was")
    ).where("is_now AND was")
    columns = ("table_key", "column_name", *fields)
    sides = _sides(current.select(*columns), previous.select(*columns)).repartition("table_key")
    both = sides.groupBy("table_key", "column_name").agg(
        *[
            F.max(F.when(side, F.col(field))).alias(f"{when}_{short}")
            for when, side in (("new", is_new), ("old", ~is_new))
            for field, short in zip(fields, ("type", "null"))
        ]
    ).join(common.select("table_key"), "table_key", "left_semi")

    def change(kind: str, old_value, new_value):
        text = "string"
        return F.struct(
            F.lit(kind).alias("change_type"),
            old_value.cast(text).alias("old_value"),
            new_value.cast(text).alias("new_value"),
        )

    def flag(value):
        return F.when(value, "True").otherwise("False")

    nothing = F.lit(None)
    added, removed = F.col("old_type").isNull(), F.col("new_type").isNull()
    kept = ~added & ~removed
    found = F.array_compact(
        F.array(
            F.when(added, change("added", nothing, F.col("new_type"))),
            F.when(removed, change("removed", F.col("old_type"), nothing)),
            F.when(
                kept & (F.col("old_type") != F.col("new_type")),
                change("type_changed", F.col("old_type"), F.col("new_type")),
            ),
            F.when(
                kept & (F.col("old_null") != F.col("new_null")),
                change("nullability_changed", flag(F.col("old_null")), flag(F.col("new_null"))),
            ),
        )
    )
    return both.select("table_key", "column_name", F.inline(found))


def table_verdicts(current_tables: DataFrame, previous_tables: DataFrame, changes: DataFrame) -> DataFrame:
    """Verdict per table: new, removed, columns_changed, row_count_changed or unchanged.

    Tables of both snapshots and their changes are one union, grouped once.
    """
    is_new = F.col("is_new")
    tables = _sides(current_tables.select("table_key", "row_count"), previous_tables.select("table_key", "row_count"))
    changed = changes.select(
        "table_key", F.lit(None).cast("long").alias("row_count"), F.lit(None).cast("boolean").alias("is_new")
    )
    rows = tables.unionByName(changed).groupBy("table_key").agg(
        F.max(F.when(is_new, True)).alias("is_now"),
        F.max(F.when(~is_new, True)).alias("was"),
        F.max(F.when(is_new, F.col("row_count"))).alias("new_row_count"),
        F.max(F.when(~is_new, F.col("row_count"))).alias("old_row_count"),
        F.count_if(is_new.isNull()).alias("column_change_count"),
    )
    before, after = F.coalesce("old_row_count", F.lit(0)), F.coalesce("new_row_count", F.lit(0))
    verdict = (
        F.when(F.col("was").isNull(), "new")
        .when(F.col("is_now").isNull(), "removed")
        .when(F.col("column_change_count") > 0, "columns_changed")
        .when(before != after, "row_count_changed")
        .otherwise("unchanged")
    )
    lasting = F.col("was").isNotNull() & F.col("is_now").isNotNull()
    return rows.select(
        "table_key",
        verdict.alias("verdict"),
        F.coalesce("column_change_count", F.lit(0)).alias("column_change_count"),
        F.when(lasting, before).otherwise(F.lit(0)).alias("old_row_count"),
        F.when(lasting, after).otherwise(F.lit(0)).alias("new_row_count"),
    )


def drift_summary(verdicts: DataFrame) -> DataFrame:
    """Counts of the report; a removed table counts among the changed ones too."""
    kind = F.col("verdict")
    return verdicts.agg(
        F.count_if(kind == "new").alias("new_tables"),
        F.count_if(kind == "removed").alias("removed_tables"),
        F.count_if(kind.isin("removed", "columns_changed", "row_count_changed")).alias("changed_tables"),
        F.count_if(kind == "unchanged").alias("unchanged_tables"),
    ).withColumn(
        "has_drift", (F.col("new_tables") + F.col("removed_tables") + F.col("changed_tables")) > 0
    )
