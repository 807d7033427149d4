"""Any number of inventory snapshots as intervals in which a column or table stays the same."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tieweave.operators.drift import column_changes

COLUMN_KEY, COLUMN_STATE = ("table_key", "column_name"), ("data_type", "is_nullable")
TABLE_KEY, TABLE_STATE = ("table_key",), ("row_count",)


def intervals(snapshots: DataFrame, versions: DataFrame, key: tuple[str, ...], state: tuple[str, ...]) -> DataFrame:
    """(key, state, valid_from, valid_to) out of ``snapshots`` (version, key, state).

    ``versions`` (version) are the snapshots taken, so that one without any row counts as well.
    ``valid_to`` is the first version in which the state no longer holds; null while it holds in the last one.
    A key that goes away and comes back has two intervals.  A key stands in a version once; of
    repeated rows the least state counts.  A state may be null, which is a state like others.

    Versions are numbered in one task, one row for each snapshot.  All else meets by key in one shuffle and
    one sort, and a key has one row for each snapshot: its islands are read off its neighbours.
    """
    order = Window.orderBy("version")
    numbered = versions.select("version").distinct().select(
        "version", F.row_number().over(order).alias("_at"), F.lead("version").over(order).alias("_next")
    )
    rows = snapshots.select("version", *key, F.struct(*state).alias("_state")).join(F.broadcast(numbered), "version")
    # The sort of this window is that of all that follow.
    repeated = F.lag("_at").over(Window.partitionBy(*key).orderBy("_at", "_state")).eqNullSafe(F.col("_at"))
    rows = rows.withColumn("_repeated", repeated).where("NOT _repeated")
    mine = Window.partitionBy(*key).orderBy("_at")

    def breaks(neighbour: Callable[[str], Column], step: int) -> Column:
        same = neighbour("_state").over(mine).eqNullSafe(F.col("_state"))
        return ~F.coalesce(same & (neighbour("_at").over(mine) == F.col("_at") + step), F.lit(False))

    ends = rows.withColumn("_starts", breaks(F.lag, -1)).withColumn("_ends", breaks(F.lead, 1)).where("_starts OR _ends")
    # An island is one row now, or its first and its last.
    until = F.when(F.col("_ends"), F.col("_next")).otherwise(F.lead("_next").over(mine))
    return ends.withColumn("valid_to", until).where("_starts").select(
        *key, *[F.col("_state")[name].alias(name) for name in state], F.col("version").alias("valid_from"), "valid_to"
    )


def column_history(columns: DataFrame, versions: DataFrame) -> DataFrame:
    return intervals(columns, versions, COLUMN_KEY, COLUMN_STATE)


def table_history(tables: DataFrame, versions: DataFrame) -> DataFrame:
    return intervals(tables, versions, TABLE_KEY, TABLE_STATE)


def extended(history: DataFrame, snapshot: DataFrame, version: int, key: tuple[str, ...], state: tuple[str, ...]) -> DataFrame:
    """``history`` with one later ``snapshot`` (key, state) folded in.

    Only open intervals meet the snapshot, in one shuffle by key; closed ones pass through as they are.
    Keys are not null.  A version that the history already has gives the history unchanged if the snapshot is the same.
    """
    open_ = history.where(F.col("valid_to").isNull())
    new = snapshot.repartition(*key).groupBy(*key).agg(F.min(F.struct(*state)).alias("_new"))
    old = open_.select(*key, F.struct(*state).alias("_old"), "valid_from")
    met = old.join(new, list(key), "full")
    lasting = F.col("_old").eqNullSafe(F.col("_new"))
    at_type = history.schema["valid_from"].dataType
    at = F.lit(version).cast(at_type)
    nothing = F.lit(None).cast(at_type)
    interval = lambda of, begin, end: F.struct(of.alias("_state"), begin.alias("valid_from"), end.alias("valid_to"))
    kept = interval(F.col("_old"), F.col("valid_from"), F.when(lasting, nothing).otherwise(at))
    added = interval(F.col("_new"), at, nothing)
    rows = F.array_compact(
        F.array(
            F.when(F.col("_old").isNotNull(), kept),
            F.when(F.col("_new").isNotNull() & ~lasting, added),
        )
    )
    folded = met.select(*key, F.inline(rows)).select(
        *key, *[F.col("_state")[name].alias(name) for name in state], "valid_from", "valid_to"
    )
    return history.where(F.col("valid_to").isNotNull()).select(*folded.columns).unionByName(folded)


def as_of(history: DataFrame, version: int) -> DataFrame:
    """The rows of one version, without their interval."""
    holds = (F.col("valid_from") <= version) & (F.col("valid_to").isNull() | (F.col("valid_to") > version))
    return history.where(holds).drop("valid_from", "valid_to")


def changes_between(tables: DataFrame, columns: DataFrame, later: int, earlier: int) -> DataFrame:
    """``drift.column_changes`` of any two versions, read from the two histories.

    Intervals that hold in both versions can't have changed: they are left out before the join.
    """
    in_one = (F.col("valid_from") > earlier) | (F.col("valid_to") <= later)
    moved = columns.where(in_one)
    return column_changes(
        as_of(tables, later), as_of(moved, later), as_of(tables, earlier), as_of(moved, earlier)
    )
