"""Reports and saved state as folders of JSON lines, one dataset per relation.

A report is not gathered into one document: each list is written by the tasks that
hold it, so its length is no concern of the driver.
"""

from __future__ import annotations

from typing import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tieweave.operators.responses import one_description
from tieweave.session import materialize

# Versions of the formats, and the defaults of fields that an edge lacks.
REPORT_VERSION = "1.0.0"
SAVE_VERSION = "0.1.0"

EDGE_DEFAULTS = {
    "confirmed": {"source_column": "", "target_column": "", "rel_type": "one-to-many", "annotation": ""},
    "suggested": {"source_column": "", "target_column": "", "confidence": 0.0, "confidence_band": "low"},
}


def summary(nodes: DataFrame, confirmed: DataFrame, suggested: DataFrame) -> DataFrame:
    """One row with the counts of a report."""
    parts = [
        frame.select(F.lit(name).alias("part"))
        for name, frame in (("table", nodes), ("confirmed", confirmed), ("suggested", suggested))
    ]
    part = F.col("part")
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).agg(
        F.count_if(part == "table").alias("table_count"),
        F.count_if(part == "confirmed").alias("confirmed_relationship_count"),
        F.count_if(part == "suggested").alias("suggested_relationship_count"),
    )


def tables(nodes: DataFrame, annotations: DataFrame, descriptions: DataFrame | None = None) -> DataFrame:
    """Tables of a report with their annotation and any column descriptions."""
    notes = annotations.select(F.col("key").alias("node_key"), F.col("text").alias("annotation"))
    rows = nodes.join(notes, "node_key", "left").withColumn("annotation", F.coalesce("annotation", F.lit("")))
    if descriptions is not None:
        described = one_description(descriptions).groupBy(F.col("table").alias("described")).agg(
            F.map_from_entries(F.collect_list(F.struct("column", "description"))).alias("all_descriptions")
        )
        rows = rows.join(described, F.concat_ws(".", "schema_name", "table_name") == F.col("described"), "left")
        known = F.map_filter("all_descriptions", lambda k, v: F.map_contains_key("columns", k))
        rows = rows.withColumn("column_descriptions", known).drop("described", "all_descriptions")
    return rows.orderBy("node_key")


def relationships(confirmed: DataFrame, annotations: DataFrame) -> DataFrame:
    """Confirmed edges of a report with the annotation of their table pair."""
    notes = annotations.select("key", F.col("text").alias("edge_annotation"))
    rows = confirmed.withColumn("key", F.concat_ws("->", "source_key", "target_key")).join(notes, "key", "left")
    return rows.select(
        "source_key", "source_column", "target_key", "target_column",
        F.col("rel_type").alias("relationship_type"), "annotation",
        F.coalesce("edge_annotation", F.lit("")).alias("edge_annotation"),
    )


def write_bundle(folder: str, relations: Mapping[str, DataFrame], mode: str = "errorifexists") -> None:
    """Write each relation as JSON lines below ``folder``."""
    for name, frame in relations.items():
        frame.write.mode(mode).json(f"{folder}/{name}")


def read_relation(spark: SparkSession, folder: str, name: str, schema, defaults: Mapping | None = None) -> DataFrame:
    """Read one relation of a bundle; an absent one is empty, absent fields get defaults."""
    try:
        frame = spark.read.schema(schema).json(f"{folder}/{name}")
    except AnalysisException:
        frame = spark.createDataFrame([], schema)
    return frame.fillna(dict(defaults)) if defaults else frame


def write_report(
    folder: str,
    nodes: DataFrame,
    confirmed: DataFrame,
    suggested: DataFrame,
    annotations: DataFrame,
    title: str,
    databases: DataFrame | None = None,
    descriptions: DataFrame | None = None,
    include_suggested: bool = True,
) -> None:
    shown = suggested if include_suggested else suggested.where(F.lit(False))
    head = summary(nodes, confirmed, shown).select(
        F.lit(REPORT_VERSION).alias("version"), F.lit(title).alias("title"),
        F.current_timestamp().alias("generated_at"), "*",
    )
    relations = {
        "summary": head,
        "tables": tables(nodes, annotations, descriptions),
        "relationships": relationships(confirmed, annotations),
        "suggested_relationships": shown,
        "annotations": annotations,
    }
    if databases is not None:
        relations["databases"] = databases
    write_bundle(folder, relations)


def save_state(
    folder: str,
    connections: DataFrame,
    selected_tables: DataFrame,
    confirmed: DataFrame,
    suggested: DataFrame,
    annotations: DataFrame,
) -> None:
    """Save the state of a review; of a connection only server and database are kept."""
    write_bundle(
        folder,
        {
            "connections": connections.select(F.lit(SAVE_VERSION).alias("version"), "server", "database"),
            "selected_tables": selected_tables,
            "confirmed": confirmed,
            "suggested": suggested,
            "annotations": annotations,
        },
    )


def load_edges(spark: SparkSession, folder: str, kind: str, schema) -> DataFrame:
    """Confirmed or suggested edges of a saved state, with defaults for missing fields."""
    return read_relation(spark, folder, kind, schema, EDGE_DEFAULTS[kind])


def export_graph(folder: str, graph_id: str, graphs: DataFrame, nodes: DataFrame, edges: DataFrame, confirmers: DataFrame) -> None:
    """Write one graph with nodes, edges and the sessions behind the edges.

    Its edges are met twice, so they are written first; confirmers then meet them at their measured size.
    """
    own_edges = materialize(edges.where(F.col("graph_id") == graph_id), "own_edges")
    own_confirmers = confirmers.join(own_edges.select(F.col("id").alias("edge_id")), "edge_id", "left_semi")
    write_bundle(
        folder,
        {
            "graph": graphs.where(F.col("id") == graph_id),
            "nodes": nodes.where(F.col("graph_id") == graph_id),
            "edges": own_edges,
            "confirmers": own_confirmers,
        },
    )


def import_graph(
    spark: SparkSession, folder: str, schemas: Mapping, new_id: str, created_by: str = ""
) -> dict[str, DataFrame]:
    """Read an exported graph back under a new id, with all its fields."""
    parts = {name: read_relation(spark, folder, name, schemas[name]) for name in ("graph", "nodes", "edges", "confirmers")}
    creator = F.lit(created_by) if created_by else F.col("created_by")
    parts["graph"] = parts["graph"].withColumn("id", F.lit(new_id)).withColumn("created_by", creator)
    for name in ("nodes", "edges"):
        parts[name] = (
            parts[name].withColumn("id", F.concat_ws(":", F.lit(new_id), "id")).withColumn("graph_id", F.lit(new_id))
        )
    parts["confirmers"] = parts["confirmers"].withColumn("edge_id", F.concat_ws(":", F.lit(new_id), "edge_id"))
    return parts


def export_conversations(folder: str, turns: DataFrame) -> None:
    """Write turns as JSON lines, in order within and across files.

    The range runs over conversation and turn, so one endless conversation is spread
    over several files.
    """
    turns.repartitionByRange("conv_id", "turn").sortWithinPartitions("conv_id", "turn").write.mode(
        "errorifexists"
    ).json(folder)
