"""Graphs kept side by side: lists, copies, versions, confirmations and promotion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tieweave.config import Config
from tieweave.functions.text import edge_key, node_parts
from tieweave.operators.edges import EDGE_KEY
from tieweave.operators.responses import one_description
from tieweave.operators.values import rank_values
from tieweave.session import materialize

SIGNATURE = ("source_table_key", "source_column", "target_table_key", "target_column")


def graph_list(
    graphs: DataFrame, kind: str = "all", text: str = "", domain_tag: str | None = None
) -> DataFrame:
    """Graphs by kind (all, template, fork), text and domain; templates first, then newest."""
    rows = graphs
    if kind == "template":
        rows = rows.where("is_template")
    elif kind == "fork":
        rows = rows.where(F.col("parent_graph_id").isNotNull())
    if domain_tag:
        rows = rows.where(F.col("domain_tag") == domain_tag)
    needle = text.strip().lower()
    if needle:
        found = F.lit(False)
        for name in ("name", "description", "database_server"):
            found = found | F.contains(F.lower(name), F.lit(needle))
        rows = rows.where(found)
    return rows.orderBy(F.desc("is_template"), F.desc("updated_at"), "id")


def of_graph(rows: DataFrame, graph_id: str) -> DataFrame:
    """Rows of one graph; a table partitioned by ``graph_id`` is pruned to it."""
    return rows.where(F.col("graph_id") == graph_id)


def upsert(existing: DataFrame, incoming: DataFrame, key: str = "id", keep: tuple[str, ...] = ()) -> DataFrame:
    """Incoming rows replace those with the same key; the columns in ``keep`` never change.

    ``incoming`` holds each key once.
    """
    old = existing.select(key, *[F.col(c).alias(f"old_{c}") for c in keep])
    merged = incoming.join(old, key, "left").select(
        *[F.coalesce(f"old_{c}", c).alias(c) if c in keep else F.col(c) for c in existing.columns]
    )
    return existing.join(incoming.select(key), key, "left_anti").select(*existing.columns).unionByName(merged)


def save_graphs(graphs: DataFrame, incoming: DataFrame) -> DataFrame:
    return upsert(graphs, incoming, keep=("created_by", "created_at"))


def delete_graphs(rows: DataFrame, doomed: DataFrame, key: str = "graph_id") -> DataFrame:
    """Rows without those of the graphs in ``doomed(graph_id)``."""
    return rows.join(doomed.select(F.col("graph_id").alias(key)).distinct(), key, "left_anti").select(*rows.columns)


def stored_nodes(nodes: DataFrame, graph_id: str, descriptions: DataFrame | None = None) -> DataFrame:
    """Nodes of the current graph as rows of the store, with descriptions per column."""
    parts = node_parts(F.col("node_key"))
    rows = nodes.select(
        F.concat_ws(":", F.lit(graph_id), "node_key").alias("id"),
        F.lit(graph_id).alias("graph_id"),
        parts["connection_id"].alias("connection_id"),
        parts["schema_name"].alias("schema_name"),
        parts["table_name"].alias("table_name"),
        "row_count",
        "columns",
    )
    nothing = F.create_map().cast("map<string,string>")
    if descriptions is None:
        return rows.withColumn("descriptions", nothing)
    per_table = one_description(descriptions).groupBy(F.col("table").alias("described")).agg(
        F.map_from_entries(F.collect_list(F.struct("column", "description"))).alias("descriptions")
    )
    return (
        rows.join(per_table, F.concat_ws(".", "schema_name", "table_name") == F.col("described"), "left")
        .drop("described")
        .withColumn("descriptions", F.coalesce("descriptions", nothing))
    )


def stored_edges(confirmed: DataFrame, graph_id: str) -> DataFrame:
    """Confirmed edges of the current graph as rows of the store."""
    return confirmed.select(
        F.concat_ws(":", F.lit(graph_id), edge_key(*EDGE_KEY)).alias("id"),
        F.lit(graph_id).alias("graph_id"),
        F.col("source_key").alias("source_table_key"),
        "source_column",
        F.col("target_key").alias("target_table_key"),
        "target_column",
        F.lit("confirmed").alias("edge_type"),
        F.lit(1.0).alias("confidence"),
        "rel_type",
        F.coalesce("annotation", F.lit("")).alias("annotation"),
        F.lit("user").alias("origin"),
        F.lit(0).cast("long").alias("confirmed_by_count"),
    )


def fork_graph(
    graphs: DataFrame, nodes: DataFrame, edges: DataFrame, source_id: str, new_id: str, name: str, created_by: str
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A copy of one graph under a new id, at version 1 and with its origin noted.

    Row ids derive from the new graph and the old id, so a recomputed task yields the
    same rows.
    """
    graph = (
        graphs.where(F.col("id") == source_id)
        .withColumn("id", F.lit(new_id))
        .withColumn("name", F.lit(name))
        .withColumn("created_by", F.lit(created_by))
        .withColumn("version", F.lit(1).cast(graphs.schema["version"].dataType))
        .withColumn("is_template", F.lit(False))
        .withColumn("parent_graph_id", F.lit(source_id))
    )

    def copied(rows: DataFrame) -> DataFrame:
        return (
            of_graph(rows, source_id)
            .withColumn("id", F.concat_ws(":", F.lit(new_id), "id"))
            .withColumn("graph_id", F.lit(new_id))
        )

    return graph, copied(nodes), copied(edges)


def next_versions(graphs: DataFrame, snapshots: DataFrame, edited: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Raise the version of edited graphs and append a snapshot of each.

    ``edited`` has ``graph_id`` and ``snapshot``, the state to keep.
    """
    raised = graphs.join(edited.select(F.col("graph_id").alias("id")), "id", "left_semi").withColumn(
        "version", F.col("version") + 1
    )
    taken = raised.join(edited, raised["id"] == edited["graph_id"]).select("graph_id", "version", "snapshot")
    return upsert(graphs, raised), snapshots.unionByName(taken)


def latest_snapshots(snapshots: DataFrame) -> DataFrame:
    """The snapshot with the highest version of each graph."""
    return rank_values(snapshots, ("graph_id",), [F.col("version").desc()], 1).drop("rank")


def record_confirmations(edges: DataFrame, confirmers: DataFrame, log: DataFrame) -> DataFrame:
    """Edges of all graphs with their confirmation counts after a log of confirmations.

    A session that confirms a signature counts once for every edge with it, beside the
    sessions the edge already had: ``confirmers(edge_id, session_id)``.  ``edges`` holds each
    id once.  Sessions are kept as rows and counted, never gathered into a list, so a signature
    confirmed by everyone costs no more than its rows.

    What the log confirms is written once, with a number for each signature: as written tables
    they are broadcast if small, and only that number goes along when edges meet sessions by id.
    """
    fresh = materialize(log.select(*SIGNATURE, "session_id").distinct(), "fresh")
    per_signature = fresh.groupBy(*SIGNATURE).agg(F.count(F.lit(1)).alias("from_log"))
    per_signature = materialize(per_signature.withColumn("signature", F.monotonically_increasing_id()), "signatures")
    numbers = per_signature.select(*SIGNATURE, "signature")
    known = materialize(fresh.join(numbers, list(SIGNATURE)).select("signature", "session_id"), "known")
    confirmed = edges.join(numbers, list(SIGNATURE)).select(F.col("id").alias("edge_id"), "signature")
    only_own = (
        confirmers.select("edge_id", "session_id").repartition("edge_id").distinct()
        .join(confirmed, "edge_id")
        .join(known, ["signature", "session_id"], "left_anti")
        .groupBy(F.col("edge_id").alias("id"))
        .agg(F.count(F.lit(1)).alias("only_own"))
    )
    rows = edges.join(per_signature.drop("signature"), list(SIGNATURE), "left").join(only_own, "id", "left")
    counted = F.col("from_log") + F.coalesce("only_own", F.lit(0))
    return rows.withColumn("confirmed_by_count", F.coalesce(counted, F.col("confirmed_by_count"))).select(
        *edges.columns
    )


def graph_confirmers(edges: DataFrame, confirmers: DataFrame, log: DataFrame, graph_id: str) -> DataFrame:
    """Sessions behind each edge of one graph after the log, one row each.

    A graph holds a signature once, so the rows are those of the log at most; over all
    graphs they would be every edge times every session of a signature.
    """
    own_edges = of_graph(edges, graph_id).select(F.col("id").alias("edge_id"), *SIGNATURE)
    had = confirmers.join(own_edges.select("edge_id"), "edge_id", "left_semi").select("edge_id", "session_id")
    added = log.select(*SIGNATURE, "session_id").distinct().join(own_edges, list(SIGNATURE))
    return had.unionByName(added.select("edge_id", "session_id")).distinct()


def confirmation_counts(edges: DataFrame) -> DataFrame:
    """Highest confirmation count of each signature over all graphs."""
    return edges.groupBy(*SIGNATURE).agg(F.max("confirmed_by_count").alias("confirmations"))


def promoted_edges(edges: DataFrame, graph_id: str, threshold: int = Config.promotion_threshold) -> DataFrame:
    """Edges other graphs confirmed often enough and this graph lacks, one per signature."""
    # One graph's signatures, written so that their size is known and the others need no shuffle to meet them.
    here = materialize(of_graph(edges, graph_id).select(*SIGNATURE).distinct(), "here")
    others = edges.where((F.col("graph_id") != graph_id) & (F.col("confirmed_by_count") >= threshold))
    missing = others.join(here, list(SIGNATURE), "left_anti")
    best = [F.col("confirmed_by_count").desc(), F.col("id").asc()]
    return rank_values(missing, SIGNATURE, best, 1).select(*edges.columns)


def context_edges(nodes: DataFrame, edges: DataFrame, max_tables: int | None = None) -> DataFrame:
    """Edges whose two tables are nodes of the graph, or among its first ``max_tables`` by name."""
    table = F.concat_ws(".", "schema_name", "table_name").alias("full_table_name")
    chosen = nodes.select(table).distinct()
    if max_tables is not None:
        chosen = chosen.orderBy("full_table_name").limit(max_tables)
    out = edges
    for end in ("source_table_key", "target_table_key"):
        out = out.join(chosen.withColumnRenamed("full_table_name", end), end, "left_semi")
    return out.select(*edges.columns)
