"""Nodes, suggested and confirmed edges, and the review decisions that move them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tieweave.config import Config
from tieweave.functions.scores import response_band
from tieweave.operators.values import rank_values

EDGE_KEY = ("source_key", "source_column", "target_key", "target_column")
DEFAULT_REL_TYPE = "one-to-many"
BEFORE_ALL = -1


def graph_nodes(inventory: DataFrame, connection_id: str, database: str) -> DataFrame:
    """One node per table of an inventory."""
    return inventory.select(
        F.concat_ws(".", F.lit(connection_id), "table_key").alias("node_key"),
        F.lit(connection_id).alias("connection_id"),
        F.lit(database).alias("database"),
        "schema_name",
        "table_name",
        "table_key",
        "row_count",
        F.map_from_entries(
            F.transform("columns", lambda c: F.struct(c["column_name"], c["native_type"]))
        ).alias("columns"),
        F.col("primary_key").alias("primary_keys"),
    )


def fk_edges(foreign_keys: DataFrame, nodes: DataFrame, connection_id: str) -> DataFrame:
    """Declared foreign keys whose two tables are loaded, as confirmed edges."""
    loaded = nodes.select("node_key")
    prefix = F.lit(connection_id)
    edges = foreign_keys.select(
        F.concat_ws(".", prefix, "source_schema", "source_table").alias("source_key"),
        "source_column",
        F.concat_ws(".", prefix, "target_schema", "target_table").alias("target_key"),
        "target_column",
        F.lit(DEFAULT_REL_TYPE).alias("rel_type"),
        F.concat(F.lit("FK: "), "constraint_name").alias("annotation"),
    )
    for end in ("source_key", "target_key"):
        edges = edges.join(loaded.withColumnRenamed("node_key", end), end, "left_semi")
    return edges.select(*EDGE_KEY, "rel_type", "annotation")


def edges_between_nodes(edges: DataFrame, nodes: DataFrame, by: str = "table_key") -> DataFrame:
    """Replace the table names of ``edges`` by node keys.

    Edges without both nodes go, and so do those with a name that several nodes have, as
    nothing says which is meant: see ``ambiguous_edges``.
    """
    keys = _nodes_by_name(nodes, by).where("nodes = 1").select(by, "node_key")
    out = edges
    for end in ("source", "target"):
        side = keys.select(F.col(by).alias(f"{end}_table"), F.col("node_key").alias(f"{end}_key"))
        out = out.join(side, f"{end}_table")
    rest = [c for c in edges.columns if c not in ("source_table", "target_table", *EDGE_KEY)]
    return out.select(*EDGE_KEY, *rest)


def _nodes_by_name(nodes: DataFrame, by: str) -> DataFrame:
    """One row per name: how many nodes have it, and one of them."""
    return nodes.groupBy(by).agg(F.count_distinct("node_key").alias("nodes"), F.min("node_key").alias("node_key"))


def ambiguous_edges(edges: DataFrame, nodes: DataFrame, by: str = "table_key") -> DataFrame:
    """Edges that name a table which several nodes have, with the numbers of nodes of both ends."""
    counts = _nodes_by_name(nodes, by)
    out = edges
    for end in ("source", "target"):
        side = counts.select(F.col(by).alias(f"{end}_table"), F.col("nodes").alias(f"{end}_nodes"))
        out = out.join(side, f"{end}_table", "left")
    return out.where("source_nodes > 1 OR target_nodes > 1").select(
        *edges.columns, *[F.coalesce(f"{end}_nodes", F.lit(0)).alias(f"{end}_nodes") for end in ("source", "target")]
    )


def add_suggestions(existing: DataFrame, new: DataFrame, order: str) -> DataFrame:
    """Add edges that are not there yet; of new duplicates the first by ``order`` stays."""
    fresh = new.join(existing.select(*EDGE_KEY), list(EDGE_KEY), "left_anti")
    fresh = rank_values(fresh, EDGE_KEY, [F.col(order).asc()], 1).drop("rank", order)
    return existing.unionByName(fresh)


def decisions_for(edges: DataFrame, action: str, first_seq: int = 0) -> DataFrame:
    """One decision per edge, for bulk approval or denial.

    They are one step, so all have the same ``seq``: no edge is in it twice.
    """
    return edges.select(*EDGE_KEY).distinct().select(
        F.lit(first_seq).cast("long").alias("seq"),
        F.lit(action).alias("action"),
        *EDGE_KEY,
        F.lit(DEFAULT_REL_TYPE).alias("rel_type"),
        F.lit("").alias("annotation"),
        F.lit(None).cast("string").alias("node_key"),
    )


def _last_per(decisions: DataFrame, action: str, *keys: str) -> DataFrame:
    return decisions.where(F.col("action") == action).groupBy(*keys).agg(F.max("seq").alias("last_seq"))


def apply_decisions(
    suggested: DataFrame, confirmed: DataFrame, decisions: DataFrame, by_column: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Fold a log of decisions into the suggested and confirmed edges.

    ``decisions`` has ``seq`` (their order), ``action`` and what it acts on:

    * ``confirm`` takes the pair out of the suggestions and adds or overwrites it,
    * ``dismiss`` takes the pair out of the suggestions,
    * ``remove_edge`` drops the confirmed edges of the table pair (of the column pair
      with ``by_column``),
    * ``remove_table`` drops every edge that touches ``node_key``.

    An edge confirmed again after a removal is there again.  Each part is reduced to one
    row per key before it is joined, so a pair or table with most of the log is no
    burden for one task.
    """
    settled = decisions.where(F.col("action").isin("confirm", "dismiss")).select(*EDGE_KEY).distinct()
    gone = _last_per(decisions, "remove_table", "node_key")
    kept = suggested.join(settled, list(EDGE_KEY), "left_anti")
    for end in ("source_key", "target_key"):
        kept = kept.join(gone.select(F.col("node_key").alias(end)), end, "left_anti")
    kept = kept.select(*suggested.columns)

    payload = ("rel_type", "annotation")
    history = confirmed.select(F.lit(BEFORE_ALL).cast("long").alias("seq"), *EDGE_KEY, *payload).unionByName(
        decisions.where(F.col("action") == "confirm").select(
            "seq", *EDGE_KEY,
            F.coalesce("rel_type", F.lit(DEFAULT_REL_TYPE)).alias("rel_type"),
            F.coalesce("annotation", F.lit("")).alias("annotation"),
        )
    )
    latest = rank_values(history, EDGE_KEY, [F.col("seq").desc()], 1).drop("rank")
    pair = EDGE_KEY if by_column else ("source_key", "target_key")
    removals = [_last_per(decisions, "remove_edge", *pair).withColumnRenamed("last_seq", "edge_gone")]
    for end in ("source_key", "target_key"):
        removals.append(gone.select(F.col("node_key").alias(end), F.col("last_seq").alias(f"{end}_gone")))
    alive = latest
    for removal, keys in zip(removals, (list(pair), ["source_key"], ["target_key"])):
        alive = alive.join(removal, keys, "left")
    last_removal = F.greatest(
        F.coalesce("edge_gone", F.lit(BEFORE_ALL - 1)),
        F.coalesce("source_key_gone", F.lit(BEFORE_ALL - 1)),
        F.coalesce("target_key_gone", F.lit(BEFORE_ALL - 1)),
    )
    return kept, alive.where(F.col("seq") > last_removal).select(*EDGE_KEY, *payload)


def remaining_nodes(nodes: DataFrame, decisions: DataFrame) -> DataFrame:
    gone = decisions.where(F.col("action") == "remove_table").select("node_key").distinct()
    return nodes.join(gone, "node_key", "left_anti")


def annotate(annotations: DataFrame, notes: DataFrame) -> DataFrame:
    """Annotations after notes ``(key, text, seq)``; the last note on a key wins."""
    latest = rank_values(notes, ("key",), [F.col("seq").desc()], 1).select("key", "text")
    return annotations.select("key", "text").join(latest, "key", "left_anti").unionByName(latest)


def _named(edited: DataFrame) -> DataFrame:
    return edited.withColumnRenamed("source", "source_table").withColumnRenamed("target", "target_table")


def _names(nodes: DataFrame) -> DataFrame:
    names = F.array(F.substring_index("node_key", ".", -1), F.col("node_key"))
    return nodes.select(F.explode(F.array_distinct(names)).alias("name"), "node_key")


def ambiguous_edits(edited: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows of an edited table that ``confirmed_from_edit`` cannot place for certain."""
    rows = ambiguous_edges(_named(edited), _names(nodes), by="name")
    return rows.withColumnRenamed("source_table", "source").withColumnRenamed("target_table", "target")


def confirmed_from_edit(edited: DataFrame, nodes: DataFrame) -> DataFrame:
    """Confirmed edges rebuilt from an edited table that names tables shortly.

    ``edited`` has ``source, source_column, target, target_column, rel_type, annotation``
    and ``seq`` for the order of rows; of equal pairs the last row wins.  A name is the last
    part of a node's key or the whole key; rows with a name that several nodes have are
    left to ``ambiguous_edits``.
    """
    placed = edges_between_nodes(_named(edited), _names(nodes), by="name")
    return rank_values(placed, EDGE_KEY, [F.col("seq").desc()], 1).select(*EDGE_KEY, "rel_type", "annotation")


def from_responses(relationships: DataFrame, nodes: DataFrame, config: Config = Config()) -> DataFrame:
    """Suggested edges from relationships read out of responses."""
    placed = edges_between_nodes(relationships, nodes)
    return placed.select(
        *EDGE_KEY, "confidence",
        response_band(F.col("confidence"), config.band_high, config.band_medium).alias("confidence_band"),
        F.struct(F.lit("ai").alias("source"), "reasoning", "rel_type").alias("evidence"),
        *[c for c in ("batch_id", "position") if c in relationships.columns],
    )


def review_filter(
    edges: DataFrame,
    origin: str = "all",
    band: str = "all",
    table: str = "",
    config: Config = Config(),
) -> DataFrame:
    """Suggested edges by origin (all, ai, pipeline), band (all, high, medium, low), table."""
    rows = edges
    if origin != "all":
        is_ai = F.coalesce(F.col("origin") == "ai", F.lit(False))
        rows = rows.where(is_ai if origin == "ai" else ~is_ai)
    score = F.col("confidence")
    bands = {
        "high": score >= config.band_high,
        "medium": (score >= config.band_medium) & (score < config.band_high),
        "low": score < config.band_medium,
    }
    if band != "all":
        rows = rows.where(bands[band])
    text = table.strip().lower()
    if text:
        rows = rows.where(
            F.contains(F.lower("source_key"), F.lit(text)) | F.contains(F.lower("target_key"), F.lit(text))
        )
    return rows


def visible_edges(edges: DataFrame, floor: float = 0.0, limit: int | None = None) -> DataFrame:
    """The edges above a confidence floor, best first: all, or the first ``limit``."""
    rows = edges.where(F.col("confidence") >= floor).orderBy(F.desc("confidence"), *EDGE_KEY)
    return rows if limit is None else rows.limit(max(limit, 0))
