"""The registered queries; each takes ``(spark, sf_dir)`` and reads whole tables."""

from __future__ import annotations

import uuid
from dataclasses import replace
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import given
from tieweave.functions import text
from tieweave.config import Config
from tieweave.functions.scores import string_score
from tieweave.functions.text import short_label
from tieweave.operators import candidates as cand
from tieweave.operators import confirmation_state, drift, edges, estimates, history, overlap, profiles, responses, stored_graphs
from tieweave.operators import strings, talk
from tieweave.operators.values import value_counts
from tieweave.plans.analysis import candidate_columns, run_analysis, score_pairs
from tieweave.plans.loading import load_tables
from tieweave.session import materialize, shared_folder
from tieweave.sources import reports, snapshots
from tieweave.sources.catalog import Catalog
from tieweave.sources.graph_table import GraphTable

# The given names have no aliases among the defaults.
WHOLE = Config()
ALIASES = {"buyer": ("c_custkey", "o_custkey"), "key": ("doc_id", "page_id", "vec_id"), "late": ("vec_id",)}
ONE_GRAPH = "g7"

PROFILE_COLUMNS = (
    "table_name", "column_name", "native_type", "family", "row_count", "non_null_count", "null_count",
    "distinct_count", "null_ratio", "distinct_ratio", "uniqueness_ratio", "min_num", "max_num", "min_ts", "max_ts",
)
EVIDENCE_COLUMNS = (
    *cand.PAIR_KEY, "exact_overlap_count", "exact_overlap_ratio", "normalized_overlap_count",
    "normalized_overlap_ratio", "jaccard", "containment_source_to_target", "containment_target_to_source", "mode",
)
SCORE_COLUMNS = (
    *cand.PAIR_KEY, "match_type", "reason", "name_score", "type_score", "value_score",
    "uniqueness_score", "null_score", "confidence", "confidence_band",
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _flags(name: str = "confidence_flags"):
    return F.array_join(F.array_sort(name), ",").alias(name)


# -- catalogue and profiles


@query
def catalog_columns(spark, sf_dir):
    c = given.catalog(spark, sf_dir)
    rows = c.columns_frame().join(c.row_counts(), "table_key")
    return rows.select("table_key", "column_name", "native_type", "family", "ordinal", "row_count")


@query
def table_inventory(spark, sf_dir):
    rows = given.catalog(spark, sf_dir).inventory()
    return rows.select(
        "table_key", "row_count",
        F.size("columns").alias("column_count"),
        F.array_join("columns.column_name", ",").alias("column_names"),
        F.array_join("primary_key", ",").alias("primary_key"),
        F.array_join(F.transform("foreign_keys", lambda k: k["source_column"]), ",").alias("foreign_key_columns"),
    )


@query
def connected_inventory(spark, sf_dir):
    """The given tables under two connections, in one catalogue."""
    c = given.catalog(spark, sf_dir)
    rows = Catalog.of_connections(spark, {"east": c, "west": c.only(["main.orders", "main.customer"])}).inventory()
    return rows.select(
        "table_key", "schema_name", "row_count", F.array_join("primary_key", ",").alias("primary_key"),
        F.array_join(F.transform("foreign_keys", lambda k: k["target_schema"]), ",").alias("target_schemas"),
    )


@query
def graph_nodes(spark, sf_dir):
    rows = edges.graph_nodes(given.catalog(spark, sf_dir).inventory(), "conn1", "shop")
    return rows.select(
        "node_key", short_label(F.col("node_key")).alias("label"), "database", "table_name", "row_count",
        F.array_join(F.array_sort(F.map_keys("columns")), ",").alias("column_names"),
        F.array_join("primary_keys", ",").alias("primary_keys"),
    )


@query
def foreign_key_edges(spark, sf_dir):
    c = given.catalog(spark, sf_dir)
    loaded = edges.graph_nodes(c.inventory(), "conn1", "shop").where(F.col("row_count") >= 10)
    return edges.fk_edges(c.foreign_keys_frame(), loaded, "conn1")


@query
def table_profile(spark, sf_dir):
    c = given.catalog(spark, sf_dir)
    config = replace(WHOLE, mode_a_max_rows=1000, sample_fraction=0.25)
    return profiles.profiling_modes(c.columns_frame(), c.row_counts(), config).select(
        "table_key", "row_count", "column_count", "string_columns", "profiling_mode", "profiling_note", "sampled"
    )


@query
def column_profile(spark, sf_dir):
    c = given.catalog(spark, sf_dir)
    return profiles.column_profiles(value_counts(c, text_forms=False), c.columns_frame()).select(*PROFILE_COLUMNS)


@query
def estimated_profile(spark, sf_dir):
    """By sketches; numbers of distinct values only where a sketch gives them exactly."""
    c = given.catalog(spark, sf_dir)
    found = c.columns_frame().join(estimates.column_sketches(c), "col_id").select(
        "table_name", "column_name", "row_count", "non_null_count", "sketch"
    )
    return estimates.estimated_profiles(found).select(
        "table_name", "column_name", "row_count", "non_null_count", "null_ratio",
        F.when(F.col("exact"), F.col("distinct_estimate")).alias("distinct_count"),
    )


@query
def estimated_overlap(spark, sf_dir):
    """Values that the ends of each foreign key share, by sketches, where these give them exactly."""
    c = given.catalog(spark, sf_dir)
    columns = c.columns_frame().select("table_name", "column_name", "col_id")
    keys = spark.createDataFrame(list(given.FOREIGN_KEYS), "st string, sc string, tt string, tc string")
    pairs = keys.join(columns.toDF("st", "sc", "source_col"), ["st", "sc"]).join(columns.toDF("tt", "tc", "target_col"), ["tt", "tc"])
    found = estimates.estimated_overlaps(pairs, estimates.column_sketches(c))
    return pairs.join(found, ["source_col", "target_col"]).select(
        F.concat_ws(".", "st", "sc").alias("source"), F.concat_ws(".", "tt", "tc").alias("target"),
        F.when(F.col("exact"), F.col("shared_estimate")).alias("shared_count"),
    )


@query
def top_values(spark, sf_dir):
    c = given.catalog(spark, sf_dir)
    return profiles.top_values(value_counts(c, text_forms=False), c.columns_frame(), c).select(
        "table_name", "column_name", "rank", "cnt", "value_num", "value_ts", "value_str"
    )


@query
def string_profile(spark, sf_dir):
    c = given.catalog(spark, sf_dir)
    ids = [r["col_id"] for r in c.column_rows() if r["family"] == "string"]
    values = materialize(value_counts(c, ids), "values")
    columns = c.columns_frame().where(F.col("family") == "string")
    rows = strings.string_profiles(values, columns, profiles.column_profiles(values, columns), c, WHOLE)
    return rows.select(
        "table_key", "column_name", "total_count", "non_null_count", "distinct_count", "null_ratio", "avg_length",
        "min_length", "max_length", "whitespace_normalized_distinct", "lower_normalized_distinct",
        "normalization_reduces", "is_categorical", "categorical_distinct_count", "is_identifier_like",
        "contains_numbers", "contains_special_chars",
        F.array_join(F.transform("sample_values", lambda s: F.sha2(s, 256)), ",").alias("samples"),
    )


@query
def sample_values(spark, sf_dir):
    c = given.catalog(spark, sf_dir)
    ids = [r["col_id"] for r in c.column_rows() if r["family"] == "string"]
    columns = c.columns_frame()
    rows = strings.sample_values(value_counts(c, ids, text_forms=False), columns, c)
    return columns.join(rows, "col_id").select("table_key", "column_name", "rank", "sample")


@query
def sampled_profile(spark, sf_dir):
    """A quarter of the rows of each table above 1000 rows, by the md5 of the key."""
    c = given.catalog(spark, sf_dir)
    config = replace(WHOLE, mode_a_max_rows=1000, sample_fraction=0.25)
    modes = profiles.profiling_modes(c.columns_frame(), c.row_counts(), config)
    values = value_counts(c, sampled=profiles.sampled_scans(c, modes, config))
    return profiles.column_profiles(values, c.columns_frame()).select(*PROFILE_COLUMNS)


@query
def wide_decimals(spark, sf_dir):
    c = Catalog(spark, {"main.wide": given.derived(spark, sf_dir, given.WIDE_DECIMALS)})
    return profiles.column_profiles(value_counts(c, text_forms=False), c.columns_frame()).select(
        "column_name", "row_count", "distinct_count", "min_dec", "max_dec", "min_num", "max_num"
    )


@query
def loaded_profiles(spark, sf_dir):
    """Column profiles of three chosen tables, by way of loading them."""
    loaded = load_tables(given.catalog(spark, sf_dir), ["main.orders", "main.customer", "main.nation"])
    return loaded.column_profiles.select(*PROFILE_COLUMNS)


def _folder(spark, label: str) -> str:
    return f"{shared_folder(spark)}/tieweave/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


@query
def saved_snapshot(spark, sf_dir):
    """The inventory written as a snapshot and read back."""
    folder = _folder(spark, "snapshots")
    snapshots.save_snapshot(given.catalog(spark, sf_dir).inventory(), folder, "one")
    tables, columns = snapshots.load_snapshot(spark, folder, "one")
    return columns.join(tables, "table_key").select("table_key", "column_name", "data_type", "ordinal_position", "row_count")


# -- candidates


def _with_counts(c, found: DataFrame) -> DataFrame:
    """Candidates with the distinct counts of both sides."""
    found = materialize(found, "candidates")
    used = candidate_columns(found)
    columns = c.columns_frame().where(F.col("col_id").isin(used))
    counts = profiles.column_profiles(value_counts(c, used, text_forms=False), columns).select("col_id", "distinct_count")
    for role in ("source", "target"):
        found = found.join(
            counts.select(F.col("col_id").alias(f"{role}_col_id"), F.col("distinct_count").alias(f"{role}_distinct")),
            f"{role}_col_id",
        )
    return found.select(
        *cand.PAIR_KEY, "match_type", "name_score", "reason",
        "type_decision.compatible", "type_decision.risk", F.col("type_decision.reason").alias("type_reason"),
        "source_distinct", "target_distinct",
    )


@query
def candidate_pairs(spark, sf_dir):
    c = given.catalog(spark, sf_dir)
    return cand.by_name_score(_with_counts(c, cand.candidate_pairs(c.columns_frame(), WHOLE)))


@query
def alias_pairs(spark, sf_dir):
    c = given.catalog(spark, sf_dir)
    return _with_counts(c, cand.candidate_pairs(c.columns_frame(), replace(WHOLE, aliases=ALIASES)))


@query
def excluded_pairs(spark, sf_dir):
    c = given.catalog(spark, sf_dir)
    config = replace(WHOLE, column_patterns=("NATION", "text"), table_patterns=("Label", "embed"))
    return _with_counts(c, cand.candidate_pairs(c.columns_frame(), config))


@query
def relaxed_pairs(spark, sf_dir):
    c = given.catalog(spark, sf_dir)
    return _with_counts(c, cand.candidate_pairs(c.columns_frame(), replace(WHOLE, type_compatibility="relaxed", name_similarity_min=0.5)))


# -- evidence and scores


def _evidence(spark, sf_dir, scope: str):
    c = given.catalog(spark, sf_dir)
    config = replace(WHOLE, scope=scope)
    found = materialize(cand.candidate_pairs(c.columns_frame(), config), "candidates")
    used = candidate_columns(found)
    columns = c.columns_frame().where(F.col("col_id").isin(used))
    values = materialize(value_counts(c, used), "values")
    rows = materialize(profiles.column_profiles(values, columns), "profiles")
    sets = values if scope == "full" else profiles.top_keys(values, columns, config.top_n)
    return overlap.value_evidence(found, rows, sets, config), rows, config


@query
def value_evidence_full(spark, sf_dir):
    rows, _, _ = _evidence(spark, sf_dir, "full")
    return rows.select(*EVIDENCE_COLUMNS, _flags())


@query
def value_evidence_top(spark, sf_dir):
    rows, _, _ = _evidence(spark, sf_dir, "top")
    return rows.select(*EVIDENCE_COLUMNS, _flags())


@query
def scored_pairs(spark, sf_dir):
    rows, column_rows, config = _evidence(spark, sf_dir, "full")
    return score_pairs(rows, column_rows, config).select(*SCORE_COLUMNS)


@query
def common_values(spark, sf_dir):
    """All shared values of all pairs."""
    c = given.catalog(spark, sf_dir)
    found = materialize(cand.candidate_pairs(c.columns_frame(), WHOLE), "candidates")
    posted = materialize(overlap.postings(overlap.value_members(value_counts(c, candidate_columns(found)))), "postings")
    shared = overlap.shared_values(overlap.SharedMembers(found, posted).rows("exact"), c)
    family = F.col("source_family")
    return found.join(shared, list(overlap.PAIR_IDS)).where(family != "other").select(
        *cand.PAIR_KEY,
        F.when(family == "numeric", F.col("value")).try_cast("double").alias("value_num"),
        F.when(family == "datetime", F.col("value")).try_cast("timestamp_ntz").alias("value_ts"),
        F.when(family == "string", F.sha2("value", 256)).alias("value_sha256"),
    )


def _string_part(spark, sf_dir):
    c = given.catalog(spark, sf_dir)
    columns = c.columns_frame()
    found = cand.candidate_pairs(columns, WHOLE).where(F.col("source_family") == "string")
    found = materialize(found, "candidates")
    used = candidate_columns(found)
    values = materialize(value_counts(c, used), "values")
    columns = columns.where(F.col("col_id").isin(used))
    rows = strings.string_profiles(values, columns, profiles.column_profiles(values, columns), c, WHOLE)
    rows = materialize(rows, "strings")
    return overlap.string_evidence(found, rows, WHOLE, members=overlap.text_members(values, c, rows))


@query
def reviewed_aliases(spark, sf_dir):
    """The alias index after feedback; the last word on an alias counts."""
    index = cand.alias_index(spark, ALIASES)
    return cand.latest_aliases(index, given.derived(spark, sf_dir, given.ALIAS_FEEDBACK))


@query
def described_columns(spark, sf_dir):
    """Columns of many tables with the descriptions found in responses, null where there is none."""
    lookup = responses.description_lookup(_descriptions(spark, sf_dir))
    return responses.describe_columns(given.derived(spark, sf_dir, given.DESCRIBED_COLUMNS), lookup)


@query
def string_scores(spark, sf_dir):
    """The score of the string evidence, halved for pairs without a token in common."""
    parts = _string_part(spark, sf_dir)
    score = string_score(
        F.col("categorical_alignment"), F.col("token_similarity"), F.col("normalization_overlap"), F.col("token_similarity") == 0
    )
    return parts.select(*cand.PAIR_KEY, score.alias("score"))


@query
def string_evidence(spark, sf_dir):
    return _string_part(spark, sf_dir).select(
        *cand.PAIR_KEY, "categorical_alignment", "token_similarity", "normalization_overlap",
        "is_both_categorical", "is_both_identifier", F.array_join("shared_categories", "|").alias("shared_categories"),
    )


@query
def fuzzy_value_match(spark, sf_dir):
    return _string_part(spark, sf_dir).select(*cand.PAIR_KEY, "fuzzy_match_score", "weak_match", "string_score")


def _suggested(spark, sf_dir, with_strings: bool = False) -> DataFrame:
    found = run_analysis(given.catalog(spark, sf_dir), WHOLE, with_strings=with_strings)
    return found.suggested_edges


@query
def suggested_edges(spark, sf_dir):
    rows = _suggested(spark, sf_dir, with_strings=True)
    scores = [F.col(f"evidence.{c}") for c in ("match_type", "reason", "name_score", "type_score", "value_score", "uniqueness_score", "null_score")]
    found = F.col("evidence.value_evidence")
    return rows.select(
        *cand.PAIR_KEY, "confidence", "confidence_band", *scores,
        found["exact_overlap_count"].alias("exact_overlap_count"),
        found["exact_overlap_ratio"].alias("exact_overlap_ratio"),
        found["jaccard"].alias("jaccard"), found["mode"].alias("mode"),
        F.array_join(F.array_sort(found["confidence_flags"]), ",").alias("confidence_flags"),
        F.col("evidence.string_evidence.token_similarity").alias("token_similarity"),
        F.col("evidence.string_evidence.is_both_categorical").alias("is_both_categorical"),
    )


@query
def visible_edges(spark, sf_dir):
    rows = _suggested(spark, sf_dir).withColumnRenamed("source_table", "source_key").withColumnRenamed("target_table", "target_key")
    return edges.visible_edges(rows, WHOLE.band_medium, 10).select(*edges.EDGE_KEY, "confidence", "confidence_band")


# -- review of the current graph


def _review(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(
        given.derived(spark, sf_dir, sql)
        for sql in (given.REVIEW_SUGGESTED, given.REVIEW_CONFIRMED, given.REVIEW_DECISIONS)
    )


@query
def reviewed_suggestions(spark, sf_dir):
    return edges.apply_decisions(*_review(spark, sf_dir))[0]


@query
def reviewed_confirmed(spark, sf_dir):
    return edges.apply_decisions(*_review(spark, sf_dir))[1]


@query
def reviewed_confirmed_by_column(spark, sf_dir):
    return edges.apply_decisions(*_review(spark, sf_dir), by_column=True)[1]


@query
def remaining_nodes(spark, sf_dir):
    nodes = given.derived(spark, sf_dir, given.REVIEW_NODES)
    return edges.remaining_nodes(nodes, given.derived(spark, sf_dir, given.REVIEW_DECISIONS))


@query
def annotations(spark, sf_dir):
    notes = given.derived(spark, sf_dir, given.REVIEW_NOTES)
    seeds = given.derived(spark, sf_dir, given.REVIEW_CONFIRMED).select(
        F.concat_ws("->", "source_key", "target_key").alias("key"), F.col("annotation").alias("text")
    ).distinct()
    return edges.annotate(seeds, notes)


@query
def edited_edges(spark, sf_dir):
    rows = given.derived(spark, sf_dir, given.REVIEW_EDITS)
    return edges.confirmed_from_edit(rows, given.derived(spark, sf_dir, given.EDIT_NODES))


@query
def ambiguous_edits(spark, sf_dir):
    rows = given.derived(spark, sf_dir, given.REVIEW_EDITS)
    return edges.ambiguous_edits(rows, given.derived(spark, sf_dir, given.AMBIGUOUS_NODES))


@query
def saved_state(spark, sf_dir):
    """The state of a review written and its confirmed edges read back."""
    suggested, confirmed, _ = _review(spark, sf_dir)
    nodes = given.derived(spark, sf_dir, given.REVIEW_NODES)
    server = spark.createDataFrame([("s", "d")], "server string, database string")
    notes = given.derived(spark, sf_dir, given.REVIEW_NOTES).select("key", "text")
    folder = _folder(spark, "state")
    reports.save_state(folder, server, nodes, confirmed, suggested, notes)
    kinds = ", ".join(f"{c} string" for c in (*edges.EDGE_KEY, "rel_type", "annotation"))
    return reports.load_edges(spark, folder, "confirmed", kinds)


@query
def exported_graph(spark, sf_dir):
    """One graph written and read back under a new id: its edges."""
    parts = {
        "graph": given.derived(spark, sf_dir, given.GRAPHS), "nodes": given.derived(spark, sf_dir, given.STORED_NODES),
        "edges": given.derived(spark, sf_dir, given.STORED_EDGES), "confirmers": given.derived(spark, sf_dir, given.CONFIRMERS),
    }
    folder = _folder(spark, "graph")
    reports.export_graph(folder, ONE_GRAPH, parts["graph"], parts["nodes"], parts["edges"], parts["confirmers"])
    copy = reports.import_graph(spark, folder, {name: frame.schema for name, frame in parts.items()}, "copy")
    return copy["edges"].select("id", "graph_id", *stored_graphs.SIGNATURE)


@query
def exported_turns(spark, sf_dir):
    turns = given.derived(spark, sf_dir, given.TURNS)
    folder = _folder(spark, "turns")
    reports.export_conversations(folder, turns)
    return spark.read.schema(turns.schema).json(folder)


@query
def filtered_suggestions(spark, sf_dir):
    rows = given.derived(spark, sf_dir, given.REVIEW_SUGGESTED)
    return edges.review_filter(rows, origin="ai", band="medium", table=" U1 ")


@query
def bulk_denial(spark, sf_dir):
    suggested, confirmed, _ = _review(spark, sf_dir)
    low = edges.review_filter(suggested, band="low")
    return edges.apply_decisions(suggested, confirmed, edges.decisions_for(low, "dismiss"))[0]


@query
def bulk_approval(spark, sf_dir):
    suggested, confirmed, _ = _review(spark, sf_dir)
    high = edges.review_filter(suggested, band="high")
    return edges.apply_decisions(suggested, confirmed, edges.decisions_for(high, "confirm"))[1]


# -- stored graphs


@query
def graph_list(spark, sf_dir):
    rows = given.derived(spark, sf_dir, given.GRAPHS)
    return stored_graphs.graph_list(rows, text="SERVER1", domain_tag="BUILDING").select("id", "name", "is_template", "version")


@query
def template_graphs(spark, sf_dir):
    rows = given.derived(spark, sf_dir, given.GRAPHS)
    return stored_graphs.graph_list(rows, kind="template").select("id", "name", "updated_at")


@query
def saved_graphs(spark, sf_dir):
    """Re-save every forked graph with a new name and creator; creation data must stay."""
    rows = given.derived(spark, sf_dir, given.GRAPHS)
    incoming = rows.where(F.col("parent_graph_id").isNotNull()).withColumn("name", F.upper("name")).withColumn(
        "created_by", F.lit("somebody")
    )
    return stored_graphs.save_graphs(rows, incoming).select("id", "name", "created_by", "created_at", "version")


@query
def deleted_graph_edges(spark, sf_dir):
    rows = given.derived(spark, sf_dir, given.STORED_EDGES)
    doomed = given.derived(spark, sf_dir, given.GRAPHS).where("is_template").select(F.col("id").alias("graph_id"))
    return stored_graphs.delete_graphs(rows, doomed).select("id", "graph_id")


@query
def forked_edges(spark, sf_dir):
    parts = [given.derived(spark, sf_dir, sql) for sql in (given.GRAPHS, given.STORED_NODES, given.STORED_EDGES)]
    return stored_graphs.fork_graph(*parts, ONE_GRAPH, "fork1", "My copy", "me")[2]


@query
def forked_nodes(spark, sf_dir):
    parts = [given.derived(spark, sf_dir, sql) for sql in (given.GRAPHS, given.STORED_NODES, given.STORED_EDGES)]
    return stored_graphs.fork_graph(*parts, ONE_GRAPH, "fork1", "My copy", "me")[1]


@query
def latest_snapshots(spark, sf_dir):
    return stored_graphs.latest_snapshots(given.derived(spark, sf_dir, given.SNAPSHOTS))


@query
def next_versions(spark, sf_dir):
    graphs = given.derived(spark, sf_dir, given.GRAPHS)
    snapshots = given.derived(spark, sf_dir, given.SNAPSHOTS)
    edited = graphs.where("is_template").select(F.col("id").alias("graph_id"), F.concat(F.lit("state of "), "name").alias("snapshot"))
    return stored_graphs.next_versions(graphs, snapshots, edited)[1]


def _confirmed_edges(spark, sf_dir) -> DataFrame:
    """Counts of the stored edges after a log.

    All three relations come out of the same joined lines, which are written once, and so are the edges, as they
    are met twice; of these the columns that no reader asks for are left out.
    """
    stored, confirmers, log = given.derived_from_lines(
        spark, sf_dir, (given.STORED_EDGES, given.CONFIRMERS, given.CONFIRMATION_LOG)
    )
    stored = stored.select("id", "graph_id", *stored_graphs.SIGNATURE, "confirmed_by_count")
    return stored_graphs.record_confirmations(materialize(stored, "stored"), confirmers, log)


@query
def recorded_confirmations(spark, sf_dir):
    return _confirmed_edges(spark, sf_dir).select("id", "graph_id", "confirmed_by_count")


@query
def graph_confirmers(spark, sf_dir):
    return stored_graphs.graph_confirmers(
        *[given.derived(spark, sf_dir, sql) for sql in (given.STORED_EDGES, given.CONFIRMERS, given.CONFIRMATION_LOG)],
        ONE_GRAPH,
    )


@query
def confirmation_counts(spark, sf_dir):
    return stored_graphs.confirmation_counts(_confirmed_edges(spark, sf_dir))


@query
def promoted_edges(spark, sf_dir):
    return stored_graphs.promoted_edges(materialize(_confirmed_edges(spark, sf_dir), "confirmed"), ONE_GRAPH).select(
        *stored_graphs.SIGNATURE, "confirmed_by_count", "id"
    )


@query
def folded_confirmations(spark, sf_dir):
    """The log in files, folded into the state as a stream; the first batch comes a second time."""
    folder = f"{shared_folder(spark)}/tieweave/folded-{uuid.uuid4().hex}"
    log = given.derived(spark, sf_dir, given.CONFIRMATION_LOG)
    log.repartition(6, "session_id").write.parquet(f"{folder}/log")
    confirmation_state.fold_folder(spark, f"{folder}/log", log.schema, f"{folder}/state", files=3)
    again = confirmation_state.state(spark, f"{folder}/state").where(F.col("batch_id") == "stream-0")
    confirmation_state.fold(materialize(again, "batch"), f"{folder}/state", "stream-0")
    return confirmation_state.session_counts(confirmation_state.state(spark, f"{folder}/state"))


def _graph_table(spark, sf_dir) -> GraphTable:
    rows = given.derived(spark, sf_dir, given.STORED_EDGES)
    table = GraphTable(spark, f"{shared_folder(spark)}/tieweave/graphs-{uuid.uuid4().hex}", rows.schema, buckets=16)
    table.save(rows)
    return table


@query
def stored_graph(spark, sf_dir):
    """A lookup by id in the stored table."""
    return _graph_table(spark, sf_dir).of_graph(ONE_GRAPH)


@query
def rewritten_graphs(spark, sf_dir):
    """The stored table after a save, a deletion and a fork."""
    table = _graph_table(spark, sf_dir)
    table.save(table.of_graph(ONE_GRAPH).withColumn("annotation", F.lit("again")))
    table.delete(spark.createDataFrame([("g8",), ("g10",)], "graph_id string"))
    table.fork(ONE_GRAPH, "fork of " + ONE_GRAPH)
    return table.rows().drop("bucket")


@query
def context_edges(spark, sf_dir):
    nodes = stored_graphs.of_graph(given.derived(spark, sf_dir, given.STORED_NODES), ONE_GRAPH)
    rows = given.derived(spark, sf_dir, given.STORED_EDGES).where(F.col("edge_type") == "confirmed")
    return stored_graphs.context_edges(nodes, stored_graphs.of_graph(rows, ONE_GRAPH)).select("id", *stored_graphs.SIGNATURE)


# -- drift


def _drift(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    now_t, now_c, was_t, was_c = (
        materialize(given.derived(spark, sf_dir, sql), "snapshot")
        for sql in (given.CURRENT_TABLES, given.CURRENT_COLUMNS, given.PREVIOUS_TABLES, given.PREVIOUS_COLUMNS)
    )
    changes = materialize(drift.column_changes(now_t, now_c, was_t, was_c), "changes")
    return changes, drift.table_verdicts(now_t, was_t, changes)


@query
def drift_columns(spark, sf_dir):
    return _drift(spark, sf_dir)[0]


@query
def drift_tables(spark, sf_dir):
    return _drift(spark, sf_dir)[1]


@query
def drift_summary(spark, sf_dir):
    return drift.drift_summary(_drift(spark, sf_dir)[1])


# -- histories of snapshots


def _versions(spark, sf_dir) -> DataFrame:
    return materialize(given.derived(spark, sf_dir, given.HISTORY_VERSIONS), "versions")


def _column_history(spark, sf_dir) -> DataFrame:
    return history.column_history(given.derived(spark, sf_dir, given.HISTORY_COLUMNS), _versions(spark, sf_dir))


@query
def column_history(spark, sf_dir):
    return _column_history(spark, sf_dir)


@query
def table_history(spark, sf_dir):
    return history.table_history(given.derived(spark, sf_dir, given.HISTORY_TABLES), _versions(spark, sf_dir))


@query
def extended_history(spark, sf_dir):
    """Three snapshots at once, then the other two one by one."""
    columns, versions = given.derived(spark, sf_dir, given.HISTORY_COLUMNS), _versions(spark, sf_dir)
    early = F.col("version") <= 3
    rows = materialize(history.column_history(columns.where(early), versions.where(early)), "history")
    for version in (4, 5):
        snapshot = columns.where(F.col("version") == version)
        rows = materialize(history.extended(rows, snapshot, version, history.COLUMN_KEY, history.COLUMN_STATE), "history")
    return rows


@query
def history_as_of(spark, sf_dir):
    return history.as_of(_column_history(spark, sf_dir), 4)


@query
def history_changes(spark, sf_dir):
    """What changed from version 2 to 5, read from the histories."""
    kept = [materialize(rows, "history") for rows in (table_history(spark, sf_dir), _column_history(spark, sf_dir))]
    return history.changes_between(*kept, later=5, earlier=2)


# -- responses


def _relationships(spark, sf_dir) -> DataFrame:
    return responses.relationships(responses.parse_responses(given.relationship_responses(spark, sf_dir)))


@query
def response_relationships(spark, sf_dir):
    return _relationships(spark, sf_dir).drop("position")


@query
def response_errors(spark, sf_dir):
    parsed = responses.parse_responses(given.relationship_responses(spark, sf_dir))
    return responses.response_errors(parsed).select("batch_id", "truncated")


@query
def response_edges(spark, sf_dir):
    rows = edges.from_responses(_relationships(spark, sf_dir), given.derived(spark, sf_dir, given.RESPONSE_NODES))
    return rows.select(
        "batch_id", *edges.EDGE_KEY, "confidence", "confidence_band",
        F.col("evidence.source").alias("origin"), "evidence.reasoning", "evidence.rel_type",
    )


@query
def merged_edges(spark, sf_dir):
    """Edges read from responses added to those suggested from the lines."""
    rows = edges.from_responses(_relationships(spark, sf_dir), given.derived(spark, sf_dir, given.RESPONSE_NODES))
    new = rows.select(
        *edges.EDGE_KEY, F.lit("ai").alias("origin"),
        F.struct("batch_id", F.col("confidence").alias("c"), "evidence").alias("turn"), "confidence",
    )
    existing = given.derived(
        spark, sf_dir,
        "SELECT DISTINCT 'conn1.dbo.S' || l_suppkey AS source_key, 'k' || (l_linenumber % 4) AS source_column, "
        "'conn1.dbo.P' || l_partkey AS target_key, 'p' AS target_column, 'pipeline' AS origin, "
        "CAST(0.9 AS DOUBLE) AS confidence FROM lineitem",
    )
    return edges.add_suggestions(existing, new, order="turn")


def _descriptions(spark, sf_dir) -> DataFrame:
    parsed = responses.parse_responses(given.description_responses(spark, sf_dir))
    return responses.column_descriptions(parsed)


@query
def response_descriptions(spark, sf_dir):
    return responses.description_lookup(_descriptions(spark, sf_dir))


# -- conversations and bounded reads


def _messages(spark, sf_dir) -> DataFrame:
    return talk.turn_messages(given.derived(spark, sf_dir, given.TURNS))


@query
def turn_messages(spark, sf_dir):
    return _messages(spark, sf_dir)


@query
def pruned_history(spark, sf_dir):
    return talk.prune_history(_messages(spark, sf_dir), max_turns=2)


@query
def context_tail(spark, sf_dir):
    return talk.context_tail(_messages(spark, sf_dir))


@query
def bounded_read(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return talk.bounded_read(rows, ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))


# -- reports


@query
def report_summary(spark, sf_dir):
    suggested, confirmed = edges.apply_decisions(*_review(spark, sf_dir))
    nodes = edges.remaining_nodes(given.derived(spark, sf_dir, given.REVIEW_NODES), given.derived(spark, sf_dir, given.REVIEW_DECISIONS))
    return reports.summary(nodes, confirmed, suggested)


@query
def report_relationships(spark, sf_dir):
    _, confirmed, _ = _review(spark, sf_dir)
    notes = edges.annotate(
        spark.createDataFrame([], "key string, text string"), given.derived(spark, sf_dir, given.REVIEW_NOTES)
    )
    return reports.relationships(confirmed, notes)


# -- keys of nodes and edges


@query
def node_key_parts(spark, sf_dir):
    """Dotted keys of one to four parts, taken apart."""
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet")
    parts = F.array(F.lit("x"), F.col("c_nationkey").cast("string"), "c_mktsegment", "c_name")
    n = (F.col("c_custkey") % 4 + 1).cast("int")
    keyed = rows.select("c_custkey", F.array_join(F.slice(parts, F.lit(5) - n, n), ".").alias("node_key"))
    return keyed.select("c_custkey", "node_key", F.inline(F.array(text.node_parts(F.col("node_key")))))


@query
def edge_keys(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return rows.select("o_orderkey", text.edge_key("o_orderstatus", "o_orderpriority", F.col("o_custkey").cast("string")).alias("edge_key"))
