"""Load tables: inventory, nodes, declared edges and all profiles."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Iterable

from pyspark.sql import DataFrame

from tieweave.config import Config
from tieweave.operators.edges import fk_edges, graph_nodes
from tieweave.operators.profiles import column_profiles, profiling_modes, sampled_scans, top_values
from tieweave.operators.strings import string_profiles
from tieweave.operators.values import value_counts
from tieweave.session import materialize
from tieweave.sources.catalog import Catalog


@dataclass(frozen=True)
class LoadedGraph:
    inventory: DataFrame
    nodes: DataFrame
    confirmed: DataFrame
    table_profiles: DataFrame
    column_profiles: DataFrame
    top_values: DataFrame
    string_profiles: DataFrame


def load_tables(
    catalog: Catalog,
    wanted: Iterable[str] | None = None,
    connection_id: str = "conn1",
    database: str = "",
    config: Config = Config(),
) -> LoadedGraph:
    """One scan per table: the value relation is written once and all profiles read it."""
    chosen = catalog if wanted is None else catalog.only(wanted)
    columns = chosen.columns_frame()
    inventory = chosen.inventory()
    modes = materialize(profiling_modes(columns, chosen.row_counts(), config), "table-profiles")
    sampled = sampled_scans(chosen, modes, config)
    values = materialize(value_counts(chosen, sampled=sampled), "values")
    profiles = materialize(column_profiles(values, columns), "profiles")
    text_source = None
    if sampled:
        text_ids = [c["col_id"] for c in chosen.column_rows() if c["family"] == "string"]
        text_source = value_counts(chosen, text_ids)
    nodes = graph_nodes(inventory, connection_id, database)
    return LoadedGraph(
        inventory=inventory,
        nodes=nodes,
        confirmed=fk_edges(chosen.foreign_keys_frame(), nodes, connection_id),
        table_profiles=modes,
        column_profiles=profiles,
        top_values=top_values(values, columns, chosen, config.top_n),
        string_profiles=string_profiles(values, columns, profiles, chosen, config, text_source),
    )
