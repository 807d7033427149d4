"""Plans that must hold at scale: no cross joins, one scan, cuts before shuffles."""

import os

import pytest
from pyspark.sql import functions as F

from checks import given
from checks.queries import QUERIES
from tieweave.operators.candidates import candidate_pairs
from tieweave.operators.overlap import SharedMembers, postings, value_members
from tieweave.operators.profiles import top_keys
from tieweave.operators.values import value_counts
from tieweave.plans.loading import load_tables
from tieweave.sources.catalog import Catalog

SMALL = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SMALL), reason="given tables not mounted")


def plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def catalog(spark, tmp_path):
    for name in ("left", "right"):
        spark.range(50).select(
            F.col("id").alias("user_id"), (F.col("id") % 5).cast("string").alias("label"), F.lit("unused").alias("padding_zz" + name)
        ).write.parquet(str(tmp_path / name))
    return Catalog.from_directory(spark, str(tmp_path))


def test_value_relation_scans_once_and_prunes(catalog):
    wanted = [c["col_id"] for c in catalog.column_rows() if c["column_name"] == "user_id"]
    text = plan(value_counts(catalog, wanted))
    assert text.count("FileScan") == 2
    assert "label" not in text and "padding" not in text
    assert text.count("Exchange hashpartitioning") == 1


def test_top_values_are_cut_before_the_shuffle(catalog):
    text = plan(top_keys(value_counts(catalog), catalog.columns_frame(), 10))
    assert "WindowGroupLimit" in text and "Partial" in text


def test_no_cross_joins_for_pairs(catalog):
    pairs = candidate_pairs(catalog.columns_frame())
    found = SharedMembers(pairs, postings(value_members(value_counts(catalog)))).counts({"exact": "n"})
    for frame in (pairs, found):
        assert "CartesianProduct" not in plan(frame)
        assert "BroadcastNestedLoopJoin" not in plan(frame)


@needs_data
@pytest.mark.parametrize(
    "name", ["reviewed_confirmed", "promoted_edges", "drift_tables", "merged_edges", "graph_confirmers", "pruned_history"]
)
def test_no_cross_joins_in_queries(spark, name):
    text = plan(QUERIES[name](spark, SMALL))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_load_tables(spark, catalog):
    loaded = load_tables(catalog, ["main.left", "main.right", "main.left"], "c1", "db")
    assert loaded.nodes.count() == 2
    assert {r.profiling_mode for r in loaded.table_profiles.collect()} == {"A"}
    assert loaded.column_profiles.count() == 6
    assert loaded.top_values.where(F.col("column_name") == "label").count() == 10
    assert loaded.string_profiles.count() == 4
    assert loaded.confirmed.count() == 0


@needs_data
@pytest.mark.parametrize("name", ["candidate_pairs", "value_evidence_full", "reviewed_suggestions", "drift_summary", "context_tail"])
def test_queries_match_sql(spark, name):
    from checks.compare import compare
    from checks.oracle import ORACLE

    assert compare(spark, SMALL, name, QUERIES[name], ORACLE[name]()).startswith("ok")


@needs_data
def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 10
    assert set(entry.oracle_sql()) <= set(entry.queries())
