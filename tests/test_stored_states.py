"""Histories of snapshots, the confirmation state, the stored table of graphs."""

import os
import random

import pytest
from pyspark.sql import functions as F

from tieweave.operators import confirmation_state as cs
from tieweave.operators import drift, history
from tieweave.sources import reports
from tieweave.sources.graph_table import GraphTable

COLUMNS = "version long, table_key string, column_name string, data_type string, is_nullable boolean"


@pytest.fixture(scope="module")
def snapshots(spark):
    """Six versions of random columns; nothing at all is there in version 4."""
    rng, rows, tables = random.Random(3), [], []
    for version in (1, 2, 4, 5, 8, 9):
        for t in range(6):
            if version == 4 or rng.random() < 0.2:
                continue
            tables.append((version, f"t{t}", rng.randrange(2)))
            rows += [
                (version, f"t{t}", f"c{c}", rng.choice(["int", "text", None]), rng.random() < 0.5)
                for c in range(5) if rng.random() < 0.8
            ]
    return (
        spark.createDataFrame(tables, "version long, table_key string, row_count long"),
        spark.createDataFrame(rows, COLUMNS),
        spark.createDataFrame([(v,) for v in (1, 2, 4, 5, 8, 9)], "version long"),
    )


def plain_intervals(rows, versions):
    state = {}
    for version, *rest in rows:
        state[version, *rest[:2]] = tuple(rest[2:])
    out = []
    for key in {k[1:] for k in state}:
        open_ = None
        for version in versions:
            now = state.get((version, *key))
            if open_ and now != open_[0]:
                out.append((*key, *open_[0], open_[1], version))
                open_ = None
            if now is not None and open_ is None:
                open_ = (now, version)
        if open_:
            out.append((*key, *open_[0], open_[1], None))
    return sorted(out, key=str)


def tuples(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def test_intervals_against_the_plain_way(snapshots):
    _, columns, versions = snapshots
    wanted = plain_intervals([tuple(r) for r in columns.collect()], [1, 2, 4, 5, 8, 9])
    assert tuples(history.column_history(columns, versions)) == wanted
    # Repeated rows change nothing.
    assert tuples(history.column_history(columns.union(columns), versions)) == wanted


def test_intervals_take_one_shuffle_and_one_sort(snapshots):
    _, columns, versions = snapshots
    plan = history.column_history(columns, versions)._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange hashpartitioning(table_key") == 1
    assert plan.count("Sort [table_key") == 1


def test_folding_one_by_one_gives_the_same(snapshots):
    _, columns, versions = snapshots
    rows = history.column_history(columns.where("version = 1"), versions.where("version = 1"))
    for version in (2, 4, 5, 5, 8, 9):
        rows = history.extended(
            rows, columns.where(F.col("version") == version), version, history.COLUMN_KEY, history.COLUMN_STATE
        ).checkpoint()
    assert tuples(rows) == tuples(history.column_history(columns, versions))


def test_as_of_and_changes_between_any_two(snapshots):
    tables, columns, versions = snapshots
    columns = columns.where("data_type is not null")
    of_tables = history.table_history(tables, versions).cache()
    of_columns = history.column_history(columns, versions).cache()
    side = lambda rows, v: rows.where(F.col("version") == v).drop("version")
    for earlier, later in ((1, 2), (1, 9), (2, 8), (4, 5)):
        assert tuples(history.as_of(of_columns, later)) == tuples(side(columns, later))
        wanted = drift.column_changes(side(tables, later), side(columns, later), side(tables, earlier), side(columns, earlier))
        assert tuples(history.changes_between(of_tables, of_columns, later, earlier)) == tuples(wanted)


def test_history_of_nothing(snapshots):
    _, columns, versions = snapshots
    assert history.column_history(columns.where("false"), versions).collect() == []
    assert history.column_history(columns.where("false"), versions.where("false")).collect() == []


LOG = [(f"s{n % 3}", "a", "t", "b" if n % 2 else None, f"u{n % 5}") for n in range(40)]


def test_batches_in_any_order_and_again(spark, tmp_path):
    log = spark.createDataFrame(LOG, ", ".join(f"{c} string" for c in cs.PAIR))
    wanted = tuples(cs.session_counts(log.distinct()))
    batches = [spark.createDataFrame(LOG[n : n + 15], log.schema) for n in range(0, 40, 10)]
    for at, order in enumerate(((0, 1, 2, 3), (3, 1, 0, 2), (2, 2, 0, 1, 0, 3, 3))):
        for n in order:
            cs.fold(batches[n], f"{tmp_path}/{at}", f"b{n}")
        assert tuples(cs.session_counts(cs.state(spark, f"{tmp_path}/{at}"))) == wanted


def test_folder_is_folded_once(spark, tmp_path):
    log = spark.createDataFrame(LOG, ", ".join(f"{c} string" for c in cs.PAIR))
    log.limit(20).coalesce(1).write.parquet(f"{tmp_path}/log")
    for _ in range(2):
        cs.fold_folder(spark, f"{tmp_path}/log", log.schema, f"{tmp_path}/state")
    log.coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
    cs.fold_folder(spark, f"{tmp_path}/log", log.schema, f"{tmp_path}/state")
    found = cs.state(spark, f"{tmp_path}/state")
    assert tuples(cs.session_counts(found)) == tuples(cs.session_counts(log.distinct()))
    assert found.select("batch_id").distinct().count() == 2


def test_empty_state(spark, tmp_path):
    assert cs.state(spark, f"{tmp_path}/none").collect() == []


@pytest.fixture
def graphs(spark, tmp_path):
    rows = spark.createDataFrame([(f"g{n % 7}", n, f"v{n}") for n in range(70)], "graph_id string, n int, text string")
    table = GraphTable(spark, str(tmp_path), rows.schema, buckets=4)
    table.save(rows)
    return table, rows


def files(table):
    data = os.path.join(table.folder, "data")
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(data) for f in fs}


def test_a_save_leaves_other_buckets(graphs):
    table, rows = graphs
    before = files(table)
    new = rows.where("graph_id = 'g3' and n < 20").withColumn("text", F.lit("new"))
    assert table.save(new) == 2
    assert before.items() <= files(table).items()
    written = {f.split("bucket=")[1].split("/")[0] for f in set(files(table)) - set(before) if "bucket=" in f}
    assert len(written) == 1
    wanted = rows.where("graph_id <> 'g3'").union(new)
    assert tuples(table.rows().drop("bucket")) == tuples(wanted)
    assert tuples(table.rows(1).drop("bucket")) == tuples(rows)
    assert tuples(table.of_graph("g3")) == tuples(new)


def test_a_lookup_is_pruned(graphs):
    table, _ = graphs
    plan = table.of_graph("g3")._jdf.queryExecution().executedPlan().toString()
    found = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "bucket" in found


def test_deleted_forked_and_emptied(graphs, spark):
    table, rows = graphs
    table.delete(spark.createDataFrame([("g1",), ("unknown",)], "graph_id string"))
    table.fork("g2", "copy")
    copy = rows.where("graph_id = 'g2'").withColumn("graph_id", F.lit("copy"))
    assert tuples(table.rows().drop("bucket")) == tuples(rows.where("graph_id <> 'g1'").union(copy))
    table.delete(table.rows())
    assert table.rows().collect() == [] and table.of_graph("g2").collect() == []
    assert table.save(rows.where("false")) == table.version()
    table.save(copy)
    assert tuples(table.rows().drop("bucket")) == tuples(copy)


def test_a_failed_write_leaves_the_old_version(graphs):
    table, rows = graphs
    with pytest.raises(Exception):
        table.save(rows.withColumn("text", F.raise_error(F.lit("lost")).cast("string")))
    assert table.version() == 1
    assert tuples(table.rows().drop("bucket")) == tuples(rows)


def test_what_is_saved_or_exported_is_worked_out_once(spark, tmp_path):
    worked = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            worked.add(batch.num_rows)
            yield batch

    rows = spark.range(40).selectExpr("'e' || id AS id", "'g' || id % 4 AS graph_id")
    counted = rows.mapInArrow(seen, rows.schema)
    table = GraphTable(spark, str(tmp_path / "table"), rows.schema, buckets=3)
    assert table.save(rows.where("false")) == 0 and table.rows().count() == 0
    for version in (1, 2):
        assert table.save(counted) == version
        assert worked.value == 40 * version
        assert sorted(r.id for r in table.rows().collect()) == sorted(r.id for r in rows.collect())
    own = spark.createDataFrame([("e5", "s1"), ("e6", "s2"), ("e9", "s3")], "edge_id string, session_id string")
    graphs = spark.createDataFrame([("g1",), ("g2",)], "id string")
    reports.export_graph(str(tmp_path / "out"), "g1", graphs, rows.select("graph_id"), counted, own)
    assert worked.value == 120
    assert {r.edge_id for r in spark.read.json(str(tmp_path / "out/confirmers")).collect()} == {"e5", "e9"}
    assert spark.read.json(str(tmp_path / "out/edges")).count() == 10
