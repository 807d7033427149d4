import random

from pyspark.sql import Row
from pyspark.sql import functions as F

from tieweave.operators import edges, stored_graphs
from tieweave.sources import reports

EDGE = "source_key string, source_column string, target_key string, target_column string"
DECISION = f"seq long, action string, {EDGE}, rel_type string, annotation string, node_key string"


def rows_of(frame, *columns):
    return sorted(tuple(r) for r in frame.select(*columns).collect())


def fold(suggested, confirmed, decisions, by_column=False):
    """The decisions applied one after the other."""
    suggested, confirmed = set(suggested), dict(confirmed)
    for _, action, *edge, rel, note, node in sorted(decisions):
        edge = tuple(edge)
        if action in ("confirm", "dismiss"):
            suggested.discard(edge)
        if action == "confirm":
            confirmed[edge] = (rel, note)
        elif action == "remove_edge":
            confirmed = {
                e: v for e, v in confirmed.items()
                if not (e == edge if by_column else (e[0], e[2]) == (edge[0], edge[2]))
            }
        elif action == "remove_table":
            confirmed = {e: v for e, v in confirmed.items() if node not in (e[0], e[2])}
            suggested = {e for e in suggested if node not in (e[0], e[2])}
    return suggested, confirmed


def test_decisions_match_a_sequential_fold(spark):
    random.seed(2)
    pool = [(a, c, b, "k") for a in "ABC" for b in "XYZ" for c in ("p", "q")]
    suggested, confirmed = pool[:14], {e: ("one-to-one", "old") for e in pool[8:]}
    decisions = []
    for seq in range(120):
        action = random.choice(["confirm"] * 4 + ["dismiss", "remove_edge"] + ["remove_table"] * (seq % 17 == 0))
        decisions.append((seq, action, *random.choice(pool), "one-to-many", f"n{seq}", random.choice("ABCXYZ")))
    frames = (
        spark.createDataFrame(suggested, EDGE),
        spark.createDataFrame([(*e, *v) for e, v in confirmed.items()], f"{EDGE}, rel_type string, annotation string"),
        spark.createDataFrame(decisions, DECISION),
    )
    for by_column in (False, True):
        left, held = edges.apply_decisions(*frames, by_column=by_column)
        want_left, want_held = fold(suggested, confirmed, decisions, by_column)
        assert rows_of(left, "*") == sorted(want_left)
        assert rows_of(held, *edges.EDGE_KEY, "rel_type", "annotation") == sorted((*e, *v) for e, v in want_held.items())


def test_confirm_defaults_and_bulk(spark):
    suggested = spark.createDataFrame([("a", "x", "b", "y")], EDGE)
    none = spark.createDataFrame([], f"{EDGE}, rel_type string, annotation string")
    left, held = edges.apply_decisions(suggested, none, edges.decisions_for(suggested, "confirm"))
    assert left.count() == 0
    assert held.collect() == [Row(source_key="a", source_column="x", target_key="b", target_column="y", rel_type="one-to-many", annotation="")]


def test_suggestions_first_writer_wins(spark):
    schema = f"{EDGE}, confidence double"
    old = spark.createDataFrame([("a", "x", "b", "y", 0.9)], schema)
    new = spark.createDataFrame(
        [("a", "x", "b", "y", 0.1, 0), ("a", "x", "c", "y", 0.3, 2), ("a", "x", "c", "y", 0.2, 1)], f"{schema}, turn int"
    )
    assert rows_of(edges.add_suggestions(old, new, "turn"), "target_key", "confidence") == [("b", 0.9), ("c", 0.2)]


def test_review_filter_and_visible(spark):
    rows = spark.createDataFrame(
        [("c.S.a", "x", "c.S.b", "y", 0.9, "ai"), ("c.S.a", "x", "c.S.d", "y", 0.7, None), ("c.S.e", "x", "c.S.b", "y", 0.2, "pipeline")],
        f"{EDGE}, confidence double, origin string",
    )
    assert edges.review_filter(rows, origin="ai").count() == 1
    assert edges.review_filter(rows, origin="pipeline").count() == 2
    assert rows_of(edges.review_filter(rows, band="medium"), "confidence") == [(0.7,)]
    assert edges.review_filter(rows, table=" s.B ").count() == 2
    assert [r.confidence for r in edges.visible_edges(rows, 0.5, 1).collect()] == [0.9]
    assert edges.visible_edges(rows, 0.0, 0).count() == 0
    assert edges.visible_edges(rows, 1.1).count() == 0


def test_graph_upkeep(spark):
    schema = "id string, name string, created_by string, created_at string, version int, is_template boolean, parent_graph_id string, description string, database_server string, domain_tag string, updated_at string"
    graphs = spark.createDataFrame(
        [("g1", "One", "me", "t0", 1, True, None, "", "srv", "d", "t1"), ("g2", "Two", "you", "t0", 4, False, "g1", "Deep", "", "d", "t9")], schema
    )
    assert [r.id for r in stored_graphs.graph_list(graphs).collect()] == ["g1", "g2"]
    assert [r.id for r in stored_graphs.graph_list(graphs, kind="fork", text="DEEP", domain_tag="d").collect()] == ["g2"]
    saved = stored_graphs.save_graphs(graphs, graphs.where("id = 'g2'").withColumn("name", F.lit("New")).withColumn("created_by", F.lit("x")))
    assert rows_of(saved, "id", "name", "created_by") == [("g1", "One", "me"), ("g2", "New", "you")]
    snapshots = spark.createDataFrame([("g2", 4, "old")], "graph_id string, version int, snapshot string")
    edited = spark.createDataFrame([("g2", "now")], "graph_id string, snapshot string")
    raised, all_snapshots = stored_graphs.next_versions(graphs, snapshots, edited)
    assert rows_of(raised, "id", "version") == [("g1", 1), ("g2", 5)]
    assert stored_graphs.latest_snapshots(all_snapshots).first().snapshot == "now"
    assert rows_of(stored_graphs.delete_graphs(graphs, edited, key="id"), "id") == [("g1",)]


STORED = "id string, graph_id string, source_table_key string, source_column string, target_table_key string, target_column string, confirmed_by_count long"


def test_promotion(spark):
    sig, other = ("a", "x", "b", "y"), ("a", "x", "c", "y")
    rows = spark.createDataFrame(
        [("e1", "g1", *sig, 0), ("e2", "g2", *sig, 2), ("e3", "g3", *other, 0), ("e4", "g2", *other, 4)], STORED
    )
    own = spark.createDataFrame([("e2", "s1"), ("e2", "s9")], "edge_id string, session_id string")
    log = spark.createDataFrame(
        [(*sig, "s1"), (*sig, "s1"), (*sig, "s2")],
        "source_table_key string, source_column string, target_table_key string, target_column string, session_id string",
    )
    after = stored_graphs.record_confirmations(rows, own, log)
    assert rows_of(after, "id", "confirmed_by_count") == [("e1", 2), ("e2", 3), ("e3", 0), ("e4", 4)]
    assert rows_of(stored_graphs.graph_confirmers(rows, own, log, "g2"), "*") == [("e2", "s1"), ("e2", "s2"), ("e2", "s9")]
    held = stored_graphs.graph_confirmers(rows, own, log, "g1").unionByName(stored_graphs.graph_confirmers(rows, own, log, "g2"))
    twice = stored_graphs.record_confirmations(after, held, log)
    assert rows_of(twice, "id", "confirmed_by_count") == rows_of(after, "id", "confirmed_by_count")
    assert {(r.target_table_key, r.confirmations) for r in stored_graphs.confirmation_counts(after).collect()} == {("b", 3), ("c", 4)}
    assert [r.id for r in stored_graphs.promoted_edges(after, "g1").collect()] == ["e4"]
    assert [r.id for r in stored_graphs.promoted_edges(after, "g3").collect()] == ["e2"]


def test_edges_meet_a_small_log_without_a_shuffle_by_signature(spark):
    rows = spark.range(2000).selectExpr(
        "'e' || id AS id", "'g' || id % 100 AS graph_id", "'a' || id % 7 AS source_table_key", "'x' AS source_column",
        "'b' AS target_table_key", "'y' AS target_column", "0L AS confirmed_by_count",
    )
    own = spark.range(2000).selectExpr("'e' || id % 900 AS edge_id", "'s' || id % 3 AS session_id")
    log = rows.where("id < 'e3'").selectExpr(*stored_graphs.SIGNATURE, "'s' || substr(id, -1) AS session_id")
    after = stored_graphs.record_confirmations(rows, own, log)
    for frame in (after, stored_graphs.promoted_edges(after, "g1")):
        by_signature = [
            line for line in frame._jdf.queryExecution().executedPlan().toString().splitlines()
            if "Exchange hashpartitioning(source_table_key" in line
        ]
        assert len(by_signature) <= (frame is not after)  # the cut ranks only
    sessions = {f"e{n}": set() for n in range(2000)}
    for n in range(2000):
        sessions[f"e{n % 900}"].add(f"s{n % 3}")
    logged = {}
    for n in range(2000):
        if f"e{n}" < "e3":
            logged.setdefault(n % 7, set()).add(f"s{n % 10}")
    assert {r.id: r.confirmed_by_count for r in after.collect()} == {
        f"e{n}": len(sessions[f"e{n}"] | logged[n % 7]) for n in range(2000)
    }


def test_context_and_current_graph(spark):
    nodes = spark.createDataFrame(
        [("c.dbo.a", 3, {"x": "int"}), ("c.dbo.b", 4, {"y": "int"})], "node_key string, row_count long, columns map<string,string>"
    )
    described = spark.createDataFrame([("dbo.a", "x", "the x")], "table string, column string, description string")
    stored = {r.table_name: r for r in stored_graphs.stored_nodes(nodes, "g", described).collect()}
    assert stored["a"].descriptions == {"x": "the x"} and stored["b"].descriptions == {}
    assert stored["a"].connection_id == "c" and stored["a"].schema_name == "dbo"
    confirmed = spark.createDataFrame([("dbo.a", "x", "dbo.b", "y", "one-to-one", None)], f"{EDGE}, rel_type string, annotation string")
    kept = stored_graphs.stored_edges(confirmed, "g")
    assert kept.first().confidence == 1.0 and kept.first().annotation == ""
    frame = stored_graphs.stored_nodes(nodes, "g")
    assert stored_graphs.context_edges(frame, kept).count() == 1
    assert stored_graphs.context_edges(frame, kept, max_tables=1).count() == 0


def test_reports_and_saved_state(spark, tmp_path):
    nodes = spark.createDataFrame(
        [("c.dbo.a", "dbo", "a", 3, {"x": "int"})], "node_key string, schema_name string, table_name string, row_count long, columns map<string,string>"
    )
    confirmed = spark.createDataFrame([("c.dbo.a", "x", "c.dbo.b", "y", "one-to-one", "n")], f"{EDGE}, rel_type string, annotation string")
    suggested = spark.createDataFrame([("c.dbo.a", "x", "c.dbo.b", "z", 0.6, "low")], f"{EDGE}, confidence double, confidence_band string")
    notes = spark.createDataFrame([("c.dbo.a", "table note"), ("c.dbo.a->c.dbo.b", "edge note")], "key string, text string")
    described = spark.createDataFrame([("dbo.a", "x", "the x"), ("dbo.a", "gone", "no")], "table string, column string, description string")
    folder = str(tmp_path / "report")
    reports.write_report(folder, nodes, confirmed, suggested, notes, "T", descriptions=described, include_suggested=False)
    head = spark.read.json(f"{folder}/summary").first()
    assert (head.version, head.table_count, head.confirmed_relationship_count, head.suggested_relationship_count) == ("1.0.0", 1, 1, 0)
    table = spark.read.json(f"{folder}/tables").first()
    assert table.annotation == "table note" and table.column_descriptions.asDict() == {"x": "the x"}
    assert spark.read.json(f"{folder}/relationships").first().edge_annotation == "edge note"
    state = str(tmp_path / "state")
    connections = spark.createDataFrame([("srv", "db", "secret")], "server string, database string, password string")
    reports.save_state(state, connections, nodes.select("node_key"), confirmed, suggested.drop("confidence_band"), notes)
    assert "password" not in spark.read.json(f"{state}/connections").columns
    back = reports.load_edges(spark, state, "suggested", suggested.schema)
    assert back.first().confidence_band == "low"
    assert reports.load_edges(spark, str(tmp_path / "nothing"), "confirmed", confirmed.schema).count() == 0


def test_export_import_keeps_everything(spark, tmp_path):
    graphs = spark.createDataFrame([("g1", "One", "me"), ("g2", "Two", "me")], "id string, name string, created_by string")
    nodes = spark.createDataFrame([("n1", "g1", {"x": "int"}), ("n2", "g2", {})], "id string, graph_id string, columns map<string,string>")
    rows = spark.createDataFrame([("e1", "g1", ("why", 1)), ("e2", "g2", None)], "id string, graph_id string, evidence struct<a:string,b:int>")
    confirmers = spark.createDataFrame([("e1", "s1"), ("e2", "s2")], "edge_id string, session_id string")
    folder = str(tmp_path / "g1")
    reports.export_graph(folder, "g1", graphs, nodes, rows, confirmers)
    schemas = {"graph": graphs.schema, "nodes": nodes.schema, "edges": rows.schema, "confirmers": confirmers.schema}
    parts = reports.import_graph(spark, folder, schemas, "new", "you")
    assert rows_of(parts["graph"], "id", "created_by") == [("new", "you")]
    edge = parts["edges"].first()
    assert (edge.id, edge.graph_id, edge.evidence.a) == ("new:e1", "new", "why")
    assert parts["nodes"].first().columns == {"x": "int"}
    assert rows_of(parts["confirmers"], "edge_id", "session_id") == [("new:e1", "s1")]
    turns = spark.createDataFrame([(2, 1, "b"), (1, 2, "d"), (1, 1, "c")], "conv_id int, turn int, question string")
    reports.export_conversations(str(tmp_path / "talk"), turns)
    assert spark.read.json(str(tmp_path / "talk")).count() == 3


def test_names_of_several_nodes_are_left_out(spark):
    nodes = spark.createDataFrame([("c1.dbo.T",), ("c1.ods.T",), ("c1.dbo.U",)], "node_key string")
    rows = [("T", "k", "U", "k", "r", "", 1), ("c1.ods.T", "k", "U", "k", "r", "", 2), ("U", "k", "V", "k", "r", "", 3)]
    edited = spark.createDataFrame(
        rows, "source string, source_column string, target string, target_column string, rel_type string, annotation string, seq long"
    )
    assert rows_of(edges.confirmed_from_edit(edited, nodes), "source_key", "target_key") == [("c1.ods.T", "c1.dbo.U")]
    assert rows_of(edges.ambiguous_edits(edited, nodes), "source", "target", "source_nodes", "target_nodes") == [("T", "U", 2, 1)]


def test_bulk_decisions_are_repeatable(spark):
    frame = spark.createDataFrame([("a", "x", "b", "y"), ("a", "x", "b", "y"), ("c", "x", "b", "y")], list(edges.EDGE_KEY))
    first = edges.decisions_for(frame, "dismiss", 5)
    assert rows_of(first) == rows_of(edges.decisions_for(frame.repartition(3), "dismiss", 5))
    assert first.count() == 2 and {r.seq for r in first.collect()} == {5}


def test_repeated_descriptions(spark):
    nodes = spark.createDataFrame([("c1.dbo.T", 5, {"k": "int"})], "node_key string, row_count long, columns map<string,string>")
    said = spark.createDataFrame([("dbo.T", "k", "old", 1), ("dbo.T", "k", "new", 2)], "table string, column string, description string, batch_id long")
    assert stored_graphs.stored_nodes(nodes, "g", said).first().descriptions == {"k": "new"}
    assert stored_graphs.stored_nodes(nodes, "g", said.drop("batch_id")).first().descriptions == {"k": "old"}
