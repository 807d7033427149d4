import json

from pyspark.sql import functions as F

from tieweave.operators import drift, responses, talk
from tieweave.sources.catalog import Catalog
from tieweave.sources.snapshots import load_snapshot, save_snapshot

REL = {"source_table": "s.a", "source_column": "x", "target_table": "s.b", "target_column": "y", "confidence": 0.9,
       "reasoning": "same [id]", "rel_type": "one-to-one"}
PLAIN = json.dumps([REL])
CASES = {
    "plain": PLAIN,
    "fenced": f"Sure:\n```json\n{PLAIN}\n```\nDone",
    "wrapper": json.dumps({"relationships": [REL]}),
    "trailing": PLAIN[:-2] + ",}\n, ]",
    "curly": PLAIN.replace('"', "“"),
    "chatty": f"Here: {PLAIN} and that is all",
    "mixed": json.dumps([1, "text", None, REL]),
    "truncated": PLAIN.replace("[id]", "id")[:-1],
    "nothing": "no idea",
    "object": '{"other": 1}',
    "two": f"{PLAIN} then {PLAIN}",
    "tail": f"{PLAIN}, {PLAIN}",
    "stray": f"{PLAIN} ], []",
    "defaults": '[{"source_table": "s.a", "confidence": "0.75"}]',
    "bare": '[{"source_table": "s.a"}]',
    "empty": "[]",
}


def parsed(spark):
    frame = spark.createDataFrame(list(CASES.items()), "batch_id string, text string")
    return responses.parse_responses(frame)


def test_responses(spark):
    rows = {}
    for r in responses.relationships(parsed(spark)).collect():
        rows.setdefault(r.batch_id, []).append(r)
    for name in ("plain", "fenced", "wrapper", "trailing", "curly", "chatty", "mixed"):
        assert len(rows[name]) == 1, name
        r = rows[name][0]
        assert (r.source_table, r.target_column, r.confidence, r.reasoning, r.rel_type) == ("s.a", "y", 0.9, "same [id]", "one-to-one"), name
    d = rows["defaults"][0]
    assert (d.confidence, d.target_table, d.rel_type) == (0.75, "", "one-to-many")
    assert rows["bare"][0].confidence == 0.5
    errors = {r.batch_id: r.truncated for r in responses.response_errors(parsed(spark)).collect()}
    assert errors == {"truncated": True, "nothing": True, "object": True, "two": False, "tail": False, "stray": False}


def test_descriptions(spark):
    texts = [
        (1, '[{"table": "s.a", "column": "x", "description": "first", "domain_terms": ["t1", "t2"]}]'),
        (2, '[{"table": "s.a", "column": "x", "description": "second", "domain_terms": "oops"}, {"table": "s.a", "column": "y"}]'),
    ]
    found = responses.column_descriptions(responses.parse_responses(spark.createDataFrame(texts, "batch_id int, text string")))
    rows = {(r.batch_id, r.column): r for r in found.collect()}
    assert rows[1, "x"].domain_terms == ["t1", "t2"] and rows[2, "x"].domain_terms == []
    assert rows[2, "y"].description == ""
    lookup = {(r.table, r.column): r.description for r in responses.description_lookup(found).collect()}
    assert lookup == {("s.a", "x"): "second", ("s.a", "y"): ""}
    columns = spark.createDataFrame([("s.a", "x"), ("s.a", "q")], "table_key string, column_name string")
    told = {r.column_name: r.description for r in responses.describe_columns(columns, responses.description_lookup(found)).collect()}
    assert told == {"x": "second", "q": None}


def test_history(spark):
    turns = spark.createDataFrame([(1, t, f"q{t}", "" if t == 2 else f"a{t}") for t in range(5)], "conv_id int, turn int, question string, answer string")
    messages = talk.turn_messages(turns)
    assert messages.count() == 9
    kept = [r.content for r in talk.prune_history(messages, 2).orderBy("turn", "part").collect()]
    assert kept == ["q3", "a3", "q4", "a4"]
    assert [r.content for r in talk.context_tail(messages).orderBy("turn", "part").collect()] == ["a1", "q2", "q3", "a3", "q4", "a4"]


def test_bounded_read(spark):
    rows = spark.range(10)
    cut = talk.bounded_read(rows, ("id",), 4).collect()
    assert [r.id for r in cut] == [0, 1, 2, 3] and all(r.truncated and r.returned_rows == 4 for r in cut)
    whole = talk.bounded_read(rows, ("id",), 10).collect()
    assert len(whole) == 10 and not whole[0].truncated


def snapshot(spark, tables):
    t = spark.createDataFrame([(k, n) for k, (n, _) in tables.items()], "table_key string, row_count long")
    c = spark.createDataFrame(
        [(k, name, kind, null) for k, (_, cols) in tables.items() for name, kind, null in cols],
        "table_key string, column_name string, data_type string, is_nullable boolean",
    )
    return t, c


def test_drift(spark):
    base = ("id", "int", False)
    was = snapshot(spark, {"d.same": (5, [base]), "d.rows": (5, [base]), "d.cols": (5, [base, ("old", "int", True), ("n", "int", True)]), "d.gone": (1, [base])})
    now = snapshot(spark, {"d.same": (5, [base]), "d.rows": (6, [base]), "d.cols": (9, [("id", "bigint", True), ("new", "date", True), ("n", "int", True)]), "d.fresh": (1, [base])})
    changes = drift.column_changes(now[0], now[1], was[0], was[1])
    found = sorted(tuple(r) for r in changes.collect())
    assert found == [
        ("d.cols", "id", "nullability_changed", "False", "True"),
        ("d.cols", "id", "type_changed", "int", "bigint"),
        ("d.cols", "new", "added", None, "date"),
        ("d.cols", "old", "removed", "int", None),
    ]
    verdicts = drift.table_verdicts(now[0], was[0], changes)
    assert {r.table_key: (r.verdict, r.old_row_count, r.new_row_count) for r in verdicts.collect()} == {
        "d.same": ("unchanged", 5, 5), "d.rows": ("row_count_changed", 5, 6), "d.cols": ("columns_changed", 5, 9),
        "d.gone": ("removed", 0, 0), "d.fresh": ("new", 0, 0),
    }
    assert tuple(drift.drift_summary(verdicts).first()) == (1, 1, 3, 1, True)


def test_snapshot_round_trip(spark, tmp_path):
    c = Catalog(spark, {"d.t": spark.createDataFrame([(1, "x")], "a int, b string")})
    folder = str(tmp_path / "snapshots")
    assert load_snapshot(spark, folder, "one")[0].count() == 0
    save_snapshot(c.inventory(), folder, "one")
    save_snapshot(c.inventory(), folder, "two")
    tables, columns = load_snapshot(spark, folder, "one")
    assert tables.count() == 1 and columns.count() == 2
    now_t, now_c = drift.snapshot_tables(c.inventory()), drift.snapshot_columns(c.inventory())
    changes = drift.column_changes(now_t, now_c, tables, columns)
    summary = drift.drift_summary(drift.table_verdicts(now_t, tables, changes)).first()
    assert (summary.has_drift, summary.unchanged_tables) == (False, 1)


def test_a_response_is_read_once(spark):
    rows = spark.createDataFrame([(1, '[{"table": "t"}]'), (2, "none"), (3, None)], "batch_id int, text string")
    parsed = responses.parse_responses(rows.repartition(2))
    assert [r.batch_id for r in responses.response_errors(parsed).orderBy("batch_id").collect()] == [2, 3]
    for found in (responses.response_errors(parsed), responses.relationships(parsed)):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        # The fence and the list, each once.
        assert plan.count("regexp_extract(") == 2 and plan.count("parseJson(") <= 6
