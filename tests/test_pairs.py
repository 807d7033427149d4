import random
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from tieweave.config import Config
from tieweave.functions.names import bare_name
from tieweave.operators import similar
from tieweave.operators.candidates import (
    alias_index,
    by_name_score,
    candidate_pairs,
    latest_aliases,
    similar_names,
    split_by_type,
)

SUFFIXES = ("_id", "_key", "_code", "_no", "_num", "_number")


def bare(name):
    name = name.lower().strip()
    for suffix in SUFFIXES:
        name = name.removesuffix(suffix)
    return name


def expected_similarity(a, b):
    raw = SequenceMatcher(None, a.lower(), b.lower()).ratio()
    return max(raw, 0.9) if bare(a) and bare(a) == bare(b) else raw


def columns(spark, *rows):
    return spark.createDataFrame(
        [(i, t, c, k, f) for i, (t, c, k, f) in enumerate(rows)],
        "col_id int, table_key string, column_name string, native_type string, family string",
    )


def found(frame):
    return {(r.source_table, r.source_column, r.target_table, r.target_column): r for r in frame.collect()}


def test_bare_names(spark):
    names = ["api_number", "WELL_ID", "lease_num", "x_key_id", "x_id_key", "_id", "plain", "a_number_no"]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", bare_name(F.col("n")).alias("b")).collect()
    assert {r.n: r.b for r in rows} == {n: bare(n) for n in names}


@pytest.mark.parametrize("minimum", [0.3, 0.6, 0.85, 1.0])
def test_similar_names_lose_no_pair(spark, minimum):
    random.seed(11)
    parts = ["api", "well", "oper", "name", "num", "id", "date", "key", "code", "no", "qty", "Zone"]
    names = {"_".join(random.choices(parts, k=random.randint(1, 3))) for _ in range(60)} | {"A", "a", "aab", "aba"}
    frame = spark.createDataFrame([("string", n) for n in names], "family_key string, column_name string")
    got = {(r.name_a, r.name_b): r for r in similar_names(frame, minimum).collect()}
    want = {(a, b): expected_similarity(a, b) for a in names for b in names if a != b}
    want = {pair: v for pair, v in want.items() if v >= minimum}
    assert {pair: round(v, 4) for pair, v in want.items()} == {pair: r.rounded for pair, r in got.items()}
    assert all(r.shown == f"{want[pair]:.2f}" for pair, r in got.items())


def test_match_types_and_priority(spark):
    rows = columns(
        spark,
        ("dbo.a", "api_number", "nvarchar", "string"), ("dbo.b", "well_api", "nvarchar", "string"),
        ("dbo.a", "name", "nvarchar", "string"), ("dbo.b", "name", "nvarchar", "string"),
        ("dbo.a", "well_name", "nvarchar", "string"), ("dbo.b", "wellname", "nvarchar", "string"),
        ("dbo.a", "when_at", "date", "datetime"), ("dbo.b", "when_at", "int", "numeric"),
        ("dbo.a", "Code", "int", "numeric"), ("dbo.b", "code", "int", "numeric"),
    )
    config = Config(aliases={"api": ("api_number", "WELL_API "), "w": ("well_name",)})
    got = found(candidate_pairs(rows, config))
    assert got["dbo.a", "api_number", "dbo.b", "well_api"].match_type == "alias"
    assert got["dbo.a", "api_number", "dbo.b", "well_api"].reason == "Alias group 'api': api_number <-> well_api"
    assert got["dbo.a", "name", "dbo.b", "name"].match_type == "exact_name"
    fuzzy = got["dbo.a", "well_name", "dbo.b", "wellname"]
    assert (fuzzy.match_type, fuzzy.name_score) == ("fuzzy", round(expected_similarity("well_name", "wellname"), 4))
    assert got["dbo.a", "Code", "dbo.b", "code"].name_score == 1.0
    assert ("dbo.a", "when_at", "dbo.b", "when_at") not in got
    scores = [r.name_score for r in by_name_score(candidate_pairs(rows, config)).collect()]
    assert scores == sorted(scores, reverse=True)


def test_exclusions_and_relaxed_types(spark):
    rows = columns(
        spark,
        ("dbo.a", "id", "int", "numeric"), ("dbo.b", "ID", "int", "numeric"), ("dbo.b", "id", "nvarchar", "string"),
        ("dbo.log_x", "id", "int", "numeric"),
    )
    got = found(candidate_pairs(rows, Config(table_patterns=("LOG",))))
    assert set(got) == {("dbo.a", "id", "dbo.b", "ID")}
    relaxed = candidate_pairs(rows, Config(type_compatibility="relaxed"))
    compatible, rejected = split_by_type(relaxed)
    assert found(compatible)["dbo.a", "id", "dbo.b", "id"].type_decision.risk == "cast_required"
    assert rejected.count() == 0
    assert candidate_pairs(rows, Config(column_patterns=("I",))).count() == 0


def test_alias_feedback(spark):
    index = alias_index(spark, {"one": ("x", "y"), "two": ("y",)})
    assert {r.alias: r.alias_group for r in index.collect()} == {"x": "one", "y": "two"}
    feedback = spark.createDataFrame([("X", "three", 1), ("x", "four", 2)], "alias string, alias_group string, seq int")
    assert {r.alias: r.alias_group for r in latest_aliases(index, feedback).collect()} == {"x": "four", "y": "two"}


def test_config_checks():
    with pytest.raises(ValueError):
        Config(name_similarity_min=0)
    with pytest.raises(ValueError):
        Config(scope="some")


@pytest.mark.parametrize("minimum", [0.35, 0.6, 0.8])
def test_similar_pairs_beside_brute_force(spark, monkeypatch, minimum):
    monkeypatch.setattr(similar, "TILE", 16)
    rng = random.Random(3)
    parts = ["cust", "order", "id", "date", "total", "num", "é", "_", "x" * 70, "name"]
    texts = sorted({"".join(rng.choices(parts, k=rng.randint(0, 4))) for _ in range(150)})
    frame = spark.createDataFrame([(s, t) for s in (1, 2) for t in texts[s::2]], "set_id int, text string")
    got = {(r.set_id, r.a, r.b): r.raw for r in similar.similar_pairs(frame, minimum).collect()}
    want = {}
    for s in (1, 2):
        for a in texts[s::2]:
            for b in texts[s::2]:
                raw = SequenceMatcher(None, a, b).ratio()
                if raw >= minimum:
                    want[s, a, b] = raw
    assert got == want


def test_subsequences_across_words():
    rng = random.Random(9)
    a = ["".join(rng.choices("abcd", k=n)) for n in (1, 63, 64, 65, 128, 130, 200)]
    b = ["".join(rng.choices("abce", k=n)) for n in (1, 64, 100, 129, 199)]
    left, right = similar.Tile(a), similar.Tile(b)
    letters, bits = left.masks()
    codes = np.array([[list(letters).index(p) if n < len(t) and p in letters else len(letters) for n, p in enumerate(row)]
                      for t, row in zip(b, right.points)])
    i, j = (x.ravel() for x in np.meshgrid(range(len(a)), range(len(b)), indexing="ij"))

    def plain(x, y):
        row = [0] * (len(y) + 1)
        for c in x:
            row, above = [0], row
            for k, d in enumerate(y):
                row.append(above[k] + 1 if c == d else max(above[k + 1], row[-1]))
        return row[-1]

    assert similar.subsequences(bits, codes, i, j).tolist() == [plain(a[x], b[y]) for x, y in zip(i, j)]
