from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tieweave.functions.families import declared_family, spark_family, type_decision
from tieweave.functions.text import node_parts, short_label
from tieweave.sources.catalog import Catalog, columns_from_declared, inventory, list_databases
from tieweave.sources.jdbc import base_tables, bracketed, index_keys, partition_row_counts, resolve_foreign_keys


def test_declared_families(spark):
    cases = {
        "nvarchar(255)": "string", "DECIMAL(18,2)": "numeric", " int ": "numeric", "bit": "boolean",
        "datetime2(7)": "datetime", "timestamp": "other", "varbinary(max)": "binary", "geography": "spatial",
        "json": "json", "uniqueidentifier": "other", "strange": "unknown",
    }
    rows = spark.createDataFrame([(k, v) for k, v in cases.items()], "t string, want string")
    assert rows.where(declared_family(F.col("t")) != F.col("want")).count() == 0


def test_spark_families():
    assert spark_family(T.DecimalType(10, 2)) == "numeric"
    assert spark_family(T.TimestampNTZType()) == "datetime"
    assert spark_family(T.BooleanType()) == "boolean"
    assert spark_family(T.ArrayType(T.FloatType())) == "other"
    assert spark_family(T.VariantType()) == "json"
    assert spark_family(T.NullType()) == "unknown"


def test_type_decisions(spark):
    rows = spark.createDataFrame(
        [("numeric", "numeric"), ("numeric", "string"), ("datetime", "string"), ("unknown", "unknown")], "a string, b string"
    )
    strict = [r.d for r in rows.select(type_decision(F.col("a"), F.col("b"), True).alias("d")).collect()]
    relaxed = [r.d for r in rows.select(type_decision(F.col("a"), F.col("b"), False).alias("d")).collect()]
    assert [(d.compatible, d.risk) for d in strict] == [
        (True, None), (False, "incompatible"), (False, "incompatible"), (True, None)
    ]
    assert [(d.compatible, d.risk) for d in relaxed] == [
        (True, None), (True, "cast_required"), (False, "incompatible"), (True, None)
    ]
    assert relaxed[1].reason == "Cross-family cast: numeric <-> string"
    assert strict[2].reason == "Incompatible families: datetime vs string"


def catalog(spark):
    return Catalog(
        spark,
        {
            "dbo.b": spark.createDataFrame([(1, "x"), (2, None)], "id int, name string"),
            "dbo.a": spark.createDataFrame([], "k bigint, when timestamp"),
        },
        keys=(
            {"table_key": "dbo.b", "key_name": "ix", "is_primary_key": False, "is_unique": False, "column_name": "name", "key_ordinal": 1},
            {"table_key": "dbo.b", "key_name": "pk", "is_primary_key": True, "is_unique": True, "column_name": "name", "key_ordinal": 2},
            {"table_key": "dbo.b", "key_name": "pk", "is_primary_key": True, "is_unique": True, "column_name": "id", "key_ordinal": 1},
            {"table_key": "dbo.b", "key_name": None, "is_primary_key": False, "is_unique": False, "column_name": "id", "key_ordinal": 1},
        ),
        foreign_keys=(
            {"constraint_name": "fk", "source_schema": "dbo", "source_table": "b", "source_column": "id",
             "target_schema": "dbo", "target_table": "a", "target_column": "k"},
        ),
        nullable={("dbo.b", "id"): False},
    )


def test_inventory(spark):
    rows = {r.table_key: r for r in catalog(spark).inventory().collect()}
    assert rows["dbo.a"].row_count == 0 and rows["dbo.a"]["keys"] == [] and rows["dbo.a"].foreign_keys == []
    b = rows["dbo.b"]
    assert b.row_count == 2
    assert [(c.column_name, c.native_type, c.is_nullable) for c in b.columns] == [("id", "int", False), ("name", "string", True)]
    assert [k.key_name for k in b["keys"]] == ["pk", "ix"]
    assert b.primary_key == ["id", "name"]
    assert b.foreign_keys[0].target_table == "a"


def test_inventory_filters(spark):
    c = catalog(spark)
    parts = (c.tables_frame(), c.columns_frame(), c.keys_frame(), c.foreign_keys_frame(), c.row_counts())
    wanted = spark.createDataFrame([("dbo", "a"), ("dbo", "a")], "schema_name string, table_name string")
    assert [r.table_key for r in inventory(*parts, wanted=wanted).collect()] == ["dbo.a"]
    assert inventory(*parts, schemas=["other"]).count() == 0
    assert list(c.only(["dbo.b", "dbo.b", "dbo.zz"]).tables) == ["dbo.b"]


def test_directory_and_database(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "t1.parquet"))
    spark.range(2).write.parquet(str(tmp_path / "t2"))
    c = Catalog.from_directory(spark, str(tmp_path), "lake")
    assert sorted(c.tables) == ["lake.t1", "lake.t2"]
    assert {r.table_key: r.row_count for r in c.row_counts().collect()} == {"lake.t1": 3, "lake.t2": 2}
    assert [r.database for r in list_databases(spark).collect()] == ["default"]


def test_declared_columns_and_system_views(spark):
    declared = spark.createDataFrame(
        [("dbo", "t", "c", "nvarchar(5)", "NO", 1)],
        "schema_name string, table_name string, column_name string, native_type string, is_nullable string, ordinal int",
    )
    row = columns_from_declared(declared).first()
    assert (row.table_key, row.family, row.is_nullable) == ("dbo.t", "string", False)
    raw = spark.createDataFrame(
        [("s", "b", "BASE TABLE"), ("s", "v", "VIEW"), ("s", "a", "BASE TABLE")],
        "TABLE_SCHEMA string, TABLE_NAME string, TABLE_TYPE string",
    )
    assert [r.table_key for r in base_tables(raw).collect()] == ["s.a", "s.b"]
    names = spark.createDataFrame([(1, "s", "a"), (2, "s", "b")], "object_id int, schema_name string, table_name string")
    partitions = spark.createDataFrame([(1, 0, 5), (1, 1, 6), (1, 2, 99)], "object_id int, index_id int, rows long")
    assert partition_row_counts(partitions, names).collect() == [Row(table_key="s.a", row_count=11)]
    constraints = spark.createDataFrame([(9, "fk1")], "object_id int, name string")
    parts = spark.createDataFrame(
        [(9, 1, 1, 2, 5)],
        "constraint_object_id int, parent_object_id int, parent_column_id int, referenced_object_id int, referenced_column_id int",
    )
    # The second table has lost columns 2 to 4, so its second column has the id 5.
    columns = spark.createDataFrame(
        [(1, 1, "x"), (2, 1, "y"), (2, 5, "z"), (7, 1, "elsewhere")], "object_id int, column_id int, name string"
    )
    fk = resolve_foreign_keys(constraints, parts, columns, names).collect()
    assert fk == [Row(constraint_name="fk1", source_schema="s", source_table="a", source_column="x",
                      target_schema="s", target_table="b", target_column="z")]
    indexes = spark.createDataFrame(
        [(2, 1, "pk_b", True, True), (2, 0, None, False, False)],
        "object_id int, index_id int, name string, is_primary_key boolean, is_unique boolean",
    )
    places = spark.createDataFrame(
        [(2, 1, 5, 1), (2, 1, 1, 2), (2, 1, 1, 0)], "object_id int, index_id int, column_id int, key_ordinal int"
    )
    keys = index_keys(indexes, places, columns, names).collect()
    assert [(r.table_key, r.key_name, r.column_name, r.key_ordinal, r.is_primary_key) for r in keys] == [
        ("s.b", "pk_b", "z", 1, True), ("s.b", "pk_b", "y", 2, True)
    ]
    assert bracketed("a]b") == "[a]]b]"


def test_labels_and_parts(spark):
    rows = spark.createDataFrame([("c.s.t",), ("s.t",), ("t",)], "k string")
    assert [r.l for r in rows.select(short_label(F.col("k")).alias("l")).collect()] == ["s.t", "s.t", "t"]
    found = [tuple(r.p) for r in rows.select(node_parts(F.col("k")).alias("p")).collect()]
    assert found == [("c", "s", "t"), ("", "s", "t"), ("", "", "")]


def test_pairs_across_connections(spark):
    from tieweave.operators.candidates import candidate_pairs
    from tieweave.plans.analysis import run_analysis

    one = Catalog(spark, {"dbo.t": spark.range(5).toDF("user_id")})
    two = Catalog(spark, {"dbo.t": spark.range(3, 9).toDF("user_id")})
    both = Catalog.of_connections(spark, {"a": one, "b": two})
    pair = candidate_pairs(both.columns_frame()).first()
    assert (pair.source_table, pair.target_table, pair.match_type) == ("a.dbo.t", "b.dbo.t", "exact_name")
    assert run_analysis(both, with_strings=False).value_evidence.first().exact_overlap_count == 2
