"""The given tables as a catalogue, and the relations the queries derive from them.

The derived relations (stored graphs, review decisions, snapshots, turns) are written in
SQL that Spark and DuckDB both read, so that either engine builds the same input from
the whole tables.
"""

from __future__ import annotations

from typing import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tieweave.session import materialize
from tieweave.sources.catalog import Catalog

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)
SCHEMA_NAME = "main"


def _key(table: str, column: str, name: str) -> dict:
    return {
        "table_key": f"{SCHEMA_NAME}.{table}", "key_name": name, "is_primary_key": True,
        "is_unique": True, "column_name": column, "key_ordinal": 1,
    }


def _fk(source: str, source_column: str, target: str, target_column: str) -> dict:
    return {
        "constraint_name": f"fk_{source}_{target}",
        "source_schema": SCHEMA_NAME, "source_table": source, "source_column": source_column,
        "target_schema": SCHEMA_NAME, "target_table": target, "target_column": target_column,
    }


PRIMARY_KEYS = {
    "region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey",
    "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey",
    "events": "event_id", "documents": "doc_id", "embeddings": "vec_id",
    "pages": "page_id", "benchmark": "item_id",
}
FOREIGN_KEYS = (
    ("nation", "n_regionkey", "region", "r_regionkey"),
    ("customer", "c_nationkey", "nation", "n_nationkey"),
    ("supplier", "s_nationkey", "nation", "n_nationkey"),
    ("orders", "o_custkey", "customer", "c_custkey"),
    ("lineitem", "l_orderkey", "orders", "o_orderkey"),
    ("lineitem", "l_partkey", "part", "p_partkey"),
    ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
    ("labels", "doc_id", "documents", "doc_id"),
)


def catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    return Catalog.from_parquet(
        spark,
        {name: f"{sf_dir}/{name}.parquet" for name in TABLES},
        SCHEMA_NAME,
        keys=tuple(_key(t, c, f"pk_{t}") for t, c in PRIMARY_KEYS.items()),
        foreign_keys=tuple(_fk(*parts) for parts in FOREIGN_KEYS),
    )


def derived(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Run a derived-relation query over the given tables."""
    for name in TABLES:
        if name in sql:
            spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
    return spark.sql(sql)


# -- graphs kept side by side: one graph per customer, one edge per part kind and nation

_LINES = """
    lineitem JOIN orders ON l_orderkey = o_orderkey
             JOIN customer ON o_custkey = c_custkey
             JOIN part ON l_partkey = p_partkey
             JOIN supplier ON l_suppkey = s_suppkey
"""
_LINE_COLUMNS = """
    c_custkey, c_nationkey, p_brand, p_type, s_nationkey, l_linestatus, l_quantity, l_tax, l_returnflag
"""
_SIGNATURE = """
    'dbo.' || p_brand AS source_table_key, p_type AS source_column,
    'dbo.Nation' || s_nationkey AS target_table_key, 's_nationkey' AS target_column
"""
_EDGE_ID = "'g' || c_custkey || ':' || p_brand || '/' || p_type || '/' || s_nationkey"

STORED_EDGES = f"""
SELECT {_EDGE_ID} AS id, 'g' || c_custkey AS graph_id, {_SIGNATURE},
       CASE WHEN count(CASE WHEN l_linestatus = 'F' THEN 1 END) > 0 THEN 'confirmed' ELSE 'suggested' END AS edge_type,
       round(max(l_quantity) / 50.0, 4) AS confidence,
       'one-to-many' AS rel_type,
       'lines: ' || count(*) AS annotation,
       CASE WHEN max(l_tax) > 0.04 THEN 'user' ELSE 'ai' END AS origin,
       CASE WHEN count(CASE WHEN l_returnflag = 'R' THEN 1 END) > 0 THEN CAST(1 AS BIGINT)
            ELSE CAST(0 AS BIGINT) END AS confirmed_by_count
FROM {_LINES}
GROUP BY c_custkey, p_brand, p_type, s_nationkey
"""
CONFIRMERS = f"""
SELECT DISTINCT {_EDGE_ID} AS edge_id, 'u' || c_nationkey AS session_id
FROM {_LINES} WHERE l_returnflag = 'R'
"""
CONFIRMATION_LOG = f"""
SELECT {_SIGNATURE}, 'u' || c_nationkey AS session_id
FROM {_LINES} WHERE l_returnflag = 'A'
"""


def derived_from_lines(spark: SparkSession, sf_dir: str, queries: Iterable[str]) -> list[DataFrame]:
    """``derived`` for several queries over the same lines, which are joined and written once."""
    lines = materialize(derived(spark, sf_dir, f"SELECT {_LINE_COLUMNS} FROM {_LINES}"), "lines")
    lines.createOrReplaceTempView("joined_lines")
    return [spark.sql(sql.replace(_LINES, " joined_lines ")) for sql in queries]


STORED_NODES = """
SELECT DISTINCT 'g' || o_custkey || ':' || p_brand AS id, 'g' || o_custkey AS graph_id,
       'conn1' AS connection_id, 'dbo' AS schema_name, p_brand AS table_name
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
UNION ALL
SELECT DISTINCT 'g' || o_custkey || ':Nation' || s_nationkey, 'g' || o_custkey,
       'conn1', 'dbo', 'Nation' || s_nationkey
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey
"""
GRAPHS = """
SELECT 'g' || c_custkey AS id, c_name AS name, 'Orders of ' || c_name AS description,
       c_mktsegment AS domain_tag, 'server' || c_nationkey AS database_server,
       'u' || c_nationkey AS created_by, min(o_orderdate) AS created_at,
       max(o_orderdate) AS updated_at, count(o_orderkey) AS version,
       c_acctbal > 9000 AS is_template,
       CASE WHEN c_acctbal < 0 THEN 'g0' END AS parent_graph_id
FROM customer LEFT JOIN orders ON o_custkey = c_custkey
GROUP BY c_custkey, c_name, c_mktsegment, c_nationkey, c_acctbal
"""
SNAPSHOTS = """
SELECT 'g' || o_custkey AS graph_id, o_orderkey AS version,
       o_orderstatus || ':' || o_orderpriority AS snapshot
FROM orders
"""

# -- the current graph under review: one edge per user and tens digit, decided by events

_K = "CAST(regexp_extract(props, '[0-9]+', 0) AS INT)"
_EVENT_EDGE = f"""
    'c1.dbo.U' || user_id AS source_key, 'k' || ({_K} % 2) AS source_column,
    'c1.dbo.T' || CAST(floor({_K} / 10) AS INT) AS target_key, 'k' AS target_column
"""
REVIEW_SUGGESTED = f"""
SELECT source_key, source_column, target_key, target_column,
       round(max(value) / 50.0, 4) AS confidence,
       CASE WHEN count(CASE WHEN event_type = 'click' THEN 1 END) > 0 THEN 'ai' ELSE 'pipeline' END AS origin
FROM (SELECT {_EVENT_EDGE}, value, event_type FROM events) e
GROUP BY source_key, source_column, target_key, target_column
"""
REVIEW_CONFIRMED = f"""
SELECT DISTINCT {_EVENT_EDGE}, 'one-to-one' AS rel_type, 'seed' AS annotation
FROM events WHERE event_type = 'signup'
"""
REVIEW_DECISIONS = f"""
SELECT event_id AS seq,
       CASE event_type WHEN 'purchase' THEN 'confirm' WHEN 'error' THEN 'dismiss'
            WHEN 'click' THEN 'remove_edge'
            ELSE CASE WHEN event_type = 'view' AND value < 0.1 THEN 'remove_table' ELSE 'look' END END AS action,
       {_EVENT_EDGE},
       CASE WHEN value > 20 THEN 'many-to-one' ELSE 'one-to-many' END AS rel_type,
       'event ' || event_id AS annotation,
       'c1.dbo.U' || user_id AS node_key
FROM events
"""
REVIEW_NODES = """
SELECT DISTINCT 'c1.dbo.U' || user_id AS node_key FROM events
"""
REVIEW_NOTES = f"""
SELECT source_key || '->' || target_key AS key, event_type || ' ' || seq AS text, seq
FROM (SELECT {_EVENT_EDGE}, event_type, event_id AS seq FROM events) e
"""
REVIEW_EDITS = f"""
SELECT 'U' || user_id AS source, 'k' || ({_K} % 2) AS source_column,
       'T' || CAST(floor({_K} / 10) AS INT) AS target, 'k' AS target_column,
       CASE WHEN value > 20 THEN 'many-to-one' ELSE 'one-to-many' END AS rel_type,
       event_type AS annotation, event_id AS seq
FROM events
"""
EDIT_NODES = f"""
SELECT DISTINCT 'c1.dbo.U' || user_id AS node_key FROM events WHERE value > 1
UNION
SELECT DISTINCT 'c1.dbo.T' || CAST(floor({_K} / 10) AS INT) FROM events
"""

# Every third table twice, in two schemas.
AMBIGUOUS_NODES = f"""
{EDIT_NODES}
UNION
SELECT DISTINCT 'c1.ods.T' || CAST(floor({_K} / 10) AS INT) FROM events WHERE floor({_K} / 10) % 3 = 0
"""

# Decimals beyond bigint and double, of either sign.
WIDE_DECIMALS = """
SELECT CAST(l_orderkey AS DECIMAL(18,0)) * CAST(1000000007 AS DECIMAL(20,0)) * (l_partkey - 1000) AS product,
       CAST(l_extendedprice AS DECIMAL(12,2)) * CAST('0.000000000001' AS DECIMAL(12,12)) * CAST(l_suppkey - 50 AS DECIMAL(5,0)) AS small,
       CAST(l_linenumber AS DECIMAL(38,0)) AS plain
FROM lineitem
"""

# -- two snapshots of many small tables: early and late line numbers

_DRIFT_TABLE = "'dbo.P' || l_partkey || 'Q' || CAST(floor(l_quantity / 10) AS INT)"


def _drift_tables(condition: str) -> str:
    return f"SELECT {_DRIFT_TABLE} AS table_key, count(*) AS row_count FROM lineitem WHERE {condition} GROUP BY 1"


def _drift_columns(condition: str) -> str:
    return f"""
SELECT {_DRIFT_TABLE} AS table_key, 'S' || l_suppkey AS column_name,
       CASE max(CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END)
            WHEN 1 THEN 'int' WHEN 2 THEN 'bigint' ELSE 'string' END AS data_type,
       count(CASE WHEN l_linestatus = 'O' THEN 1 END) > 0 AS is_nullable
FROM lineitem WHERE {condition} GROUP BY 1, 2
"""


PREVIOUS_TABLES, PREVIOUS_COLUMNS = _drift_tables("l_linenumber <= 5"), _drift_columns("l_linenumber <= 5")
CURRENT_TABLES, CURRENT_COLUMNS = _drift_tables("l_linenumber >= 3"), _drift_columns("l_linenumber >= 3")

# -- five snapshots of the same tables: three line numbers each

_VERSIONS = "(SELECT DISTINCT CAST(l_linenumber AS BIGINT) AS version FROM lineitem WHERE l_linenumber <= 5) v"
_SEEN = f"lineitem JOIN {_VERSIONS} ON l_linenumber BETWEEN version AND version + 2"
HISTORY_VERSIONS = f"SELECT version FROM {_VERSIONS}"
HISTORY_TABLES = f"SELECT version, {_DRIFT_TABLE} AS table_key, count(*) AS row_count FROM {_SEEN} GROUP BY 1, 2"
HISTORY_COLUMNS = f"""
SELECT version, {_DRIFT_TABLE} AS table_key, 'S' || l_suppkey AS column_name,
       CASE max(CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END)
            WHEN 1 THEN 'int' WHEN 2 THEN 'bigint' ELSE 'string' END AS data_type,
       count(CASE WHEN l_linestatus = 'O' THEN 1 END) > 0 AS is_nullable
FROM {_SEEN} GROUP BY 1, 2, 3
"""

# -- what reviewers say of aliases and columns

ALIAS_FEEDBACK = """
SELECT CASE WHEN event_id % 2 = 0 THEN ' User_' ELSE 'user_' END || (user_id % 100) || CASE WHEN event_id % 3 = 0 THEN ' ' ELSE '' END AS alias,
       event_type AS alias_group, event_id AS seq
FROM events
UNION ALL SELECT 'O_CustKey', 'order key', max(event_id) + 1 FROM events
"""

DESCRIBED_COLUMNS = f"""
SELECT DISTINCT 'dbo.U' || user_id AS table_key, regexp_extract(props, '[0-9]+', 0) AS column_name FROM events
UNION ALL SELECT DISTINCT 'dbo.U' || user_id, 'never described' FROM events
"""

# -- turns of the conversations, and responses that list the lines of an order

TURNS = """
SELECT u.conv_id, u.turn, u.text AS question, coalesce(a.text, '') AS answer
FROM conversations u
LEFT JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
WHERE u.role = 'user'
"""
RESPONSE_NODES = """
SELECT 'conn1.dbo.S' || s_suppkey AS node_key, 'dbo.S' || s_suppkey AS table_key FROM supplier WHERE s_acctbal > 0
UNION ALL
SELECT 'conn1.dbo.P' || p_partkey, 'dbo.P' || p_partkey FROM part
"""


def _wrapped(kind, body):
    """Eight ways in which a list comes back, two of them unreadable."""
    curly = F.regexp_replace(body, '"', "”")
    return (
        F.when(kind == 0, F.concat(F.lit("["), body, F.lit("]")))
        .when(kind == 1, F.concat(F.lit("```json\n["), body, F.lit("]\n```")))
        .when(kind == 2, F.concat(F.lit('{"relationships": ['), body, F.lit("]}")))
        .when(kind == 3, F.concat(F.lit("["), body, F.lit(", ]")))
        .when(kind == 4, F.concat(F.lit("["), curly, F.lit("]")))
        .when(kind == 5, F.concat(F.lit("Here you are:\n["), body, F.lit("]\nAnything else?")))
        .when(kind == 6, F.concat(F.lit("["), body))
        .otherwise(F.lit("I cannot tell."))
    )


def _responses(lines: DataFrame, item, batch: str) -> DataFrame:
    return (
        lines.withColumn("item", F.to_json(item))
        .groupBy(batch)
        .agg(F.sort_array(F.collect_list("item")).alias("items"))
        .select(
            F.col(batch).alias("batch_id"),
            _wrapped(F.col(batch) % 8, F.array_join("items", ", ")).alias("text"),
        )
    )


def relationship_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    item = F.struct(
        F.concat(F.lit("dbo.S"), "l_suppkey").alias("source_table"),
        F.concat(F.lit("k"), "l_linenumber").alias("source_column"),
        F.concat(F.lit("dbo.P"), "l_partkey").alias("target_table"),
        F.lit("p").alias("target_column"),
        F.when(F.col("l_returnflag") != "N", F.round(F.col("l_quantity") / 50, 2)).alias("confidence"),
        F.concat(F.lit("flag "), "l_returnflag").alias("reasoning"),
        F.when(F.col("l_linestatus") == "F", "many-to-one").alias("rel_type"),
    )
    return _responses(lines, item, "l_orderkey")


def description_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    item = F.struct(
        F.concat(F.lit("dbo.U"), "user_id").alias("table"),
        F.regexp_extract("props", "[0-9]+", 0).alias("column"),
        F.concat(F.lit("seen by "), "event_type", F.lit(" "), "event_id").alias("description"),
        F.array("event_type").alias("domain_terms"),
    )
    return _responses(events.withColumn("batch", F.floor(F.col("event_id") / 10)), item, "batch")
