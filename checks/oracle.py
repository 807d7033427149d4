"""SQL counterparts of the registered queries, for DuckDB on the same tables.

Written apart from the package: names are paired here with plain ``difflib`` over the
fixed schemas of the given tables, and everything else is stated in SQL.
"""

from __future__ import annotations

from difflib import SequenceMatcher
from itertools import combinations
from typing import Callable

from checks import given

# Schemas of the given tables.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}
FAMILIES = {
    "int": "numeric", "bigint": "numeric", "double": "numeric", "string": "string",
    "timestamp_ntz": "datetime", "array<float>": "other",
}
# Endings a bare name goes without, and column names that suggest categories.
SUFFIXES = ("_id", "_key", "_code", "_no", "_num", "_number")
HINT_NAMES = (
    "status", "type", "category", "class", "region", "state", "country", "county", "area", "zone", "code",
    "phase", "unit", "stage", "color", "grade", "lithology",
)
# Shapes of identifiers.
IDENTIFIERS = (r"^[A-Z0-9]{8,}$", r"^[A-Z]{2,}-\d{3,}", r"^\d{10,14}$", r"^[A-Z]{2}\d{5,}$")

ORACLE: dict[str, Callable[[], str]] = {}


def oracle(fn: Callable[[], str]) -> Callable[[], str]:
    ORACLE[fn.__name__] = fn
    return fn


def columns() -> list[tuple[str, str, str, str, int]]:
    """(table, column, type, family, ordinal) of every given column."""
    found = []
    for table in sorted(SCHEMAS):
        for n, part in enumerate(SCHEMAS[table].split(", "), start=1):
            name, kind = part.split(" ")
            found.append((table, name, kind, FAMILIES[kind], n))
    return found


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def union(parts) -> str:
    return "\nUNION ALL\n".join(parts)


# -- names


def similarity(a: str, b: str) -> float:
    raw = SequenceMatcher(None, a.lower(), b.lower()).ratio()

    def bare(name: str) -> str:
        name = name.lower().strip()
        for suffix in SUFFIXES:
            name = name.removesuffix(suffix)
        return name

    return max(raw, 0.9) if bare(a) and bare(a) == bare(b) else raw


def pairs(aliases=None, no_columns=(), no_tables=(), relaxed=False, minimum=0.6) -> list[dict]:
    groups = {n.lower(): g for g, names in (aliases or {}).items() for n in names}
    usable = [
        c for c in columns()
        if not any(p.lower() in c[1].lower() for p in no_columns)
        and not any(p.lower() in f"main.{c[0]}" for p in no_tables)
    ]
    found = []
    for a, b in combinations(usable, 2):
        if a[0] == b[0]:
            continue
        castable = relaxed and {a[3], b[3]} == {"numeric", "string"}
        if a[3] != b[3] and not castable:
            continue
        same_group = groups.get(a[1].lower()) is not None and groups.get(a[1].lower()) == groups.get(b[1].lower())
        if a[1] == b[1]:
            kind, score, reason = "exact_name", 1.0, f"Exact name match: {a[1]}"
        elif same_group:
            kind, score = "alias", 0.85
            reason = f"Alias group '{groups[a[1].lower()]}': {a[1]} <-> {b[1]}"
        else:
            value = similarity(a[1], b[1])
            if value < minimum:
                continue
            kind, score, reason = "fuzzy", round(value, 4), f"Name similarity {value:.2f}: {a[1]} <-> {b[1]}"
        found.append({"a": a, "b": b, "kind": kind, "score": score, "reason": reason, "castable": castable})
    return found


def pair_values(found: list[dict]) -> str:
    rows = ", ".join(
        f"({text('main.' + p['a'][0])}, {text(p['a'][1])}, {text('main.' + p['b'][0])}, {text(p['b'][1])}, "
        f"{text(p['kind'])}, {p['score']!r}::DOUBLE, {text(p['reason'])}, {text(p['a'][3])}, {text(p['b'][3])})"
        for p in found
    )
    return (
        f"pairs AS (SELECT * FROM (VALUES {rows}) AS t(source_table, source_column, target_table, target_column, "
        "match_type, name_score, reason, family_a, family_b))"
    )


def used_columns(found: list[dict]) -> list[tuple]:
    return sorted({p[side] for p in found for side in ("a", "b")})


# -- catalogue and profiles


def table_counts() -> str:
    return union(f"SELECT 'main.{t}' AS table_key, count(*) AS row_count FROM {t}" for t in sorted(SCHEMAS))


@oracle
def catalog_columns() -> str:
    rows = ", ".join(f"('main.{t}', '{c}', '{k}', '{f}', {n})" for t, c, k, f, n in columns())
    return f"""
WITH counts AS ({table_counts()}),
listed AS (SELECT * FROM (VALUES {rows}) AS t(table_key, column_name, native_type, family, ordinal))
SELECT table_key, column_name, native_type, family, ordinal, row_count FROM listed JOIN counts USING (table_key)
"""


def _inventory_rows(order: str) -> str:
    rows = []
    for table in sorted(SCHEMAS):
        names = [c[1] for c in columns() if c[0] == table]
        if order == "name":
            names = sorted(names)
        fks = sorted((f"fk_{s}_{t}", c) for s, c, t, _ in given.FOREIGN_KEYS if s == table)
        rows.append(
            f"('main.{table}', '{table}', {len(names)}, '{','.join(names)}', "
            f"'{given.PRIMARY_KEYS.get(table, '')}', '{','.join(c for _, c in fks)}')"
        )
    return (
        f"(SELECT * FROM (VALUES {', '.join(rows)}) AS t(table_key, table_name, column_count, column_names, "
        "primary_key, foreign_key_columns))"
    )


@oracle
def table_inventory() -> str:
    return f"""
WITH counts AS ({table_counts()})
SELECT table_key, row_count, column_count, column_names, primary_key, foreign_key_columns
FROM {_inventory_rows('ordinal')} JOIN counts USING (table_key)
"""


@oracle
def connected_inventory() -> str:
    rows = []
    for name, tables in (("east", sorted(SCHEMAS)), ("west", ["customer", "orders"])):
        for t in tables:
            fks = [f"{name}.main" for s, *_ in given.FOREIGN_KEYS if s == t]
            rows.append(
                f"SELECT '{name}.main.{t}' AS table_key, '{name}.main' AS schema_name, count(*) AS row_count, "
                f"'{given.PRIMARY_KEYS.get(t, '')}' AS primary_key, '{','.join(fks)}' AS target_schemas FROM {t}"
            )
    return union(rows)


@oracle
def graph_nodes() -> str:
    return f"""
WITH counts AS ({table_counts()})
SELECT 'conn1.' || table_key AS node_key, table_key AS label, 'shop' AS database, table_name, row_count,
       column_names, primary_key AS primary_keys
FROM {_inventory_rows('name')} JOIN counts USING (table_key)
"""


@oracle
def foreign_key_edges() -> str:
    rows = ", ".join(f"('main.{s}', '{sc}', 'main.{t}', '{tc}', 'FK: fk_{s}_{t}')" for s, sc, t, tc in given.FOREIGN_KEYS)
    return f"""
WITH counts AS ({table_counts()}), loaded AS (SELECT table_key FROM counts WHERE row_count >= 10),
fks AS (SELECT * FROM (VALUES {rows}) AS t(s, source_column, t, target_column, annotation))
SELECT 'conn1.' || s AS source_key, source_column, 'conn1.' || t AS target_key, target_column,
       'one-to-many' AS rel_type, annotation
FROM fks WHERE s IN (SELECT table_key FROM loaded) AND t IN (SELECT table_key FROM loaded)
"""


@oracle
def table_profile() -> str:
    return f"""
WITH counts AS ({table_counts()}),
widths AS (SELECT table_key, count(*) AS column_count, count(*) FILTER (WHERE family = 'string') AS string_columns
           FROM (VALUES {', '.join(f"('main.{t}', '{f}')" for t, _, _, f, _ in columns())}) AS t(table_key, family)
           GROUP BY table_key)
SELECT table_key, row_count, column_count, string_columns,
       CASE WHEN row_count <= 1000 THEN 'A' WHEN string_columns <= 20 THEN 'B' ELSE 'C' END AS profiling_mode,
       CASE WHEN row_count <= 1000 THEN 'Full pushdown profiling'
            WHEN string_columns <= 20 THEN 'Hybrid profiling (full aggregates + sampled strings)'
            ELSE 'Progressive sampling mode (using pushdown baseline)' END AS profiling_note,
       row_count > 1000 AS sampled
FROM counts JOIN widths USING (table_key)
"""


def profile_of(table: str, column: str, kind: str, family: str, source: str = "") -> str:
    number = "CAST({}({}) AS DOUBLE)" if family == "numeric" else "CAST(NULL AS DOUBLE)"
    stamp = "{}({})" if family == "datetime" else "CAST(NULL AS TIMESTAMP)"
    return f"""
SELECT '{table}' AS table_name, '{column}' AS column_name, '{kind}' AS native_type, '{family}' AS family,
       count(*) AS row_count, count({column}) AS non_null_count, count(*) - count({column}) AS null_count,
       count(DISTINCT {column}) AS distinct_count,
       {number.format('min', column)} AS min_num, {number.format('max', column)} AS max_num,
       {stamp.format('min', column)} AS min_ts, {stamp.format('max', column)} AS max_ts
FROM {source or table}"""


def sample_of(table: str) -> str:
    """A quarter of the rows of a table above 1000 rows, by the md5 of the key, or of all columns."""
    key = [given.PRIMARY_KEYS[table]] if table in given.PRIMARY_KEYS else [c[1] for c in columns() if c[0] == table]
    texts = ", ".join(f"coalesce(CAST({c} AS VARCHAR), '')" for c in key)
    return (
        f"(SELECT * FROM {table} WHERE (SELECT count(*) FROM {table}) <= 1000 "
        f"OR left(md5(concat_ws('|', {texts})), 8) < '40000000') s"
    )


def profiles(wanted=None, sampled=False) -> str:
    parts = union(profile_of(*c[:4], sample_of(c[0]) if sampled else "") for c in (wanted or columns()))
    return f"""
SELECT *, round(CASE WHEN row_count > 0 THEN null_count / row_count ELSE 0 END, 6) AS null_ratio,
       round(CASE WHEN non_null_count > 0 THEN distinct_count / non_null_count ELSE 0 END, 6) AS distinct_ratio,
       round(CASE WHEN row_count > 0 THEN distinct_count / row_count ELSE 0 END, 6) AS uniqueness_ratio
FROM ({parts}) p"""


@oracle
def estimated_profile() -> str:
    return f"""
    SELECT table_name, column_name, row_count, non_null_count, null_ratio,
           CASE WHEN distinct_count < 8192 THEN distinct_count END AS distinct_count
    FROM ({column_profile()})"""


@oracle
def estimated_overlap() -> str:
    def pair(st: str, sc: str, tt: str, tc: str) -> str:
        a, b = f"SELECT {sc} AS v FROM {st} WHERE {sc} IS NOT NULL", f"SELECT {tc} AS v FROM {tt} WHERE {tc} IS NOT NULL"
        return f"""SELECT '{st}.{sc}' AS source, '{tt}.{tc}' AS target,
            CASE WHEN (SELECT count(*) FROM ({a} UNION {b})) < 8192
                 THEN (SELECT count(*) FROM ({a} INTERSECT {b})) END AS shared_count"""

    return " UNION ALL ".join(pair(*key) for key in given.FOREIGN_KEYS)


@oracle
def column_profile() -> str:
    return profiles()


@oracle
def sampled_profile() -> str:
    return profiles(sampled=True)


@oracle
def wide_decimals() -> str:
    return union(
        f"""
SELECT '{c}' AS column_name, count(*) AS row_count, count(DISTINCT {c}) AS distinct_count,
       {_plain(f'min({c})')} AS min_dec, {_plain(f'max({c})')} AS max_dec,
       CAST(min({c}) AS DOUBLE) AS min_num, CAST(max({c}) AS DOUBLE) AS max_num
FROM ({given.WIDE_DECIMALS}) w"""
        for c in ("product", "small", "plain")
    )


def _plain(number: str) -> str:
    """A decimal's digits without zeros at the end of the fraction."""
    digits = f"CAST({number} AS VARCHAR)"
    return f"regexp_replace(regexp_replace({digits}, '(\\.\\d*?)0+$', '\\1'), '\\.$', '')"


@oracle
def loaded_profiles() -> str:
    return profiles([c for c in columns() if c[0] in ("orders", "customer", "nation")])


@oracle
def saved_snapshot() -> str:
    rows = ", ".join(f"('main.{t}', '{c}', '{k}', {n})" for t, c, k, _, n in columns())
    return f"""
WITH counts AS ({table_counts()})
SELECT table_key, column_name, data_type, ordinal_position, row_count
FROM (VALUES {rows}) AS t(table_key, column_name, data_type, ordinal_position) JOIN counts USING (table_key)
"""


def key_of(expression: str) -> str:
    """What texts are ordered by."""
    return f"sha256({expression})"


def top_of(table: str, column: str, family: str) -> str:
    order = key_of(column) if family == "string" else column
    number = f"CAST({column} AS DOUBLE)" if family == "numeric" else "CAST(NULL AS DOUBLE)"
    stamp = column if family == "datetime" else "CAST(NULL AS TIMESTAMP)"
    words = column if family == "string" else "CAST(NULL AS VARCHAR)"
    return f"""
SELECT '{table}' AS table_name, '{column}' AS column_name, rank, cnt,
       {number} AS value_num, {stamp} AS value_ts, {words} AS value_str
FROM (SELECT {column}, count(*) AS cnt, row_number() OVER (ORDER BY count(*) DESC, {order}) AS rank
      FROM {table} WHERE {column} IS NOT NULL GROUP BY {column}) t
WHERE rank <= 10"""


@oracle
def top_values() -> str:
    return union(top_of(t, c, f) for t, c, _, f, _ in columns() if f != "other")


def distinct_texts(wanted: list[tuple]) -> str:
    return union(
        f"SELECT DISTINCT 'main.{t}' AS table_key, '{c}' AS column_name, {c} AS sample FROM {t} WHERE {c} IS NOT NULL"
        for t, c, _, f, _ in wanted
        if f == "string"
    )


def samples(wanted: list[tuple]) -> str:
    return union(
        f"""
SELECT 'main.{t}' AS table_key, '{c}' AS column_name, rank, {c} AS sample
FROM (SELECT {c}, row_number() OVER (ORDER BY {key_of(c)}) AS rank
      FROM (SELECT DISTINCT {c} FROM {t} WHERE {c} IS NOT NULL) d) r WHERE rank <= 20"""
        for t, c, _, f, _ in wanted
        if f == "string"
    )


@oracle
def sample_values() -> str:
    return samples(columns())


@oracle
def string_profile() -> str:
    strings = [c for c in columns() if c[3] == "string"]
    stats = union(
        f"""
SELECT 'main.{t}' AS table_key, '{c}' AS column_name, count(*) AS total_count, count({c}) AS non_null_count,
       count(DISTINCT {c}) AS distinct_count, round(avg(length(rtrim({c}))), 2) AS avg_length,
       min(length(rtrim({c}))) AS min_length, max(length(rtrim({c}))) AS max_length,
       count(DISTINCT trim({c})) AS whitespace_normalized_distinct,
       count(DISTINCT lower({c})) AS lower_normalized_distinct FROM {t}"""
        for t, c, *_ in strings
    )
    matches = " + ".join(f"CAST(regexp_matches(sample, '{p}') AS INT)" for p in IDENTIFIERS)
    return f"""
WITH stats AS ({stats}), samples AS ({samples(strings)}),
every AS ({distinct_texts(strings)}),
flags AS (SELECT table_key, column_name, sum({matches}) >= 3 AS is_identifier_like,
                 bool_or(regexp_matches(sample, '\\d')) AS contains_numbers,
                 bool_or(regexp_matches(sample, '[^a-zA-Z0-9\\s]')) AS contains_special_chars
          FROM every GROUP BY 1, 2),
listed AS (SELECT table_key, column_name, string_agg(sha256(sample), ',' ORDER BY rank) AS samples FROM samples GROUP BY 1, 2)
SELECT *, lower_normalized_distinct < distinct_count OR whitespace_normalized_distinct < distinct_count
            AS normalization_reduces,
       CASE WHEN is_categorical THEN distinct_count ELSE 0 END AS categorical_distinct_count
FROM (SELECT *, round((total_count - non_null_count) / total_count, 6) AS null_ratio,
             lower(column_name) IN ({', '.join(map(text, HINT_NAMES))}) OR distinct_count <= 20 AS is_categorical
      FROM stats JOIN flags USING (table_key, column_name) JOIN listed USING (table_key, column_name)) s
"""


# -- candidates


def counted_pairs(found: list[dict]) -> str:
    used = used_columns(found)
    counts = union(
        f"SELECT 'main.{t}' AS table_key, '{c}' AS column_name, count(DISTINCT {c}) AS n FROM {t}" for t, c, *_ in used
    )
    return f"""
WITH {pair_values(found)}, counts AS ({counts})
SELECT source_table, source_column, target_table, target_column, match_type, name_score, reason,
       true AS compatible, CASE WHEN family_a <> family_b THEN 'cast_required' END AS risk,
       CASE WHEN family_a = family_b THEN 'Same canonical family: ' || family_a
            ELSE 'Cross-family cast: ' || family_a || ' <-> ' || family_b END AS type_reason,
       a.n AS source_distinct, b.n AS target_distinct
FROM pairs JOIN counts a ON source_table = a.table_key AND source_column = a.column_name
           JOIN counts b ON target_table = b.table_key AND target_column = b.column_name
"""


@oracle
def candidate_pairs() -> str:
    return counted_pairs(pairs())


@oracle
def alias_pairs() -> str:
    from checks.queries import ALIASES

    return counted_pairs(pairs(ALIASES))


@oracle
def excluded_pairs() -> str:
    return counted_pairs(pairs(no_columns=("NATION", "text"), no_tables=("Label", "embed")))


@oracle
def relaxed_pairs() -> str:
    return counted_pairs(pairs(relaxed=True, minimum=0.5))


# -- evidence and scores


def value_rows(used: list[tuple], top: bool) -> str:
    def rows(t: str, c: str, family: str) -> str:
        key = f"CAST(CAST({c} AS DOUBLE) AS VARCHAR)" if family == "numeric" else f"CAST({c} AS VARCHAR)"
        norm = f"regexp_replace(lower({c}), '^\\s+|\\s+$', '', 'g')" if family == "string" else "CAST(NULL AS VARCHAR)"
        if top:
            order = key_of(c) if family == "string" else c
            source = (
                f"(SELECT {c} FROM (SELECT {c}, row_number() OVER (ORDER BY count(*) DESC, {order}) AS r FROM {t} "
                f"WHERE {c} IS NOT NULL GROUP BY {c}) q WHERE r <= 10) v"
            )
        else:
            source = f"(SELECT DISTINCT {c} FROM {t} WHERE {c} IS NOT NULL) v"
        return f"SELECT 'main.{t}' AS t, '{c}' AS c, {key} AS k, {norm} AS n FROM {source}"

    return union(rows(t, c, f) for t, c, _, f, _ in used)


def evidence(found: list[dict], top: bool = False) -> str:
    """CTEs up to ``evidence``, one row per pair."""
    used = used_columns(found)
    counts = union(f"SELECT 'main.{t}' AS t, count(*) AS n FROM {t}" for t in sorted({c[0] for c in used}))
    mode = "CASE WHEN ra.n <= 100 AND rb.n <= 100 THEN 'full' ELSE 'sampled' END" if top else "'full'"
    return f"""
WITH {pair_values(found)},
vals AS ({value_rows(used, top)}),
exact AS (SELECT DISTINCT t, c, k FROM vals), norm AS (SELECT DISTINCT t, c, n FROM vals WHERE n IS NOT NULL),
size AS (SELECT t, c, count(*) AS n FROM exact GROUP BY 1, 2),
nsize AS (SELECT t, c, count(*) AS n FROM norm GROUP BY 1, 2),
hit AS (SELECT source_table, source_column, target_table, target_column, count(*) AS o FROM pairs
        JOIN exact a ON a.t = source_table AND a.c = source_column
        JOIN exact b ON b.t = target_table AND b.c = target_column AND a.k = b.k GROUP BY 1, 2, 3, 4),
nhit AS (SELECT source_table, source_column, target_table, target_column, count(*) AS o FROM pairs
        JOIN norm a ON a.t = source_table AND a.c = source_column
        JOIN norm b ON b.t = target_table AND b.c = target_column AND a.n = b.n GROUP BY 1, 2, 3, 4),
counts AS ({counts}),
measured AS (
SELECT pairs.*, coalesce(hit.o, 0) AS o, coalesce(nhit.o, 0) AS p, sa.n AS a, sb.n AS b, na.n AS an, nb.n AS bn,
       {mode} AS mode
FROM pairs
LEFT JOIN hit USING (source_table, source_column, target_table, target_column)
LEFT JOIN nhit USING (source_table, source_column, target_table, target_column)
LEFT JOIN size sa ON sa.t = source_table AND sa.c = source_column
LEFT JOIN size sb ON sb.t = target_table AND sb.c = target_column
LEFT JOIN nsize na ON na.t = source_table AND na.c = source_column
LEFT JOIN nsize nb ON nb.t = target_table AND nb.c = target_column
JOIN counts ra ON ra.t = source_table JOIN counts rb ON rb.t = target_table),
evidence AS (
SELECT source_table, source_column, target_table, target_column, match_type, name_score, reason,
       o AS exact_overlap_count, round(o / least(a, b), 4) AS exact_overlap_ratio,
       p AS normalized_overlap_count, round(coalesce(p / least(an, bn), 0), 4) AS normalized_overlap_ratio,
       round(o / (a + b - o), 4) AS jaccard,
       round(o / b, 4) AS containment_source_to_target, round(o / a, 4) AS containment_target_to_source, mode,
       concat_ws(',', CASE WHEN o / (a + b - o) > 0.8 THEN 'high_jaccard' END,
                      CASE WHEN mode = 'sampled' THEN 'sampled_estimate' END,
                      CASE WHEN o / b > 0.95 THEN 'source_contained_in_target' END,
                      CASE WHEN o / a > 0.95 THEN 'target_contained_in_source' END) AS confidence_flags
FROM measured)"""


EVIDENCE_COLUMNS = (
    "source_table, source_column, target_table, target_column, exact_overlap_count, exact_overlap_ratio, "
    "normalized_overlap_count, normalized_overlap_ratio, jaccard, containment_source_to_target, "
    "containment_target_to_source, mode, confidence_flags"
)


@oracle
def value_evidence_full() -> str:
    return f"{evidence(pairs())} SELECT {EVIDENCE_COLUMNS} FROM evidence"


@oracle
def value_evidence_top() -> str:
    return f"{evidence(pairs(), top=True)} SELECT {EVIDENCE_COLUMNS} FROM evidence"


def scored() -> str:
    found = pairs()
    return f"""{evidence(found)},
profile AS ({profiles(used_columns(found))}),
raw AS (
SELECT e.*, 1.0::DOUBLE AS type_score,
       0.40::DOUBLE * exact_overlap_ratio
         + 0.35::DOUBLE * greatest(containment_source_to_target, containment_target_to_source)
         + 0.25::DOUBLE * jaccard AS value_raw,
       greatest(0, 1.0::DOUBLE - abs(a.uniqueness_ratio - b.uniqueness_ratio)) AS unique_raw,
       greatest(0, 1.0::DOUBLE - abs(a.null_ratio - b.null_ratio)) AS null_raw
FROM evidence e
JOIN profile a ON source_table = 'main.' || a.table_name AND source_column = a.column_name
JOIN profile b ON target_table = 'main.' || b.table_name AND target_column = b.column_name),
weighed AS (
SELECT *, 0.15::DOUBLE * name_score + 0.30::DOUBLE * type_score + 0.40::DOUBLE * value_raw
            + 0.10::DOUBLE * unique_raw + 0.05::DOUBLE * null_raw AS total FROM raw),
scored AS (
SELECT * EXCLUDE (name_score), round(name_score, 4) AS name_score, round(value_raw, 4) AS value_score,
       round(unique_raw, 4) AS uniqueness_score, round(null_raw, 4) AS null_score, round(total, 4) AS confidence,
       CASE WHEN total >= 0.85 THEN 'high' WHEN total >= 0.70 THEN 'medium' WHEN total >= 0.50 THEN 'low'
            ELSE 'reject' END AS confidence_band
FROM weighed)"""


SCORE_COLUMNS = (
    "source_table, source_column, target_table, target_column, match_type, reason, name_score, type_score, "
    "value_score, uniqueness_score, null_score, confidence, confidence_band"
)


@oracle
def scored_pairs() -> str:
    return f"{scored()} SELECT {SCORE_COLUMNS} FROM scored"


@oracle
def visible_edges() -> str:
    return f"""{scored()}
SELECT source_table AS source_key, source_column, target_table AS target_key, target_column, confidence, confidence_band
FROM scored WHERE confidence >= 0.70
ORDER BY confidence DESC, source_table, source_column, target_table, target_column LIMIT 10
"""


@oracle
def common_values() -> str:
    parts = []
    for p in pairs():
        (ta, ca, _, family, _), (tb, cb, *_) = p["a"], p["b"]
        if family == "other":
            continue
        kinds = {"numeric": ("v", "NULL", "NULL"), "datetime": ("NULL", "v", "NULL"), "string": ("NULL", "NULL", "sha256(v)")}
        number, stamp, digest = kinds[family]
        parts.append(f"""
SELECT 'main.{ta}' AS source_table, '{ca}' AS source_column, 'main.{tb}' AS target_table, '{cb}' AS target_column,
       CAST({number} AS DOUBLE) AS value_num, CAST({stamp} AS TIMESTAMP) AS value_ts, CAST({digest} AS VARCHAR) AS value_sha256
FROM (SELECT {ca} AS v FROM {ta} INTERSECT SELECT {cb} FROM {tb}) s WHERE v IS NOT NULL""")
    return union(parts)


def string_sets() -> str:
    found = [p for p in pairs() if p["a"][3] == "string"]
    used = used_columns(found)
    distinct = union(
        f"SELECT 'main.{t}' AS t, '{c}' AS c, count(DISTINCT {c}) <= 20 OR lower('{c}') IN "
        f"({', '.join(map(text, HINT_NAMES))}) AS cat FROM {t}" for t, c, *_ in used
    )
    matches = " + ".join(f"CAST(regexp_matches(sample, '{p}') AS INT)" for p in IDENTIFIERS)
    return f"""
WITH {pair_values(found)}, samples AS ({distinct_texts(used)}), kinds AS ({distinct}),
ids AS (SELECT table_key AS t, column_name AS c, sum({matches}) >= 3 AS is_id FROM samples GROUP BY 1, 2),
norm AS (SELECT DISTINCT table_key AS t, column_name AS c,
                regexp_replace(lower(sample), '^\\s+|\\s+$', '', 'g') AS k FROM samples),
token AS (SELECT DISTINCT t, c, k FROM
          (SELECT table_key AS t, column_name AS c, unnest(regexp_split_to_array(lower(sample), '\\s+')) AS k
           FROM samples) u WHERE k <> ''),
ns AS (SELECT t, c, count(*) AS n FROM norm GROUP BY 1, 2), ts AS (SELECT t, c, count(*) AS n FROM token GROUP BY 1, 2),
nh AS (SELECT source_table, source_column, target_table, target_column, count(*) AS o, string_agg(a.k, '|' ORDER BY a.k) AS shared
       FROM pairs JOIN norm a ON a.t = source_table AND a.c = source_column
       JOIN norm b ON b.t = target_table AND b.c = target_column AND a.k = b.k GROUP BY 1, 2, 3, 4),
th AS (SELECT source_table, source_column, target_table, target_column, count(*) AS o
       FROM pairs JOIN token a ON a.t = source_table AND a.c = source_column
       JOIN token b ON b.t = target_table AND b.c = target_column AND a.k = b.k GROUP BY 1, 2, 3, 4),
strings AS (
SELECT source_table, source_column, target_table, target_column,
       round(CASE WHEN ka.cat AND kb.cat THEN coalesce(nh.o, 0) / least(na.n, nb.n)
                  WHEN ka.cat THEN coalesce(nh.o, 0) / na.n
                  WHEN kb.cat THEN coalesce(nh.o, 0) / nb.n ELSE 0 END, 4) AS categorical_alignment,
       round(coalesce(th.o, 0) / (ta.n + tb.n - coalesce(th.o, 0)), 4) AS token_similarity,
       round(coalesce(nh.o, 0) / least(na.n, nb.n), 4) AS normalization_overlap,
       ka.cat AND kb.cat AS is_both_categorical, ia.is_id AND ib.is_id AS is_both_identifier,
       CASE WHEN ka.cat AND kb.cat THEN coalesce(nh.shared, '') ELSE '' END AS shared_categories
FROM pairs
LEFT JOIN nh USING (source_table, source_column, target_table, target_column)
LEFT JOIN th USING (source_table, source_column, target_table, target_column)
JOIN kinds ka ON ka.t = source_table AND ka.c = source_column JOIN kinds kb ON kb.t = target_table AND kb.c = target_column
JOIN ids ia ON ia.t = source_table AND ia.c = source_column JOIN ids ib ON ib.t = target_table AND ib.c = target_column
JOIN ns na ON na.t = source_table AND na.c = source_column JOIN ns nb ON nb.t = target_table AND nb.c = target_column
JOIN ts ta ON ta.t = source_table AND ta.c = source_column JOIN ts tb ON tb.t = target_table AND tb.c = target_column)"""


@oracle
def string_evidence() -> str:
    return f"{string_sets()} SELECT * FROM strings"


@oracle
def string_scores() -> str:
    return f"""{string_sets()}
SELECT source_table, source_column, target_table, target_column,
       round((0.45::DOUBLE * categorical_alignment + 0.30::DOUBLE * token_similarity + 0.25::DOUBLE * normalization_overlap)
             * CASE WHEN token_similarity = 0 THEN 0.5::DOUBLE ELSE 1 END, 4) AS score
FROM strings
"""


@oracle
def reviewed_aliases() -> str:
    from checks.queries import ALIASES

    index = {name.lower().strip(): group for group, names in ALIASES.items() for name in names}
    rows = ", ".join(f"('{name}', '{group}')" for name, group in index.items())
    return f"""
WITH said AS (SELECT lower(trim(alias)) AS alias, arg_max(alias_group, seq) AS alias_group
              FROM ({given.ALIAS_FEEDBACK}) f GROUP BY 1)
SELECT * FROM said UNION ALL SELECT * FROM (VALUES {rows}) i(alias, alias_group) ANTI JOIN said USING (alias)
"""


@oracle
def suggested_edges() -> str:
    return f"""
SELECT s.*, t.token_similarity, t.is_both_categorical FROM (
{scored()}
SELECT source_table, source_column, target_table, target_column, confidence, confidence_band, match_type, reason,
       name_score, type_score, value_score, uniqueness_score, null_score, exact_overlap_count, exact_overlap_ratio,
       jaccard, mode, confidence_flags
FROM scored WHERE confidence_band <> 'reject') s
LEFT JOIN ({string_sets()} SELECT * FROM strings) t
USING (source_table, source_column, target_table, target_column)
"""


# -- review

EDGE = "source_key, source_column, target_key, target_column"


def review() -> str:
    return f"""
WITH suggested AS ({given.REVIEW_SUGGESTED}), confirmed AS ({given.REVIEW_CONFIRMED}),
decisions AS ({given.REVIEW_DECISIONS})"""


@oracle
def reviewed_suggestions() -> str:
    return f"""{review()}
SELECT * FROM suggested s
WHERE NOT EXISTS (SELECT 1 FROM decisions d WHERE d.action IN ('confirm', 'dismiss')
                    AND d.source_key = s.source_key AND d.source_column = s.source_column
                    AND d.target_key = s.target_key AND d.target_column = s.target_column)
  AND NOT EXISTS (SELECT 1 FROM decisions d WHERE d.action = 'remove_table'
                    AND d.node_key IN (s.source_key, s.target_key))
"""


def _confirmed(extra: str = "") -> str:
    return f"""{review()},
history AS (SELECT {EDGE}, rel_type, annotation, -1 AS seq FROM confirmed
            UNION ALL SELECT {EDGE}, rel_type, annotation, seq FROM decisions WHERE action = 'confirm'),
last AS (SELECT {EDGE}, arg_max(rel_type, seq) AS rel_type, arg_max(annotation, seq) AS annotation, max(seq) AS seq
         FROM history GROUP BY ALL)
SELECT {EDGE}, rel_type, annotation FROM (SELECT {EDGE}, rel_type, annotation, seq FROM last) h
WHERE NOT EXISTS (SELECT 1 FROM decisions d WHERE d.seq > h.seq AND (
        (d.action = 'remove_edge' AND d.source_key = h.source_key AND d.target_key = h.target_key {extra})
     OR (d.action = 'remove_table' AND d.node_key IN (h.source_key, h.target_key))))
""".replace("GROUP BY ALL", f"GROUP BY {EDGE}")


@oracle
def reviewed_confirmed() -> str:
    return _confirmed()


@oracle
def reviewed_confirmed_by_column() -> str:
    return _confirmed("AND d.source_column = h.source_column AND d.target_column = h.target_column")


@oracle
def remaining_nodes() -> str:
    return f"""{review()}
SELECT node_key FROM ({given.REVIEW_NODES}) n
WHERE node_key NOT IN (SELECT node_key FROM decisions WHERE action = 'remove_table')
"""


@oracle
def annotations() -> str:
    return f"""
WITH notes AS (SELECT * FROM ({given.REVIEW_NOTES}) n),
latest AS (SELECT key, arg_max(text, seq) AS text FROM notes GROUP BY key),
seeds AS (SELECT DISTINCT source_key || '->' || target_key AS key, annotation AS text FROM ({given.REVIEW_CONFIRMED}) c)
SELECT key, text FROM latest UNION ALL SELECT key, text FROM seeds WHERE key NOT IN (SELECT key FROM latest)
"""


@oracle
def edited_edges() -> str:
    return f"""
WITH nodes AS (SELECT node_key, split_part(node_key, '.', 3) AS short FROM ({given.EDIT_NODES}) n)
SELECT a.node_key AS source_key, source_column, b.node_key AS target_key, target_column,
       arg_max(rel_type, seq) AS rel_type, arg_max(annotation, seq) AS annotation
FROM ({given.REVIEW_EDITS}) e JOIN nodes a ON a.short = e.source JOIN nodes b ON b.short = e.target
GROUP BY 1, 2, 3, 4
"""


@oracle
def ambiguous_edits() -> str:
    return f"""
WITH nodes AS (SELECT split_part(node_key, '.', 3) AS short, count(*) AS n FROM ({given.AMBIGUOUS_NODES}) m GROUP BY 1)
SELECT e.*, coalesce(a.n, 0) AS source_nodes, coalesce(b.n, 0) AS target_nodes
FROM ({given.REVIEW_EDITS}) e LEFT JOIN nodes a ON a.short = e.source LEFT JOIN nodes b ON b.short = e.target
WHERE a.n > 1 OR b.n > 1
"""


@oracle
def saved_state() -> str:
    return f"SELECT {EDGE}, rel_type, annotation FROM ({given.REVIEW_CONFIRMED}) c"


@oracle
def exported_graph() -> str:
    return f"SELECT 'copy:' || id AS id, 'copy' AS graph_id, {SIGNATURE} FROM ({given.STORED_EDGES}) e WHERE graph_id = 'g7'"


@oracle
def exported_turns() -> str:
    return given.TURNS


@oracle
def filtered_suggestions() -> str:
    return f"""
SELECT * FROM ({given.REVIEW_SUGGESTED}) s
WHERE origin = 'ai' AND confidence >= 0.70 AND confidence < 0.85
  AND (lower(source_key) LIKE '%u1%' OR lower(target_key) LIKE '%u1%')
"""


@oracle
def bulk_denial() -> str:
    return f"SELECT * FROM ({given.REVIEW_SUGGESTED}) s WHERE confidence >= 0.70"


@oracle
def bulk_approval() -> str:
    return f"""
WITH high AS (SELECT {EDGE}, 'one-to-many' AS rel_type, '' AS annotation
              FROM ({given.REVIEW_SUGGESTED}) s WHERE confidence >= 0.85)
SELECT * FROM high UNION ALL
SELECT * FROM ({given.REVIEW_CONFIRMED}) c WHERE NOT EXISTS (SELECT 1 FROM high h
  WHERE h.source_key = c.source_key AND h.source_column = c.source_column
    AND h.target_key = c.target_key AND h.target_column = c.target_column)
"""


# -- stored graphs

SIGNATURE = "source_table_key, source_column, target_table_key, target_column"


@oracle
def graph_list() -> str:
    return f"""
SELECT id, name, is_template, version FROM ({given.GRAPHS}) g
WHERE domain_tag = 'BUILDING' AND (lower(name) LIKE '%server1%' OR lower(description) LIKE '%server1%'
                                   OR lower(database_server) LIKE '%server1%')
"""


@oracle
def template_graphs() -> str:
    return f"SELECT id, name, updated_at FROM ({given.GRAPHS}) g WHERE is_template"


@oracle
def saved_graphs() -> str:
    return f"""
SELECT id, CASE WHEN parent_graph_id IS NULL THEN name ELSE upper(name) END AS name, created_by, created_at, version
FROM ({given.GRAPHS}) g
"""


@oracle
def deleted_graph_edges() -> str:
    return f"""
SELECT id, graph_id FROM ({given.STORED_EDGES}) e
WHERE graph_id NOT IN (SELECT 'g' || c_custkey FROM customer WHERE c_acctbal > 9000)
"""


@oracle
def forked_edges() -> str:
    return f"""
SELECT * REPLACE ('fork1:' || id AS id, 'fork1' AS graph_id) FROM ({given.STORED_EDGES}) e WHERE graph_id = 'g7'
"""


@oracle
def forked_nodes() -> str:
    return f"""
SELECT * REPLACE ('fork1:' || id AS id, 'fork1' AS graph_id) FROM ({given.STORED_NODES}) e WHERE graph_id = 'g7'
"""


@oracle
def latest_snapshots() -> str:
    return f"""
SELECT graph_id, max(version) AS version, arg_max(snapshot, version) AS snapshot
FROM ({given.SNAPSHOTS}) s GROUP BY graph_id
"""


@oracle
def next_versions() -> str:
    return f"""
SELECT graph_id, version, snapshot FROM ({given.SNAPSHOTS}) s
UNION ALL SELECT id, version + 1, 'state of ' || name FROM ({given.GRAPHS}) g WHERE is_template
"""


def confirmed_store() -> str:
    return f"""
WITH edges AS ({given.STORED_EDGES}), own AS ({given.CONFIRMERS}),
log AS (SELECT DISTINCT {SIGNATURE}, session_id FROM ({given.CONFIRMATION_LOG}) l),
sessions AS (SELECT edge_id AS id, session_id FROM own
             UNION SELECT e.id, l.session_id FROM edges e JOIN log l USING ({SIGNATURE})),
counted AS (SELECT id, count(*) AS n FROM sessions GROUP BY id),
store AS (SELECT e.* EXCLUDE (confirmed_by_count), coalesce(n, 0) AS confirmed_by_count
          FROM edges e LEFT JOIN counted USING (id))"""


@oracle
def recorded_confirmations() -> str:
    return f"{confirmed_store()} SELECT id, graph_id, confirmed_by_count FROM store"


@oracle
def graph_confirmers() -> str:
    return f"{confirmed_store()} SELECT id AS edge_id, session_id FROM sessions JOIN edges USING (id) WHERE graph_id = 'g7'"


@oracle
def confirmation_counts() -> str:
    return f"{confirmed_store()} SELECT {SIGNATURE}, max(confirmed_by_count) AS confirmations FROM store GROUP BY ALL"


@oracle
def promoted_edges() -> str:
    return f"""{confirmed_store()}
SELECT {SIGNATURE}, confirmed_by_count, id FROM (
  SELECT *, row_number() OVER (PARTITION BY {SIGNATURE} ORDER BY confirmed_by_count DESC, id) AS r
  FROM store WHERE graph_id <> 'g7' AND confirmed_by_count >= 3
    AND ({SIGNATURE}) NOT IN (SELECT ({SIGNATURE}) FROM store WHERE graph_id = 'g7')) t
WHERE r = 1
"""


@oracle
def folded_confirmations() -> str:
    return f"SELECT {SIGNATURE}, count(DISTINCT session_id) AS sessions FROM ({given.CONFIRMATION_LOG}) l GROUP BY ALL"


@oracle
def stored_graph() -> str:
    return f"SELECT * FROM ({given.STORED_EDGES}) e WHERE graph_id = 'g7'"


@oracle
def rewritten_graphs() -> str:
    return f"""
WITH e AS (SELECT * REPLACE (CASE WHEN graph_id = 'g7' THEN 'again' ELSE annotation END AS annotation)
           FROM ({given.STORED_EDGES}) s WHERE graph_id NOT IN ('g8', 'g10'))
SELECT * FROM e UNION ALL SELECT * REPLACE ('fork of g7' AS graph_id) FROM e WHERE graph_id = 'g7'
"""


@oracle
def context_edges() -> str:
    return f"""
WITH tables AS (SELECT DISTINCT schema_name || '.' || table_name AS k FROM ({given.STORED_NODES}) n
                WHERE graph_id = 'g7')
SELECT id, {SIGNATURE} FROM ({given.STORED_EDGES}) e
WHERE graph_id = 'g7' AND edge_type = 'confirmed'
  AND source_table_key IN (SELECT k FROM tables) AND target_table_key IN (SELECT k FROM tables)
"""


# -- drift


def _changes(new_tables: str, new_columns: str, old_tables: str, old_columns: str) -> str:
    return f"""
WITH nt AS ({new_tables}), nc AS ({new_columns}),
ot AS ({old_tables}), oc AS ({old_columns}),
kept AS (SELECT table_key FROM nt INTERSECT SELECT table_key FROM ot),
n AS (SELECT * FROM nc WHERE table_key IN (SELECT table_key FROM kept)),
o AS (SELECT * FROM oc WHERE table_key IN (SELECT table_key FROM kept)),
changes AS (
SELECT table_key, column_name, 'added' AS change_type, CAST(NULL AS VARCHAR) AS old_value, data_type AS new_value
FROM n ANTI JOIN o USING (table_key, column_name)
UNION ALL SELECT table_key, column_name, 'removed', data_type, NULL FROM o ANTI JOIN n USING (table_key, column_name)
UNION ALL SELECT n.table_key, n.column_name, 'type_changed', o.data_type, n.data_type
FROM n JOIN o USING (table_key, column_name) WHERE n.data_type <> o.data_type
UNION ALL SELECT n.table_key, n.column_name, 'nullability_changed',
       CASE WHEN o.is_nullable THEN 'True' ELSE 'False' END, CASE WHEN n.is_nullable THEN 'True' ELSE 'False' END
FROM n JOIN o USING (table_key, column_name) WHERE n.is_nullable <> o.is_nullable)"""


def drift_parts() -> str:
    sides = (given.CURRENT_TABLES, given.CURRENT_COLUMNS, given.PREVIOUS_TABLES, given.PREVIOUS_COLUMNS)
    return f"""{_changes(*sides)},
verdicts AS (
SELECT table_key, CASE WHEN ot.row_count IS NULL THEN 'new' WHEN nt.row_count IS NULL THEN 'removed'
            WHEN c.n > 0 THEN 'columns_changed' WHEN ot.row_count <> nt.row_count THEN 'row_count_changed'
            ELSE 'unchanged' END AS verdict,
       coalesce(c.n, 0) AS column_change_count,
       CASE WHEN nt.row_count IS NULL THEN 0 ELSE coalesce(ot.row_count, 0) END AS old_row_count,
       CASE WHEN ot.row_count IS NULL THEN 0 ELSE coalesce(nt.row_count, 0) END AS new_row_count
FROM nt FULL JOIN ot USING (table_key)
LEFT JOIN (SELECT table_key, count(*) AS n FROM changes GROUP BY 1) c USING (table_key))"""


@oracle
def drift_columns() -> str:
    return f"{drift_parts()} SELECT * FROM changes"


@oracle
def drift_tables() -> str:
    return f"{drift_parts()} SELECT * FROM verdicts"


def _history(rows: str, key: str, state: str) -> str:
    return f"""
WITH v AS (SELECT version, row_number() OVER (ORDER BY version) AS place, lead(version) OVER (ORDER BY version) AS following
           FROM ({given.HISTORY_VERSIONS}) x),
r AS (SELECT *, place - row_number() OVER (PARTITION BY {key}, {state} ORDER BY place) AS island
      FROM ({rows}) s JOIN v USING (version))
SELECT {key}, {state}, min(version) AS valid_from, arg_max_null(following, place) AS valid_to
FROM r GROUP BY {key}, {state}, island
"""


@oracle
def column_history() -> str:
    return _history(given.HISTORY_COLUMNS, "table_key, column_name", "data_type, is_nullable")


@oracle
def table_history() -> str:
    return _history(given.HISTORY_TABLES, "table_key", "row_count")


@oracle
def extended_history() -> str:
    return column_history()


@oracle
def history_as_of() -> str:
    return f"SELECT * EXCLUDE (version) FROM ({given.HISTORY_COLUMNS}) c WHERE version = 4"


@oracle
def history_changes() -> str:
    parts = [
        f"SELECT * EXCLUDE (version) FROM ({rows}) s WHERE version = {n}"
        for n in (5, 2) for rows in (given.HISTORY_TABLES, given.HISTORY_COLUMNS)
    ]
    return f"{_changes(*parts)} SELECT * FROM changes"


@oracle
def drift_summary() -> str:
    return f"""{drift_parts()}
SELECT count(*) FILTER (WHERE verdict = 'new') AS new_tables,
       count(*) FILTER (WHERE verdict = 'removed') AS removed_tables,
       count(*) FILTER (WHERE verdict IN ('removed', 'columns_changed', 'row_count_changed')) AS changed_tables,
       count(*) FILTER (WHERE verdict = 'unchanged') AS unchanged_tables,
       count(*) FILTER (WHERE verdict <> 'unchanged') > 0 AS has_drift
FROM verdicts
"""


# -- responses: what the texts say, taken from the lines they were made of

RELATIONSHIPS = """
SELECT l_orderkey AS batch_id, 'dbo.S' || l_suppkey AS source_table, 'k' || l_linenumber AS source_column,
       'dbo.P' || l_partkey AS target_table, 'p' AS target_column,
       CASE WHEN l_returnflag <> 'N' THEN round(l_quantity / 50, 2) ELSE 0.5 END AS confidence,
       'flag ' || l_returnflag AS reasoning,
       CASE WHEN l_linestatus = 'F' THEN 'many-to-one' ELSE 'one-to-many' END AS rel_type
FROM lineitem WHERE l_orderkey % 8 NOT IN (6, 7)
"""


@oracle
def response_relationships() -> str:
    return RELATIONSHIPS


@oracle
def response_errors() -> str:
    return "SELECT DISTINCT l_orderkey AS batch_id, true AS truncated FROM lineitem WHERE l_orderkey % 8 IN (6, 7)"


def response_edge_rows() -> str:
    return f"""
SELECT batch_id, a.node_key AS source_key, source_column, b.node_key AS target_key, target_column, confidence,
       CASE WHEN confidence >= 0.85 THEN 'high' WHEN confidence >= 0.70 THEN 'medium' ELSE 'low' END AS confidence_band,
       'ai' AS origin, reasoning, rel_type
FROM ({RELATIONSHIPS}) r
JOIN ({given.RESPONSE_NODES}) a ON a.table_key = source_table
JOIN ({given.RESPONSE_NODES}) b ON b.table_key = target_table
"""


@oracle
def response_edges() -> str:
    return response_edge_rows()


@oracle
def merged_edges() -> str:
    return f"""
WITH old AS (SELECT DISTINCT 'conn1.dbo.S' || l_suppkey AS source_key, 'k' || (l_linenumber % 4) AS source_column,
                    'conn1.dbo.P' || l_partkey AS target_key, 'p' AS target_column, 'pipeline' AS origin,
                    0.9::DOUBLE AS confidence FROM lineitem),
fresh AS (SELECT *, row_number() OVER (PARTITION BY {EDGE} ORDER BY batch_id, confidence) AS r
          FROM ({response_edge_rows()}) e)
SELECT {EDGE}, origin, confidence FROM old
UNION ALL
SELECT {EDGE}, origin, confidence FROM fresh WHERE r = 1 AND ({EDGE}) NOT IN (SELECT ({EDGE}) FROM old)
"""


@oracle
def response_descriptions() -> str:
    return """
SELECT "table", "column", arg_max(description, (batch, item)) AS description FROM (
  SELECT 'dbo.U' || user_id AS "table", regexp_extract(props, '[0-9]+', 0) AS "column",
         'seen by ' || event_type || ' ' || event_id AS description, event_id // 10 AS batch,
         '{"table":"dbo.U' || user_id || '","column":"' || regexp_extract(props, '[0-9]+', 0)
           || '","description":"seen by ' || event_type || ' ' || event_id || '"' AS item
  FROM events) e
WHERE batch % 8 NOT IN (6, 7) GROUP BY 1, 2
"""


@oracle
def described_columns() -> str:
    return f"""
SELECT table_key, column_name, d.description FROM ({given.DESCRIBED_COLUMNS}) c
LEFT JOIN ({response_descriptions()}) d ON d."table" = table_key AND d."column" = column_name
"""


# -- conversations and bounded reads


def messages() -> str:
    return f"""
WITH turns AS ({given.TURNS}),
said AS (SELECT conv_id, turn, 0 AS part, 'user' AS role, question AS content FROM turns
         UNION ALL SELECT conv_id, turn, 1, 'assistant', answer FROM turns WHERE answer <> ''),
ranked AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, part DESC) AS r FROM said)"""


@oracle
def turn_messages() -> str:
    return f"""{messages()}
SELECT s.conv_id, s.turn,
       row_number() OVER (PARTITION BY conv_id, turn ORDER BY part) - 1 AS part, role, content FROM said s"""


@oracle
def pruned_history() -> str:
    return f"{messages()} SELECT conv_id, turn, part, role, content FROM ranked WHERE r <= 4"


@oracle
def context_tail() -> str:
    return f"{messages()} SELECT conv_id, turn, part, role, content FROM ranked WHERE r <= 6"


@oracle
def bounded_read() -> str:
    return """
SELECT *, (SELECT count(*) > 1000 FROM lineitem) AS truncated, (SELECT least(count(*), 1000) FROM lineitem) AS returned_rows
FROM lineitem ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice LIMIT 1000
"""


# -- reports


@oracle
def report_summary() -> str:
    return f"""
SELECT (SELECT count(*) FROM ({remaining_nodes()}) n) AS table_count,
       (SELECT count(*) FROM ({reviewed_confirmed()}) c) AS confirmed_relationship_count,
       (SELECT count(*) FROM ({reviewed_suggestions()}) s) AS suggested_relationship_count
"""


@oracle
def report_relationships() -> str:
    return f"""
WITH notes AS (SELECT key, arg_max(text, seq) AS edge_annotation FROM ({given.REVIEW_NOTES}) n GROUP BY key)
SELECT {EDGE}, rel_type AS relationship_type, annotation, coalesce(edge_annotation, '') AS edge_annotation
FROM ({given.REVIEW_CONFIRMED}) c LEFT JOIN notes ON key = source_key || '->' || target_key
"""


@oracle
def node_key_parts() -> str:
    return """
WITH keyed AS (
  SELECT c_custkey, array_to_string(list_slice(['x', CAST(c_nationkey AS VARCHAR), c_mktsegment, c_name], 4 - c_custkey % 4, 4), '.') AS node_key
  FROM customer),
cut AS (SELECT *, string_split(node_key, '.') AS p FROM keyed)
SELECT c_custkey, node_key, CASE WHEN len(p) >= 3 THEN p[1] ELSE '' END AS connection_id,
       CASE WHEN len(p) >= 3 THEN p[2] WHEN len(p) = 2 THEN p[1] ELSE '' END AS schema_name,
       CASE WHEN len(p) >= 3 THEN p[3] WHEN len(p) = 2 THEN p[2] ELSE '' END AS table_name
FROM cut
"""


@oracle
def edge_keys() -> str:
    return "SELECT o_orderkey, concat_ws('|', o_orderstatus, o_orderpriority, o_custkey) AS edge_key FROM orders"
