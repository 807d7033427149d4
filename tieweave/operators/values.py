"""The value relation: one row per distinct value of each column, with its count.

Profiles, samples and overlaps all derive from it, so each table is scanned once.  A
value takes part as a typed key that makes ``1``, ``1.0`` and ``1.00`` equal:

=======  ==================================================================
k_num    integers, booleans, and doubles or decimals without a fraction
k_dbl    other doubles, and decimals that a double holds exactly
k_ts     dates and timestamps
k_txt    everything else; long texts by digest (see ``functions.text``)
=======  ==================================================================

A row whose four keys are NULL counts the NULLs of its column.  ``long`` is filled for
long texts only and holds what cannot be worked out from the digest later on: length,
and the keys of the text in lower case, trimmed, and normalised.
"""

from __future__ import annotations

from functools import reduce
from typing import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tieweave.functions.text import (
    has_digit,
    has_special,
    identifier_hits,
    is_key_of_long,
    is_long,
    normalised,
    sql_digest,
    sql_has_digit,
    sql_has_special,
    sql_identifier_hits,
    sql_is_long,
    sql_strip_blanks,
    sql_text_key,
    text_key,
)
from tieweave.session import materialize
from tieweave.sources.catalog import Catalog

VALUE_KEYS = ("k_num", "k_dbl", "k_ts", "k_txt")
LONG_TYPE = "struct<len:int,low:string,trim:string,norm:string,hits:int,digit:boolean,special:boolean>"
KEY_TYPES = {
    "k_num": "bigint", "k_dbl": "double", "k_ts": "timestamp_ntz", "k_txt": "string", "long": LONG_TYPE,
}

# Whole doubles below this magnitude are bigints without loss.
_BIGINT_LIMIT = "9223372036854775808D"

# Tables whose scans share one aggregation; keeps plans small on large catalogues.
TABLES_PER_PLAN = 16


def _long_forms(value: str, with_forms: bool) -> str:
    """Struct of a long text: its length and, if asked for, the keys of its forms.

    Lower case never shortens a text, so the form of a long text is long as well.  No
    lambda functions here: they would take the scan out of generated code.
    """
    low = trim = norm = hits = digit = special = "NULL"
    if with_forms:
        stripped = sql_strip_blanks(value)
        plain = sql_strip_blanks(f"lower({value})")
        low = sql_digest(f"lower({value})")
        trim = sql_text_key(f"trim({value})")
        norm = f"if({sql_is_long(stripped)}, {sql_digest(plain)}, {sql_text_key(plain)})"
        hits, digit, special = sql_identifier_hits(value), sql_has_digit(value), sql_has_special(value)
    fields = {
        "len": f"length(rtrim({value}))", "low": low, "trim": trim, "norm": norm, "hits": hits, "digit": digit,
        "special": special,
    }
    return f"named_struct({', '.join(f'{name!r}, {field}' for name, field in fields.items())})"


def _keys(value: str, dtype: T.DataType, with_forms: bool) -> dict[str, str]:
    """Typed keys of one value, as SQL expressions.

    Expressions are texts here, because a wide catalogue has thousands of them and a
    text crosses to the JVM in one call.
    """
    if isinstance(dtype, (T.BooleanType, T.IntegralType)):
        return {"k_num": f"CAST({value} AS BIGINT)"}
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        v = f"CAST({value} AS DOUBLE)"
        whole = f"(abs({v}) < {_BIGINT_LIMIT} AND floor({v}) = {v})"
        return {"k_num": f"if({whole}, try_cast({v} AS BIGINT), NULL)", "k_dbl": f"if({whole}, NULL, {v})"}
    if isinstance(dtype, T.DecimalType):
        # Tested before it is cast: an overflow that try_cast catches costs more than all the rest of a value.
        whole = [f"{value} BETWEEN -9223372036854775808BD AND 9223372036854775807BD"] * (dtype.precision - dtype.scale > 18)
        # By the remainder, whose type has the scale of the value: floor's would not fit beside 38 digits.
        whole += [f"{value} % 1BD = 0"] * (dtype.scale > 0)
        integer = f"if({' AND '.join(whole) or 'true'}, CAST({value} AS BIGINT), NULL)"
        v = f"CAST({value} AS DOUBLE)"
        held = f"coalesce(try_cast({v} AS {dtype.simpleString()}) = {value}, false)"
        digits = f"CAST({value} AS STRING)"
        if dtype.scale > 0:
            digits = f"if(contains({digits}, 'E'), {digits}, rtrim('.', rtrim('0', {digits})))"
        return {
            "k_num": integer,
            "k_dbl": f"if({integer} IS NULL AND {held}, {v}, NULL)",
            "k_txt": f"if({integer} IS NULL AND NOT {held}, {digits}, NULL)",
        }
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return {"k_ts": f"CAST({value} AS TIMESTAMP_NTZ)"}
    if isinstance(dtype, (T.StringType, T.CharType, T.VarcharType)):
        return {
            "k_txt": sql_text_key(value),
            "long": f"if({sql_is_long(value)}, {_long_forms(value, with_forms)}, NULL)",
        }
    if isinstance(dtype, T.BinaryType):
        return {"k_txt": sql_text_key(f"hex({value})")}
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
        return {"k_txt": sql_text_key(f"to_json({value})")}
    return {"k_txt": sql_text_key(f"CAST({value} AS STRING)")}


def quoted(name: str) -> str:
    """A column name as SQL takes it, whatever it holds."""
    return "`" + name.replace("`", "``") + "`"


def exploded(df: DataFrame, columns: list[dict], with_forms: bool, keep: Iterable[str] = ()) -> DataFrame:
    """One row per (row, column) of a table; only the listed columns are read, and those to ``keep`` beside them."""
    types = {f.name: f.dataType for f in df.schema.fields}
    structs = []
    for c in columns:
        keys = _keys(quoted(c["column_name"]), types[c["column_name"]], with_forms)
        fields = "".join(f", '{k}', CAST({keys.get(k, 'NULL')} AS {t})" for k, t in KEY_TYPES.items())
        structs.append(f"named_struct('col_id', {c['col_id']}{fields})")
    return df.selectExpr(*map(quoted, keep), f"inline(array({', '.join(structs)}))")


def value_counts(
    catalog: Catalog,
    col_ids: Iterable[int] | None = None,
    sampled: dict[str, DataFrame] | None = None,
    text_forms: bool = True,
) -> DataFrame:
    """The value relation of a catalogue, or of some of its columns.

    The count is combined on the map side, so a value that fills a third of a table
    travels as one row per task.  ``sampled`` replaces the scan of large tables.  Without
    ``text_forms`` the forms of long texts are left out, which string profiles and
    normalised overlaps need but column profiles and top values do not.
    """
    wanted = None if col_ids is None else set(col_ids)
    by_table: dict[str, list[dict]] = {}
    for c in catalog.column_rows():
        if wanted is None or c["col_id"] in wanted:
            by_table.setdefault(c["table_key"], []).append(c)
    frames = {**catalog.tables, **(sampled or {})}
    scans = [exploded(frames[key], columns, text_forms) for key, columns in by_table.items()]
    if not scans:
        schema = ", ".join(f"{k} {t}" for k, t in KEY_TYPES.items())
        return catalog.spark.createDataFrame([], f"col_id int, {schema}, cnt long")
    batches = [scans[i : i + TABLES_PER_PLAN] for i in range(0, len(scans), TABLES_PER_PLAN)]
    counted = [
        reduce(DataFrame.unionAll, batch)
        .groupBy("col_id", *KEY_TYPES)
        .agg(F.count(F.lit(1)).alias("cnt"))
        for batch in batches
    ]
    if len(counted) > 1:
        counted = [materialize(part, "values") for part in counted]
    return reduce(DataFrame.unionAll, counted)


def has_value() -> Column:
    test = F.col(VALUE_KEYS[0]).isNotNull()
    for key in VALUE_KEYS[1:]:
        test = test | F.col(key).isNotNull()
    return test


def lower_key() -> Column:
    return F.coalesce("long.low", text_key(F.lower("k_txt")))


def trim_key() -> Column:
    return F.coalesce("long.trim", text_key(F.trim("k_txt")))


def norm_key() -> Column:
    return F.coalesce("long.norm", text_key(normalised(F.col("k_txt"))))


def text_length() -> Column:
    """Length without trailing blanks."""
    return F.coalesce("long.len", F.length(F.rtrim("k_txt")))


def identifier_count() -> Column:
    """How many identifier patterns a text matches."""
    return F.coalesce("long.hits", identifier_hits(F.col("k_txt")))


def text_has_digit() -> Column:
    return F.coalesce("long.digit", has_digit(F.col("k_txt")))


def text_has_special() -> Column:
    return F.coalesce("long.special", has_special(F.col("k_txt")))


def text_order() -> Column:
    """One order for texts of any length, by SHA-256: what is picked in it is picked at random."""
    key = F.col("k_txt")
    return F.when(is_key_of_long(key), F.substring_index(key, ":", -1)).otherwise(F.sha2(key, 256)).asc()


def value_order() -> list[Column]:
    """A total order of the values of one column."""
    number = F.coalesce("k_dbl", F.col("k_num").cast("double"))
    return [number.asc_nulls_last(), F.col("k_num").asc(), F.col("k_ts").asc(), text_order()]


def rank_values(rows: DataFrame, groups: tuple[str, ...], order: list[Column], limit: int) -> DataFrame:
    """The first ``limit`` rows of each group with their rank.

    Spark cuts each task's rows to ``limit`` per group before the shuffle
    (``WindowGroupLimit``), so a group that holds most rows is never gathered whole.
    """
    window = Window.partitionBy(*groups).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= limit)


def restore_long_texts(selection: DataFrame, catalog: Catalog) -> DataFrame:
    """Add ``value_str``: the text of each selected value, long ones read back whole.

    ``selection`` has ``col_id``, ``k_txt`` and ``is_long``; it is small (some values per
    column) and written first.  Only columns with a selected long text are scanned again,
    so nothing is when there is none.  Texts are compared by digest and made distinct
    before the shuffle; the measured size of the selection decides how it is joined.
    """
    chosen = materialize(selection, "selection")
    long = chosen.where("is_long").select("col_id", "k_txt").distinct()
    # One number per column at most.
    ids = {r["col_id"] for r in long.select("col_id").distinct().toLocalIterator()}
    by_table: dict[str, list[str]] = {}
    for c in catalog.column_rows():
        if c["col_id"] in ids:
            text = f"named_struct('col_id', {c['col_id']}, 'value_str', CAST({quoted(c['column_name'])} AS STRING))"
            by_table.setdefault(c["table_key"], []).append(text)
    if not by_table:
        return chosen.withColumn("value_str", F.col("k_txt"))
    scans = [
        catalog.tables[table_key].selectExpr(f"inline(array({', '.join(texts)}))").where(is_long(F.col("value_str")))
        for table_key, texts in by_table.items()
    ]
    found = (
        reduce(DataFrame.unionAll, scans)
        .withColumn("k_txt", text_key(F.col("value_str")))
        .join(long, ["col_id", "k_txt"], "left_semi")
        .distinct()
    )
    return (
        chosen.join(found, ["col_id", "k_txt"], "left")
        .withColumn("value_str", F.coalesce("value_str", "k_txt"))
    )
