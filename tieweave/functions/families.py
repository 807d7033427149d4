"""Type families, type decisions and the rules that follow from a type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Family of each declared (T-SQL) type name.
DECLARED_FAMILIES = {
    "numeric": (
        "int", "bigint", "smallint", "tinyint", "decimal", "numeric",
        "money", "smallmoney", "float", "real",
    ),
    "boolean": ("bit",),
    "string": ("char", "varchar", "nchar", "nvarchar", "text", "ntext"),
    "datetime": ("date", "time", "datetime", "datetime2", "smalldatetime", "datetimeoffset"),
    "binary": ("binary", "varbinary", "image"),
    "json": ("json",),
    "spatial": ("geometry", "geography"),
    "other": (
        "uniqueidentifier", "xml", "sql_variant", "hierarchyid", "rowversion", "timestamp",
    ),
}

MINMAX_FAMILIES = ("numeric", "datetime")


def base_type(native: Column) -> Column:
    """Type name without its modifiers, trimmed and in lower case."""
    return F.lower(F.trim(F.substring_index(native, "(", 1)))


def declared_family(native: Column) -> Column:
    """Family of a declared type name; unmapped names are ``unknown``."""
    base = base_type(native)
    chain = F.when(F.lit(False), F.lit(None).cast("string"))
    for family, names in DECLARED_FAMILIES.items():
        chain = chain.when(base.isin(*names), F.lit(family))
    return chain.otherwise(F.lit("unknown"))


def spark_family(dtype: T.DataType) -> str:
    """Family of a Spark data type."""
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, T.NumericType):
        return "numeric"
    if isinstance(dtype, (T.StringType, T.CharType, T.VarcharType)):
        return "string"
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    if isinstance(dtype, T.BinaryType):
        return "binary"
    if isinstance(dtype, T.VariantType):
        return "json"
    if isinstance(dtype, T.NullType):
        return "unknown"
    return "other"


def wants_minmax(family: Column) -> Column:
    return family.isin(*MINMAX_FAMILIES)


def match_family(family: Column, strict: bool) -> Column:
    """The join key that lets two columns meet; relaxed mode joins numbers and text."""
    if strict:
        return family
    return F.when(family.isin("numeric", "string"), F.lit("numeric|string")).otherwise(family)


def type_decision(family_a: Column, family_b: Column, strict: bool) -> Column:
    """Struct of the compatibility verdict for two families."""
    same = family_a == family_b
    castable = F.lit(not strict) & (
        ((family_a == "numeric") & (family_b == "string"))
        | ((family_a == "string") & (family_b == "numeric"))
    )
    return F.struct(
        (same | castable).alias("compatible"),
        family_a.alias("canonical_a"),
        family_b.alias("canonical_b"),
        F.when(same, F.lit(None).cast("string"))
        .when(castable, F.lit("cast_required"))
        .otherwise(F.lit("incompatible"))
        .alias("risk"),
        F.when(same, F.format_string("Same canonical family: %s", family_a))
        .when(castable, F.format_string("Cross-family cast: %s <-> %s", family_a, family_b))
        .otherwise(F.format_string("Incompatible families: %s vs %s", family_a, family_b))
        .alias("reason"),
    )
