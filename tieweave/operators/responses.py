"""Relationship and description lists read out of model responses.

Input is ``responses(batch_id, text)``; nothing here talks to a model.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tieweave.functions.text import strip_blanks
from tieweave.operators.values import rank_values

# Field names under which a wrapper object may hold the list.
WRAPPER_FIELDS = ("results", "items", "data", "relationships", "descriptions")

RELATIONSHIP = (
    "struct<source_table:string,source_column:string,target_table:string,target_column:string,"
    "confidence:string,reasoning:string,rel_type:string>"
)
DESCRIPTION = "struct<table:string,column:string,description:string,data_type:string,domain_terms:variant>"

_FENCE = r"```(?:json)?\s*\n([\s\S]*?)\n```"
_LIST = r"(?s)\[.*\]"


def settled(rows: DataFrame, **columns: Column) -> DataFrame:
    """``rows`` with ``columns``, each worked out once for a row.

    A filter on them is not moved below the generator, where it would hold their expressions again, and theirs
    in turn, as often as they are named.
    """
    found = F.struct(*[column.alias(name) for name, column in columns.items()])
    return rows.select(*[c for c in rows.columns if c not in columns], F.inline(F.array(found)))


def json_part(responses: DataFrame) -> DataFrame:
    """Adds ``json``, the JSON of ``text``: out of its code fence, from the first ``[`` to the last ``]``."""
    kept = responses.columns
    fenced = settled(responses, _fenced=F.regexp_extract("text", _FENCE, 1))
    body = settled(fenced, _body=F.when(F.col("_fenced") != "", F.col("_fenced")).otherwise(F.col("text")))
    listed = settled(body, _listed=F.regexp_extract("_body", _LIST, 0))
    json = F.when(F.col("_listed") != "", F.col("_listed")).otherwise(strip_blanks(F.col("_body")))
    return settled(listed, json=json).select(*kept, "json")


def is_truncated(json: Column) -> Column:
    """True when the JSON of a response does not end with the closing bracket of a list."""
    return ~F.endswith(json, F.lit("]"))


def cleaned(json: Column) -> Column:
    """Curly quotes made plain and commas before a closing bracket taken out."""
    plain = F.translate(json, "“”‘’", "\"\"''")
    return F.regexp_replace(plain, r",\s*([}\]])", "$1")


def _tree(json: Column) -> Column:
    """The JSON as a variant; NULL when it is none or when anything follows its end.

    The parser stops at the end of the first value.  Put into an object and into a list,
    a text with a tail breaks at least one of the two.
    """
    in_object = F.try_parse_json(F.concat(F.lit('{"v":'), json, F.lit("}")))
    in_list = F.try_parse_json(F.concat(F.lit("["), json, F.lit("]")))
    return F.when(in_list.isNotNull(), F.try_variant_get(in_object, "$.v", "variant"))


def parse_responses(responses: DataFrame) -> DataFrame:
    """Each response with its list ``items`` (NULL when unreadable) and ``truncated``.

    The text is parsed as it is, and cleaned only when that fails; either way a text
    with anything behind its end is no JSON.  A wrapper object gives its list field.
    """
    json = json_part(responses)
    tree = settled(json, tree=F.coalesce(_tree(F.col("json")), _tree(cleaned(F.col("json")))))
    lists = [F.try_variant_get("tree", path, "array<variant>") for path in ("$", *(f"$.{f}" for f in WRAPPER_FIELDS))]
    found = settled(tree, items=F.coalesce(*lists), truncated=is_truncated(F.col("json")))
    return found.select(*responses.columns, "json", "items", "truncated")


def response_errors(parsed: DataFrame) -> DataFrame:
    """Responses that could not be read, with their JSON on one line for the report."""
    return parsed.where(F.col("items").isNull()).select(
        "batch_id", "truncated", F.translate("json", "\n", " ").alias("snippet")
    )


def _objects(parsed: DataFrame, schema: str) -> DataFrame:
    """Objects among the list elements; other elements are passed over."""
    items = parsed.select("batch_id", F.posexplode_outer("items").alias("position", "item"))
    return settled(items, r=F.try_variant_get("item", "$", schema)).where(F.col("r").isNotNull()).drop("item")


def relationships(parsed: DataFrame) -> DataFrame:
    """Relationships of all responses, with the defaults for missing fields."""
    def text(name: str, default: str = "") -> Column:
        return F.coalesce(f"r.{name}", F.lit(default)).alias(name)

    return _objects(parsed, RELATIONSHIP).select(
        "batch_id", "position",
        text("source_table"), text("source_column"), text("target_table"), text("target_column"),
        F.coalesce(F.col("r.confidence").try_cast("double"), F.lit(0.5)).alias("confidence"),
        text("reasoning"), text("rel_type", "one-to-many"),
    )


def column_descriptions(parsed: DataFrame) -> DataFrame:
    """Descriptions of all responses, with the defaults for missing fields."""
    return _objects(parsed, DESCRIPTION).select(
        "batch_id", "position",
        *[F.coalesce(f"r.{c}", F.lit("")).alias(c) for c in ("table", "column", "description", "data_type")],
        F.coalesce(
            F.try_variant_get("r.domain_terms", "$", "array<string>"), F.array().cast("array<string>")
        ).alias("domain_terms"),
    )


def one_description(descriptions: DataFrame) -> DataFrame:
    """One description per table column: the last response's where rows say which that is, else the
    greatest text."""
    order = [F.col(c).desc() for c in ("batch_id", "position", "description") if c in descriptions.columns]
    return rank_values(descriptions, ("table", "column"), order, 1).drop("rank")


def description_lookup(descriptions: DataFrame) -> DataFrame:
    """One description per table column; the last response that names it wins."""
    return one_description(descriptions).select("table", "column", "description")


def describe_columns(columns: DataFrame, lookup: DataFrame) -> DataFrame:
    """Columns of a catalogue with their description, NULL where there is none."""
    return columns.join(
        lookup.select(F.col("table").alias("table_key"), F.col("column").alias("column_name"), "description"),
        ["table_key", "column_name"],
        "left",
    )
