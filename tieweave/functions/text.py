"""Text normalisation, tokens and the keys that stand for long texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts above this length are grouped by digest, so that they are not shuffled whole.
LONG_TEXT = 256
DIGEST_PREFIX = "sha256:"

# Unicode blanks plus the four separators that Java leaves out of \s.
_BLANK = r"[\s\x1c-\x1f]"

# The same as a list of characters, for trimming without a regular expression.
BLANKS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())

# Shapes that mark a value as an identifier.
IDENTIFIER_PATTERNS = (
    r"^[A-Z0-9]{8,}$",
    r"^[A-Z]{2,}-\d{3,}",
    r"^\d{10,14}$",
    r"^[A-Z]{2}\d{5,}$",
)

# Column names that suggest categories.
CATEGORICAL_NAMES = (
    "status", "type", "category", "class", "region", "state", "country", "county", "area",
    "zone", "code", "phase", "unit", "stage", "color", "grade", "lithology",
)


def is_long(text: Column) -> Column:
    """Texts that go by digest: long ones, and those that would pass for a digest."""
    return (F.length(text) > LONG_TEXT) | text.startswith(DIGEST_PREFIX)


def is_key_of_long(key: Column) -> Column:
    return F.coalesce(key.startswith(DIGEST_PREFIX), F.lit(False))


def sql_is_long(text: str) -> str:
    return f"(length({text}) > {LONG_TEXT} OR startswith({text}, '{DIGEST_PREFIX}'))"


def text_key(text: Column) -> Column:
    """The text itself, or its digest when it is long."""
    return F.when(is_long(text), F.concat(F.lit(DIGEST_PREFIX), F.sha2(text, 256))).otherwise(text)


def sql_digest(text: str) -> str:
    return f"concat('{DIGEST_PREFIX}', sha2({text}, 256))"


def sql_text_key(text: str) -> str:
    """:func:`text_key` as a SQL expression."""
    return f"if({sql_is_long(text)}, {sql_digest(text)}, {text})"


def sql_strip_blanks(text: str) -> str:
    codes = "".join(f"\\u{ord(c):04x}" for c in BLANKS)
    return f"btrim({text}, '{codes}')"


def strip_blanks(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def normalised(text: Column) -> Column:
    return strip_blanks(F.lower(text))


def tokens(text: Column) -> Column:
    """Distinct lower-case tokens between blanks."""
    parts = F.split(F.lower(text), f"(?U){_BLANK}+")
    return F.array_distinct(F.filter(parts, lambda t: t != ""))


def identifier_hits(text: Column) -> Column:
    """How many identifier patterns the value matches."""
    hits = [F.when(text.rlike(f"(?U){p}"), 1).otherwise(0) for p in IDENTIFIER_PATTERNS]
    total = hits[0]
    for hit in hits[1:]:
        total = total + hit
    return total


def has_digit(text: Column) -> Column:
    return text.rlike(r"(?U)\d")


def has_special(text: Column) -> Column:
    return text.rlike(r"(?U)[^a-zA-Z0-9\s\x1c-\x1f]")


def sql_identifier_hits(text: str) -> str:
    return " + ".join(f"CAST({text} RLIKE r'(?U){p}' AS INT)" for p in IDENTIFIER_PATTERNS)


def sql_has_digit(text: str) -> str:
    return f"{text} RLIKE r'(?U)\\d'"


def sql_has_special(text: str) -> str:
    return f"{text} RLIKE r'(?U)[^a-zA-Z0-9\\s\\x1c-\\x1f]'"


def short_label(key: Column) -> Column:
    """Last two parts of a dotted key."""
    return F.substring_index(key, ".", -2)


def node_parts(key: Column) -> Column:
    """Connection, schema and table of a dotted node key."""
    parts = F.split(key, r"\.")
    n = F.size(parts)
    return F.struct(
        F.when(n >= 3, F.get(parts, F.lit(0))).otherwise("").alias("connection_id"),
        F.when(n >= 3, F.get(parts, F.lit(1)))
        .when(n == 2, F.get(parts, F.lit(0)))
        .otherwise("")
        .alias("schema_name"),
        F.when(n >= 3, F.get(parts, F.lit(2)))
        .when(n == 2, F.get(parts, F.lit(1)))
        .otherwise("")
        .alias("table_name"),
    )


def edge_key(*parts: Column | str) -> Column:
    """The parts of an edge as one text."""
    return F.concat_ws("|", *parts)
