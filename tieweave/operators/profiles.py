"""Column and table profiles."""

from __future__ import annotations

import hashlib
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tieweave.config import Config
from tieweave.functions.families import wants_minmax
from tieweave.functions.scores import ratio
from tieweave.operators.values import (
    has_value,
    quoted,
    rank_values,
    restore_long_texts,
    value_order,
)
from tieweave.sources.catalog import Catalog

# Note of each profiling mode.
MODE_NOTES = {
    "A": "Full pushdown profiling",
    "B": "Hybrid profiling (full aggregates + sampled strings)",
    "C": "Progressive sampling mode (using pushdown baseline)",
}
MAX_STRING_COLUMNS_FOR_B = 20


def decimal_order(digits: Column) -> Column:
    """A struct that orders plain decimal texts by number: sign, digits before the point, digits.

    Digits of negative numbers are turned round, with an end mark above any digit.
    """
    bare = F.regexp_replace(digits, "^-", "")
    negative = digits.startswith("-")
    size = F.length(F.substring_index(bare, ".", 1))
    turned = F.concat(F.translate(bare, "0123456789", "9876543210"), F.lit("~"))
    return F.when(
        digits.isNotNull(),
        F.struct(
            F.when(negative, -1).otherwise(1).alias("sign"), F.when(negative, -size).otherwise(size).alias("size"),
            F.when(negative, turned).otherwise(bare).alias("order"), digits.alias("digits"),
        ),
    )


def column_profiles(values: DataFrame, columns: DataFrame) -> DataFrame:
    """Counts, ratios and range of every column; one aggregation over the value relation."""
    present = has_value()
    # Decimals that neither a bigint nor a double holds; texts of other columns are no numbers here.
    decimals = columns.where(wants_minmax(F.col("family")) & F.col("native_type").startswith("decimal"))
    wides = {name: decimal_order(F.lit(None).cast("string")) for name in ("least_wide", "most_wide")}
    ends_of_wides = []
    if not decimals.isEmpty():  # otherwise left out: for the least of a struct Spark sorts all values
        numbers = decimals.select("col_id", F.lit(True).alias("is_decimal"))
        values = values.join(numbers, "col_id", "left")
        wide = F.when(F.col("is_decimal") & F.col("k_txt").isNotNull(), decimal_order(F.col("k_txt")))
        wides, ends_of_wides = {}, [F.min(wide).alias("least_wide"), F.max(wide).alias("most_wide")]
    counts = values.groupBy("col_id").agg(
        F.sum("cnt").alias("row_count"),
        F.sum(F.when(present, F.col("cnt"))).alias("non_null_count"),
        F.count(F.when(present, 1)).alias("distinct_count"),
        F.min("k_num").alias("min_long"),
        F.max("k_num").alias("max_long"),
        F.min("k_dbl").alias("min_dbl"),
        F.max("k_dbl").alias("max_dbl"),
        F.min("k_ts").alias("min_ts"),
        F.max("k_ts").alias("max_ts"),
        *ends_of_wides,
    ).withColumns(wides)
    ranged = wants_minmax(F.col("family"))
    whole = F.col("min_dbl").isNull() & F.col("least_wide").isNull()

    def ends(wide: str, long: str, double: str):
        """The exact ends of a decimal column by kind of key; none for other columns."""
        plain = F.regexp_replace(F.regexp_replace(F.col(double).try_cast("decimal(38,18)").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
        kinds = [F.col(wide), decimal_order(F.col(long).cast("string")), decimal_order(plain)]
        return F.when(F.col("native_type").startswith("decimal"), F.array_compact(F.array(*kinds)))

    rows = columns.join(counts, "col_id", "left").select(
        *columns.columns,
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("row_count", "non_null_count", "distinct_count")],
        F.when(ranged, F.least("min_dbl", F.col("min_long").cast("double"), F.col("least_wide.digits").try_cast("double"))).alias("min_num"),
        F.when(ranged, F.greatest("max_dbl", F.col("max_long").cast("double"), F.col("most_wide.digits").try_cast("double"))).alias("max_num"),
        F.when(ranged & whole, F.col("min_long")).alias("min_long"),
        F.when(ranged & whole, F.col("max_long")).alias("max_long"),
        F.when(ranged, F.array_min(ends("least_wide", "min_long", "min_dbl"))["digits"]).alias("min_dec"),
        F.when(ranged, F.array_max(ends("most_wide", "max_long", "max_dbl"))["digits"]).alias("max_dec"),
        F.when(ranged, F.col("min_ts")).alias("min_ts"),
        F.when(ranged, F.col("max_ts")).alias("max_ts"),
    )
    return (
        rows.withColumn("null_count", F.col("row_count") - F.col("non_null_count"))
        .withColumn("null_ratio", F.round(ratio(F.col("null_count"), F.col("row_count")), 6))
        .withColumn("distinct_ratio", F.round(ratio(F.col("distinct_count"), F.col("non_null_count")), 6))
        .withColumn("uniqueness_ratio", F.round(ratio(F.col("distinct_count"), F.col("row_count")), 6))
        .withColumn("profiling_mode", F.lit("A"))
    )


def top_keys(values: DataFrame, columns: DataFrame, limit: int) -> DataFrame:
    """The most frequent values of each column as keys, ties in value order.

    Nested columns have no top values, as types that cannot be grouped had none.
    """
    grouped = columns.where(F.col("family") != "other").select("col_id")
    rows = values.where(has_value()).join(grouped, "col_id", "left_semi")
    return rank_values(rows, ("col_id",), [F.desc("cnt"), *value_order()], limit)


def top_values(
    values: DataFrame, columns: DataFrame, catalog: Catalog, limit: int = Config.top_n
) -> DataFrame:
    """The most frequent values of each column, readable."""
    ranked = restore_long_texts(
        top_keys(values, columns, limit).withColumn("is_long", F.col("long").isNotNull()), catalog
    )
    return columns.join(ranked, "col_id").select(
        *columns.columns,
        "rank",
        "cnt",
        F.coalesce("k_dbl", F.col("k_num").cast("double")).alias("value_num"),
        F.col("k_num").alias("value_long"),
        F.col("k_ts").alias("value_ts"),
        "value_str",
    )


def profiling_modes(columns: DataFrame, row_counts: DataFrame, config: Config) -> DataFrame:
    """Mode, note and sampling decision of each table."""
    widths = columns.groupBy("table_key", "schema_name", "table_name").agg(
        F.count(F.lit(1)).alias("column_count"),
        F.count_if(F.col("family") == "string").alias("string_columns"),
    )
    rows = widths.join(row_counts, "table_key", "left").withColumn(
        "row_count", F.coalesce("row_count", F.lit(0))
    )
    rows = rows.withColumn(
        "profiling_mode",
        F.when(F.col("row_count") <= config.mode_a_max_rows, "A")
        .when(F.col("string_columns") <= MAX_STRING_COLUMNS_FOR_B, "B")
        .otherwise("C"),
    )
    note = F.when(F.lit(False), F.lit(""))
    for mode, text in MODE_NOTES.items():
        note = note.when(F.col("profiling_mode") == mode, text)
    return rows.withColumn("profiling_note", note).withColumn(
        "sampled",
        F.lit(config.sample_fraction is not None) & F.col("profiling_mode").isin("B", "C"),
    )


def has_file_names(frame: DataFrame) -> bool:
    """Whether rows of ``frame`` know their file: it is a scan, not a join or aggregation of some."""
    try:
        frame.select("_metadata.file_name").schema
    except AnalysisException:
        return False
    return True


def sampled_scans(catalog: Catalog, modes: DataFrame, config: Config) -> dict[str, DataFrame]:
    """Samples of the tables marked ``sampled``; one driver-side row per such table.

    A row belongs to the sample by the md5 of its primary key (of all columns where none is
    declared), so a task that runs again, or another partitioning, takes the same rows.  With ``sample_by``
    ``files`` a file does by the md5 of its name, with all its rows, and the others are pruned from the scan; the
    one with the least md5 always does.  Tables that are not read from files are sampled by rows.
    """
    if config.sample_fraction is None:
        return {}
    last = f"{min(int(config.sample_fraction * 2**32), 2**32 - 1):08x}"
    keys: dict[str, list[str]] = {}
    for k in catalog.keys:
        if k["is_primary_key"]:
            keys.setdefault(k["table_key"], []).append(k["column_name"])
    samples = {}
    for r in modes.where("sampled").select("table_key").toLocalIterator():
        frame = catalog.tables[r["table_key"]]
        files = frame.inputFiles() if config.sample_by == "files" and "_metadata" not in frame.columns else []
        if files and has_file_names(frame):
            least = min(hashlib.md5(unquote(f.rsplit("/", 1)[-1]).encode()).hexdigest() for f in files)
            samples[r["table_key"]] = frame.where(f"left(md5(_metadata.file_name), 8) <= '{max(last, least[:8])}'")
            continue
        named = [quoted(c) for c in keys.get(r["table_key"], frame.columns)]
        texts = [f"coalesce(CAST({c} AS STRING), '')" for c in named]
        samples[r["table_key"]] = frame.where(f"left(md5(concat_ws('|', {', '.join(texts)})), 8) < '{last}'")
    return samples
