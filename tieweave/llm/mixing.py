"""Mixing sources to target weights along a curriculum that changes over the training run."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tieweave.llm.common import WORD, shuffle_partitions
from tieweave.session import materialize

#: Weights of the sources in code point order, repeating, and the start and end of each
#: weight's schedule relative to its mean: heavy sources come early, light ones late.
WEIGHTS = (5, 2, 1)
SCHEDULES = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))
#: Words of the mix in halves of the words of all documents, and the most copies of a document.
HALVES = 3
MAX_COPIES = 2


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def order_key() -> Column:
    """md5 of id, source and text: a fixed random order that does not depend on how rows are stored."""
    return F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("doc_id", "source", "text")]))


def _nth(values: Sequence, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def source_targets(
    sizes: DataFrame, weights: Sequence[int] = WEIGHTS, halves: int = HALVES, max_copies: int = MAX_COPIES
) -> DataFrame:
    """Targets of the sources of ``sizes`` (source, size), one row each.

    The mix has ``halves / 2`` times all words.  A source gets its share by weight, but at most
    ``max_copies`` times its own words; what is above goes to the others by weight.  A source is
    at its limit exactly if its limit is at most its share of what those with a lower ratio of
    limit to weight leave, so one pass over the sources in that order finds all of them.

    All arithmetic but the last division is in whole numbers.  The windows run over one row for
    each source, which is also what a list of weights is as long as.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = by_source.withColumn("nth", (F.row_number().over(by_name) - 1) % len(weights))
    ranked = ranked.withColumn("weight", _nth(weights, F.col("nth")).cast("long"))
    ranked = ranked.withColumn("limit", F.col("source_size") * max_copies)
    by_ratio = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    lower = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    # Twice the words that are left for this source and those of higher ratios.
    left = F.sum("source_size").over(everything) * halves - 2 * F.coalesce(F.sum("limit").over(lower), F.lit(0))
    full = 2 * F.col("limit") * F.sum("weight").over(rest) <= F.col("weight") * left
    marked = ranked.withColumn("full", full)
    open_words = F.sum("source_size").over(everything) * halves - 2 * F.sum(
        F.when(F.col("full"), F.col("limit")).otherwise(0)
    ).over(everything)
    open_weight = F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(everything)
    share = (F.col("weight") * open_words).cast("double") / (2 * open_weight).cast("double")
    return marked.select(
        "source", "source_size", "nth", F.when(F.col("full"), F.col("limit").cast("double")).otherwise(share).alias("target")
    )


def training_time(share: Column, begin: Column, end: Column) -> Column:
    """When a source has met ``share`` of its demand, for a weight that goes from begin to end.

    The weight at time ``t`` is ``begin + (end - begin) t``, scaled to a mean of one; its integral
    is ``begin t + (end - begin) t^2 / 2``.  This is the inverse of that, for t from 0 to 1.
    """
    mean = (begin + end) / 2
    slope = (end - begin) / mean
    first = begin / mean
    root = F.sqrt(F.greatest(first * first + 2 * slope * share, F.lit(0.0)))
    return F.when(slope == 0, share).otherwise((root - first) / F.when(slope == 0, 1.0).otherwise(slope))


def mix(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    schedules: Sequence[tuple[float, float]] = SCHEDULES,
    halves: int = HALVES,
    max_copies: int = MAX_COPIES,
) -> DataFrame:
    """Decides how many words of each document of ``docs`` (doc_id, text, source) the mix takes.

    The documents of a source stand in a fixed random order (``order_key``).  Its demand runs
    along that order, over again if it wants more words than it has, and ends in the word where
    its target, rounded down, is met.  So a document is taken whole as often as the demand passes
    it, and the one in which it ends is taken in part.

    One row per document: doc_id, order_key, size, source_size, target, taken, and ``positions``,
    an array of (copy, words, position) with one entry per copy taken; position is the training
    time, from 0 to 1, at which the source's integrated weight schedule has asked for the words
    before the copy.

    Sums along the order are taken per source in 4096 slices of the hash first, then inside each
    slice, so a source with a third of all rows is spread over many tasks.  Only ids, hashes and
    sizes are shuffled.

    Null or wordless texts have size 0 and are never taken.  Null sources are one source, the
    last.  Repeated rows count each for itself.  An empty table gives no rows.  Other columns are
    not read.
    """
    if len(schedules) != len(weights):
        raise ValueError("one schedule for each weight")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "source", word_count("text").alias("size"),
        order_key().alias("order_key"),
    )
    # Read three times below; the words of each text are counted once.
    sized = materialize(rows.withColumn("slice", F.substring("order_key", 1, 3)), "sizes")
    targets = source_targets(sized, weights, halves, max_copies)
    slices = sized.groupBy("source", "slice").agg(F.sum("size").alias("slice_size"))
    before = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    bases = slices.withColumn("base", F.coalesce(F.sum("slice_size").over(before), F.lit(0)))
    known = bases.join(targets, bases["source"].eqNullSafe(targets["source"])).select(
        bases["source"].alias("of_source"), F.col("slice").alias("of_slice"), "base", "source_size", "target", "nth"
    )
    within = Window.partitionBy("source", "slice").orderBy("order_key", "doc_id", "size").rowsBetween(
        Window.unboundedPreceding, -1
    )
    placed = sized.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0))).join(
        known, F.col("source").eqNullSafe(F.col("of_source")) & (F.col("slice") == F.col("of_slice"))
    )
    demand = F.floor("target").cast("long")
    begins = F.array(*[F.col("base") + F.col("inside") + copy * F.col("source_size") for copy in range(max_copies)])
    copies = F.transform(
        begins,
        lambda begin, copy: F.struct(
            copy.cast("int").alias("copy"),
            F.greatest(F.least(F.col("size"), demand - begin), F.lit(0)).alias("words"),
            training_time(
                F.try_divide(begin, F.col("target")), _nth([s[0] for s in schedules], F.col("nth")), _nth([s[1] for s in schedules], F.col("nth"))
            ).alias("position"),
        ),
    )
    taken = F.filter(copies, lambda c: c["words"] > 0)
    rows = placed.withColumn("positions", taken)
    return rows.select(
        "doc_id", "order_key", "size", "source_size", "target",
        F.aggregate("positions", F.lit(0).cast("long"), lambda sum_, c: sum_ + c["words"]).alias("taken"), "positions",
    )


def in_training_order(rows: DataFrame, position: str, *ties: str) -> DataFrame:
    """Range-sorted by position: partitions follow each other and are sorted inside."""
    parts = shuffle_partitions(rows.sparkSession)
    return rows.repartitionByRange(parts, position, *ties).sortWithinPartitions(position, *ties)


def first_words(text: Column, words: Column) -> Column:
    """The text up to and with its ``words``-th word."""
    # Each match is a word with the blanks before it, so the matches are consecutive.
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), F.lit(1), words.cast("int")), "")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix in training order, with the columns of ``docs``.

    A document stands as often as it is taken; a copy that is taken in part holds the words taken,
    and its ``n_chars`` is theirs.  Rows equal in id, source and text share their other columns.
    """
    columns = [c for c in docs.columns if not c.startswith("_mix_")]
    chosen = mix(docs, **options).where("taken > 0").select(
        F.col("order_key").alias("_mix_key"), F.col("size").alias("_mix_size"),
        F.inline("positions").alias("_mix_copy", "_mix_words", "_mix_position"),
    )
    keyed = docs.select(*columns, order_key().alias("_mix_key")).dropDuplicates(["_mix_key"])
    cut = F.col("_mix_words") < F.col("_mix_size")
    mixed = keyed.join(chosen, "_mix_key").withColumn(
        "text", F.when(cut, first_words(F.col("text"), F.col("_mix_words"))).otherwise(F.col("text"))
    )
    if "n_chars" in columns:
        mixed = mixed.withColumn(
            "n_chars", F.when(cut, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
        )
    return in_training_order(mixed, "_mix_position", "_mix_key", "_mix_copy").select(*columns)
