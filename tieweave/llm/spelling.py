"""Spelling variants: words one edit apart, found by k-d trees over letter counts."""

from __future__ import annotations

from itertools import product
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tieweave.llm.common import shuffle_partitions
from tieweave.session import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Dimensions of a vector: the letters a to z, and the other letters dealt out over the rest.
DIMENSIONS, OTHERS = 32, 6
#: Words of one leaf, of one block (a leaf times a power of two), and code points of one block at most.
LEAF = 16
BLOCK = LEAF << 9
BLOCK_LETTERS = 1 << 22
#: Pairs of leaves that are compared at once.
AT_ONCE = 1 << 12


def words_of(docs: DataFrame, every: int = 31, letters: int = 1) -> DataFrame:
    """One row (word) for each run of ``letters`` letters or more of ``docs`` (doc_id, text), A-Z in lower case.

    With h the crc32 of ``<doc_id>:<run>``, a run whose h is divisible by ``every`` loses its code
    point number h modulo its length.  Null texts have no runs; a null id counts as an empty one.
    """
    text = F.translate("text", UPPER, LOWER)
    runs = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(text, F.lit(f"[a-zÀ-ÿ]{{{letters},}}"), F.lit(0))).alias("run"),
    )
    h = F.crc32(F.concat_ws(":", "id", "run"))
    at = F.pmod(F.col("h"), F.length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return runs.withColumn("h", h).select(F.when(F.pmod("h", F.lit(every)) == 0, shorter).otherwise(F.col("run")).alias("word"))


def counted(words: DataFrame, letters: int = 7, least: int = 2) -> DataFrame:
    """(word, n) of the words of ``letters`` code points or more that occur ``least`` times or more."""
    long = words.where(F.length("word") >= letters)
    return long.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def code_points(words: list[str], length: int) -> np.ndarray:
    """A row of code points for each of the words, which all have ``length``."""
    return np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4").reshape(-1, length)


def letter_counts(points: np.ndarray, order: list[int]) -> np.ndarray:
    """Vectors of letter counts (at most 255 each), their dimensions in the given order."""
    places = np.where((points >= 97) & (points <= 122), points - 97, 26 + points % OTHERS).astype(np.int64)
    where = np.empty(DIMENSIONS, np.int64)
    where[order] = np.arange(DIMENSIONS)
    cells = where[places] + DIMENSIONS * np.arange(len(points))[:, None]
    vectors = np.bincount(cells.reshape(-1), minlength=DIMENSIONS * len(points)).reshape(-1, DIMENSIONS)
    return np.minimum(vectors, 255).astype(np.uint8)


def signatures(vectors: np.ndarray) -> np.ndarray:
    """64 bits a vector: two for each dimension, set in turn by a count of one and of two.

    The number of differing bits is at most the L1 distance of the vectors.
    """
    bits = np.stack([vectors >= 1, vectors >= 2], axis=2).reshape(len(vectors), 2 * DIMENSIONS)
    return np.packbits(bits, axis=1).view(">u8").reshape(-1).astype(np.uint64)


def tree_order(vectors: np.ndarray) -> np.ndarray:
    """Order of the rows by leaves of a k-d tree: halves at the median of the widest dimension, as halves again."""
    found: list[np.ndarray] = []
    size = LEAF
    while size < len(vectors):
        size *= 2
    # Left halves are filled to the size of a whole subtree, so that leaf k is rows 16 k to 16 k + 15.
    todo = [(np.arange(len(vectors)), size)]
    while todo:
        rows, size = todo.pop()
        if size <= LEAF or len(rows) <= 1:
            found.append(rows)
            continue
        half = size // 2
        if len(rows) > half:
            some = vectors[rows].astype(np.int16)
            widest = int(np.argmax(some.var(axis=0)))
            rows = rows[np.argpartition(some[:, widest], half - 1)]
        todo += [(rows[half:], half), (rows[:half], half)]
    return np.concatenate(found) if found else np.empty(0, np.int64)


def boxes(vectors: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Least and largest corner of every node, a pair of arrays for each level from the leaves up."""
    starts = np.arange(0, len(vectors), LEAF)
    levels = [(np.minimum.reduceat(vectors, starts), np.maximum.reduceat(vectors, starts))]
    while len(levels[-1][0]) > 1:
        low, high = levels[-1]
        starts = np.arange(0, len(low), 2)
        levels.append((np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts)))
    return levels


def near_leaves(a: np.ndarray, b: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of leaves of two ordered blocks whose boxes are at most 2 apart, by descent of both trees."""
    left, right = boxes(a), boxes(b)
    top = max(len(left), len(right))
    left += [left[-1]] * (top - len(left))
    right += [right[-1]] * (top - len(right))
    i = j = np.zeros(1, np.int64)
    for level in range(top - 1, -1, -1):
        if level < top - 1:
            down = [
                [at] if len(here[0]) == len(above[0]) else [2 * at, 2 * at + 1]
                for at, here, above in ((i, left[level], left[level + 1]), (j, right[level], right[level + 1]))
            ]
            i, j = (np.concatenate(side) for side in zip(*product(*down)))
            there = (i < len(left[level][0])) & (j < len(right[level][0]))
            if same:
                there &= i <= j
            i, j = i[there], j[there]
        kept = [np.zeros(0, np.int64)]
        for begin in range(0, len(i), 1 << 15):
            x, y = i[begin : begin + (1 << 15)], j[begin : begin + (1 << 15)]
            (a_low, a_high), (b_low, b_high) = left[level], right[level]
            gap = np.maximum(np.maximum(a_low[x].astype(np.int16) - b_high[y], b_low[y].astype(np.int16) - a_high[x]), 0)
            kept.append(begin + np.flatnonzero(gap.sum(axis=1) <= 2))
        kept = np.concatenate(kept)
        i, j = i[kept], j[kept]
    return i, j


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether each row of ``a`` is exactly one edit from the row of ``b``, as long or one longer."""
    length = a.shape[1]
    if b.shape[1] == length:
        return (a != b).sum(axis=1) == 1
    front = np.logical_and.accumulate(a == b[:, :length], axis=1).sum(axis=1)
    back = np.logical_and.accumulate((a == b[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return front + back >= length


def near_words(a: list[str], b: list[str], order: list[int], same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows of two blocks, each in the order of its tree, whose words are one edit apart."""
    a_points, b_points = code_points(a, len(a[0])), code_points(b, len(b[0]))
    a_counts = letter_counts(a_points, order)
    b_counts = a_counts if same else letter_counts(b_points, order)
    a_bits, b_bits = signatures(a_counts), signatures(b_counts)
    leaf_i, leaf_j = near_leaves(a_counts, b_counts, same)
    inside = np.arange(LEAF)
    found_i, found_j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for begin in range(0, len(leaf_i), AT_ONCE):
        x = leaf_i[begin : begin + AT_ONCE, None] * LEAF + inside
        y = leaf_j[begin : begin + AT_ONCE, None] * LEAF + inside
        bits = np.bitwise_count(a_bits[np.minimum(x, len(a) - 1)][:, :, None] ^ b_bits[np.minimum(y, len(b) - 1)][:, None, :])
        at, p, q = np.unravel_index(np.flatnonzero(bits <= 2), bits.shape)
        i, j = x[at, p], y[at, q]
        there = (i < len(a)) & (j < len(b))
        if same:
            there &= i < j
        i, j = i[there], j[there]
        for part in range(0, len(i), 1 << 16):
            some_i, some_j = i[part : part + (1 << 16)], j[part : part + (1 << 16)]
            right = one_edit(a_points[some_i], b_points[some_j])
            found_i.append(some_i[right])
            found_j.append(some_j[right])
    return np.concatenate(found_i), np.concatenate(found_j)


def letter_order(words: DataFrame) -> list[int]:
    """Dimensions by how evenly they part the ``words``; one row of 26 counts reaches the driver."""
    shares = words.agg(
        F.count(F.lit(1)).alias("all"), *[F.count_if(F.contains("word", F.lit(c))).alias(c) for c in LOWER]
    ).first()
    uneven = [abs(shares[c] / max(shares["all"], 1) - 0.5) for c in LOWER]
    return sorted(range(26), key=lambda c: (uneven[c], c)) + list(range(26, DIMENSIONS))


def word_blocks(words: DataFrame, order: list[int]) -> DataFrame:
    """Blocks (block, length, words, low, high) of up to ``BLOCK`` words of one length.

    Words are sorted by length and signature, which parts them by the first dimensions, so blocks
    have narrow boxes.  Inside a block they lie in the order of its own k-d tree.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column("word").to_pylist()
            lengths = np.array([len(w) for w in words], np.int64)
            found = np.zeros(len(words), np.uint64)
            for length in np.unique(lengths).tolist():
                rows = np.flatnonzero(lengths == length)
                step = max(1, BLOCK_LETTERS // length)
                for at in range(0, len(rows), step):
                    some = rows[at : at + step]
                    found[some] = signatures(letter_counts(code_points([words[r] for r in some], length), order))
            # Signed longs in the order of the unsigned ones.
            signed = (found ^ np.uint64(1 << 63)).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("word"), pa.array(lengths), pa.array(signed)], names=["word", "length", "bits"]
            )

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: list[str] = []

        def block() -> pa.RecordBatch:
            counts = letter_counts(code_points(held, len(held[0])), order)
            ordered = [held[r] for r in tree_order(counts).tolist()]
            columns = [
                pa.array([number]), pa.array([len(held[0])], pa.int64()), pa.array([" ".join(ordered)]),
                pa.array([counts.min(axis=0).tolist()], pa.list_(pa.int32())),
                pa.array([counts.max(axis=0).tolist()], pa.list_(pa.int32())),
            ]
            return pa.RecordBatch.from_arrays(columns, names=["block", "length", "words", "low", "high"])

        for batch in batches:
            for word in batch.column("word").to_pylist():
                if held and (len(word) != len(held[0]) or len(held) >= min(BLOCK, max(1, BLOCK_LETTERS // len(word)))):
                    yield block()
                    held, number = [], number + 1
                held.append(word)
        if held:
            yield block()

    signed = materialize(words.select("word").mapInArrow(sign, "word string, length long, bits long"), "signed")
    ranged = signed.repartitionByRange(shuffle_partitions(words.sparkSession), "length", "bits", "word")
    ranged = ranged.sortWithinPartitions("length", "bits", "word")
    kinds = "block long, length long, words string, low array<int>, high array<int>"
    return materialize(ranged.select("word").mapInArrow(build, kinds), "word-blocks")


def near_links(words: DataFrame) -> DataFrame:
    """(word, near), both ways, of all distinct ``words`` (word) exactly one edit apart.

    One insertion, deletion or replacement changes letter counts by an L1 distance of two at most.
    Blocks of equal lengths and of lengths one apart meet if their boxes are at most two apart; in a
    task both trees are descended together, words of leaves that remain are compared by the bits of
    their counts, and what is left letter by letter.
    """
    order = letter_order(words)
    blocks = word_blocks(words, order)
    light = blocks.select("block", "length", "low", "high")
    gap = F.aggregate(
        F.arrays_zip("low", "high", "b_low", "b_high"), F.lit(0),
        lambda total, x: total + F.greatest(x["low"] - x["b_high"], x["b_low"] - x["high"], F.lit(0)),
    )
    second = light.select(
        F.col("block").alias("b_block"), F.col("length").alias("b_length"), F.col("low").alias("b_low"), F.col("high").alias("b_high")
    )
    first = light.withColumn("b_length", F.explode(F.array(F.col("length"), F.col("length") + 1)))
    met = first.join(second, "b_length").where((F.col("b_length") != F.col("length")) | (F.col("block") <= F.col("b_block")))
    met = materialize(met.where(gap <= 2).select("block", "b_block"), "met")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a_block, a, b_block, b in zip(*[batch.column(c).to_pylist() for c in ("block", "words", "b_block", "b_words")]):
                left, right = a.split(" "), b.split(" ")
                i, j = near_words(left, right, order, a_block == b_block)
                ends = [left[x] for x in i.tolist()], [right[x] for x in j.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ends[0] + ends[1], pa.string()), pa.array(ends[1] + ends[0], pa.string())], names=["word", "near"]
                )

    paired = met.join(blocks.select("block", "words"), "block").join(
        blocks.select(F.col("block").alias("b_block"), F.col("words").alias("b_words")), "b_block"
    )
    # Each pair of blocks is as much work as another, so they are dealt out evenly.
    dealt = paired.repartition(4 * shuffle_partitions(words.sparkSession), "block", "b_block")
    return materialize(dealt.mapInArrow(compare, "word string, near string"), "near")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of ``forms`` (word, form): the end of each word's chain of forms.

    A form occurs ten times as often as its word, so chains are short and have no cycles; each round
    doubles what is followed.
    """
    ends = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = ends.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = materialize(ends.join(further, "root", "left").select("word", "root", "next"), "roots")
        ends = moved.select("word", F.coalesce("next", "root").alias("root"))
        if moved.where("next IS NOT NULL").isEmpty():
            return ends


def grouped(words: DataFrame, times: int = 10) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of all ``words`` (word, n; each word once).

    A word's form is its near word of largest n (ties: the smaller in code-point order), if that is
    ``times`` the word's own n or more; root follows forms to the last.  No words give no rows.
    """
    words = materialize(words.select("word", "n"), "words")
    near = near_links(words).join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = near.groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    )
    much = -F.col("best.less") >= times * F.col("n")
    formed = materialize(
        words.join(best, "word", "left").select(
            "word", F.when(much, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(much, -F.col("best.less")).cast("long").alias("form_n"),
        ), "formed",
    )
    ends = roots(formed.where("form IS NOT NULL"))
    return formed.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def spelling_variants(docs: DataFrame, letters: int = 7, least: int = 2, times: int = 10) -> DataFrame:
    """Spelling variants among all words of ``docs`` (doc_id, text), see ``words_of`` and ``grouped``.

    Null and empty texts add nothing, repeated rows count as often as they stand, further columns of
    any name are not read.
    """
    return grouped(counted(words_of(docs.select("doc_id", "text"), letters=letters), letters, least), times)

