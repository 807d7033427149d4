"""Document fingerprints by a homomorphic multiset hash of paragraphs, as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tieweave.llm.common import WORD, shuffle_partitions

#: Lanes of 32 bits in which the SHA-512 digests of the paragraphs are summed.
WIDE = 16
#: Longs of the likeness part.  Each holds three counters of 21 bits, for three bits of a shingle's hash
#: that are as many places apart; 63 of the 64 bits are counted.
SKETCH = WIDTH = 21
PLACES = (0, 21, 42)
_ONES = sum(1 << p for p in PLACES)
_MASK = (1 << WIDTH) - 1
#: Hashes whose bits are counted in bytes before they are widened: no byte passes 127, so no long its sign.
BLOCK = 127
_EIGHTHS = sum(1 << p for p in range(0, 64, 8))
SHINGLE = 3


def paragraphs(text: Column) -> Column:
    """The lines of a text; null is the empty text, which is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _wide(lines: Column) -> Column:
    """Sum of the paragraphs' digests, lane by lane modulo 2^32."""

    def lane(digest: Column, n: int) -> Column:
        return F.conv(F.substring(digest, 8 * n + 1, 8), 16, 10).cast("long")

    zero = F.array(*[F.lit(0).cast("long")] * WIDE)
    digests = F.transform(lines, lambda line: F.sha2(line, 512))
    return F.aggregate(
        digests, zero, lambda sums, digest: F.array(*[(sums[n] + lane(digest, n)).bitwiseAND(F.lit(0xFFFFFFFF)) for n in range(WIDE)])
    )


def _hashes(lines: Column) -> Column:
    """64-bit hashes of the word shingles inside each paragraph (fewer words: of them all)."""

    # Words are a lambda's argument below, so that they are cut once for each paragraph.
    words_of = F.transform(lines, lambda line: F.regexp_extract_all(line, F.lit(WORD), F.lit(0)))

    def of(words: Column) -> Column:
        count = F.greatest(F.size(words) - (SHINGLE - 1), F.least(F.size(words), F.lit(1)))
        return F.transform(
            F.slice(words, F.lit(1), count),
            lambda word, at: F.xxhash64(word, *[F.get(words, at + n) for n in range(1, SHINGLE)]),
        )

    return F.flatten(F.transform(words_of, of))


def _sketch(hashes: Column) -> Column:
    """The number of hashes, and for each of 63 of their bits how many have it, modulo 2^21.

    The counter for bit ``21 j + k`` is the ``j``-th of long ``k``.  Bits are counted in blocks of
    ``BLOCK`` hashes first, eight bits by one plain sum; the blocks' counters are then added three at a
    time, without a carry from one into the next.
    """
    every = F.lit(_EIGHTHS).cast("long")
    high = F.lit(_ONES * (_MASK >> 1)).cast("long")
    top = F.lit(_ONES << (WIDTH - 1)).cast("long")  # the highest bit of each counter

    def eighths(block: Column) -> Column:
        """Byte ``p`` of long ``k``: how many hashes of the block have bit ``8 p + k``."""
        bits = lambda h, k: F.call_function("shiftrightunsigned", h, k).bitwiseAND(every)
        return F.transform(
            F.sequence(F.lit(0), F.lit(7)),
            lambda k: F.aggregate(block, F.lit(0).cast("long"), lambda total, h: total + bits(h, k)),
        )

    def placed(counts: Column, k: int) -> Column:
        out = F.lit(0).cast("long")
        for place in PLACES:
            bit = place + k
            one = F.shiftright(F.get(counts, F.lit(bit % 8)), 8 * (bit // 8)).bitwiseAND(F.lit(BLOCK))
            out = out.bitwiseOR(F.shiftleft(one, place))
        return out

    def added(totals: Column, counts: Column) -> Column:
        return F.zip_with(
            totals, F.array(*[placed(counts, k) for k in range(SKETCH)]),
            lambda total, more: (total.bitwiseAND(high) + more).bitwiseXOR(total.bitwiseAND(top)),
        )

    def whole(all_: Column) -> Column:
        size = F.size(all_)
        last = F.greatest(F.floor((size - 1) / BLOCK).cast("int"), F.lit(0))
        blocks = F.transform(
            F.sequence(F.lit(0), last), lambda n: eighths(F.slice(all_, n * BLOCK + 1, F.lit(BLOCK)))
        )
        totals = F.aggregate(blocks, F.array_repeat(F.lit(0).cast("long"), SKETCH), added)
        return F.concat(F.array(size.cast("long").bitwiseAND(F.lit(_MASK))), totals)

    # As a lambda's argument the hashes are computed once.
    return F.transform(F.array(hashes), whole)[0]


def fingerprint(text: Column) -> Column:
    """An array of longs: 16 lanes of digests, the number of shingles, 21 longs of counters.

    Each paragraph has a vector: its digest's lanes, its number of shingles, the bit counts of its
    shingles' hashes.  The text's is their sum modulo 2^32 and 2^21, so it does not depend on the
    order of the paragraphs, and adding or taking away a paragraph's vector inserts or deletes it.
    """
    lines = paragraphs(text)
    return F.concat(_wide(lines), _sketch(_hashes(lines)))


def _counters(of: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(PLACES[-1]), F.lit(WIDTH)), lambda by: _shifted(of, by))


def _shifted(of: Column, by: Column) -> Column:
    return F.call_function("shiftrightunsigned", of, by).bitwiseAND(F.lit(_MASK))


def combined(a: Column, b: Column, sign: int = 1) -> Column:
    """The fingerprint of both texts' paragraphs, or with ``sign=-1`` of those of ``a`` without ``b``'s."""

    def at(i: Column) -> Column:
        x, y = F.get(a, i), F.get(b, i)
        counters = F.aggregate(
            F.sequence(F.lit(0), F.lit(PLACES[-1]), F.lit(WIDTH)), F.lit(0).cast("long"),
            lambda out, by: out.bitwiseOR(
                F.call_function("shiftleft", (_shifted(x, by) + sign * _shifted(y, by)).bitwiseAND(F.lit(_MASK)), by)
            ),
        )
        return F.when(i < WIDE, (x + sign * y).bitwiseAND(F.lit(0xFFFFFFFF))).otherwise(counters)

    return F.transform(F.sequence(F.lit(0), F.lit(WIDE + SKETCH)), at)


def as_text(print_: Column) -> Column:
    """Hexadecimal digits of the lanes (8 each), the number of shingles and the counters (16 each)."""
    digits = lambda x, i: F.lpad(F.hex(x), F.when(i < WIDE, 8).otherwise(16), F.lit("0"))
    return F.lower(F.array_join(F.transform(print_, digits), ""))


def likeness(a: Column, b: Column) -> Column:
    """From 0 to 1: the estimated cosine of the multisets of shingles; 1 for equal fingerprints.

    A bit that ``c`` of ``n`` hashes have stands for a sum ``2 c - n`` of random signs, and such
    sums of two texts multiply, in the mean, to the product of their multisets.  Sums are known
    modulo 2^21 and taken as those nearest zero, which holds for texts of up to a million shingles,
    and for longer ones unless they repeat a few shingles about as often.
    """

    def signs(print_: Column) -> Column:
        counts = F.flatten(F.transform(F.slice(print_, WIDE + 2, SKETCH), _counters))
        rest = F.transform(counts, lambda c: (2 * c - print_[WIDE]).bitwiseAND(F.lit(_MASK)))
        return F.transform(rest, lambda r: F.when(r > _MASK >> 1, r - (1 << WIDTH)).otherwise(r).cast("double"))

    pairs = F.arrays_zip(signs(a).alias("x"), signs(b).alias("y"))
    sums = F.aggregate(
        pairs, F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0)),
        lambda s, p: F.array(s[0] + p["x"] * p["y"], s[1] + p["x"] * p["x"], s[2] + p["y"] * p["y"]),
        lambda s: F.when((s[1] > 0) & (s[2] > 0), F.greatest(F.lit(0.0), F.least(F.lit(1.0), s[0] / F.sqrt(s[1] * s[2])))).otherwise(0.0),
    )
    return F.when(a == b, F.lit(1.0)).otherwise(sums)


def _interval(key: Column, bounds: list[int]) -> Column:
    """How many of the ascending ``bounds`` are at most ``key``, by binary search."""
    if not bounds:
        return F.lit(0)
    values = F.array(*[F.lit(b).cast("long") for b in bounds])
    steps = F.sequence(F.lit(1), F.lit(len(bounds).bit_length()))
    low_high = F.struct(F.lit(0).alias("low"), F.lit(len(bounds)).alias("high"))

    def halved(range_: Column, _: Column) -> Column:
        middle = F.floor((range_["low"] + range_["high"]) / 2).cast("int")
        above = (range_["low"] < range_["high"]) & (F.get(values, middle) <= key)
        return F.struct(
            F.when(above, middle + 1).otherwise(range_["low"]).alias("low"),
            F.when(above | (range_["low"] >= range_["high"]), range_["high"]).otherwise(middle).alias("high"),
        )

    return F.aggregate(steps, low_high, halved)["low"]


def with_next(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Adds ``next_value``: ``value`` of the row that follows in ascending order of ``key`` (a long;
    nulls first, equal keys by ``value``); after the last comes the first.

    The keys are cut into intervals of about equal numbers of rows.  The first row of an interval
    is also sent to the one before, so each finds its successors alone; the driver holds one key
    for each interval.
    """
    spark = rows.sparkSession
    low = F.coalesce(F.col(key), F.lit(-(2**63)).cast("long"))
    count = 4 * shuffle_partitions(spark)
    shares = [n / count for n in range(1, count)]
    cut = rows.select(F.percentile_approx(low, shares, F.lit(20 * count)).alias("cut")).first()["cut"]
    bounds = sorted(set(cut or []))
    placed = rows.withColumn("_part", _interval(low, bounds))
    firsts = {r["_part"]: r["first"] for r in placed.groupBy("_part").agg(F.min(low).alias("first")).collect()}
    parts = sorted(firsts)
    # For each interval its first key and the interval before it; the first one's is the last.
    before = {p: parts[n - 1] for n, p in enumerate(parts)}
    first_key = F.get(F.array(*[F.lit(firsts.get(p)).cast("long") for p in range(len(bounds) + 1)]), F.col("_part"))
    earlier = F.get(F.array(*[F.lit(before.get(p, 0)) for p in range(len(bounds) + 1)]), F.col("_part"))
    own = F.struct(F.col("_part").alias("part"), F.lit(0).alias("turn"), F.lit(False).alias("guest"))
    # The first row of all comes after the last: its turn is later.
    guest = F.struct(earlier.alias("part"), (earlier >= F.col("_part")).cast("int").alias("turn"), F.lit(True).alias("guest"))
    spread = placed.withColumn("_at", F.explode(F.when(low == first_key, F.array(own, guest)).otherwise(F.array(own))))
    order = Window.partitionBy("_at.part").orderBy("_at.turn", F.col(key).asc_nulls_first(), value)
    return (
        spread.withColumn("next_value", F.lead(value).over(order)).where(~F.col("_at.guest")).drop("_at", "_part")
    )


def edited_documents(docs: DataFrame) -> DataFrame:
    """Fingerprints of ``docs`` (doc_id, text) and of each text edited with the one after it.

    The edited text has the last ``floor(n_chars / 2)`` code points replaced by the first as many
    (or all) of the next document, in ascending order of the ids; after the last comes the first.
    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Null texts count as empty.  Null ids come first; rows with equal ids are ordered by text.  A
    single row is its own next.  An empty table gives no rows.  Other columns are not read.
    """
    text = F.coalesce("text", F.lit(""))
    value = F.struct(text.alias("text"), fingerprint(text).alias("print")).alias("value")
    return _edited(with_next(docs.select(F.col("doc_id").cast("long").alias("doc_id"), value), "doc_id", "value"))


def _edited(rows: DataFrame) -> DataFrame:
    size = F.length("value.text")
    half = F.floor(size / 2).cast("int")
    edited = F.concat(F.substring("value.text", F.lit(1), size - half), F.substring("next_value.text", F.lit(1), half))
    rows = rows.select(
        "doc_id", size.cast("long").alias("n_chars"), F.sha2(edited, 256).alias("edited_sha256"),
        F.col("value.print").alias("print"), fingerprint(edited).alias("edited_print"),
        F.col("next_value.print").alias("next_print"),
    )
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("print")).alias("fingerprint"),
        as_text(F.col("edited_print")).alias("edited_fingerprint"),
        likeness(F.col("print"), F.col("edited_print")).alias("near_edited"),
        likeness(F.col("print"), F.col("next_print")).alias("near_next"),
    )
