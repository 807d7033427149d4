import hashlib

import pytest

from pyspark.sql import functions as F

from tieweave.llm import fingerprints as fp


def edited(texts):
    n = len(texts)
    return [texts[i][: len(texts[i]) - len(texts[i]) // 2] + texts[(i + 1) % n][: len(texts[i]) // 2] for i in range(n)]


def test_edited_texts_against_the_plain_way(docs, rows, clashing):
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    texts = [r[1] or "" for r in ordered]
    wanted = sorted(
        (str(r[0]), len(t), hashlib.sha256(e.encode()).hexdigest()) for r, t, e in zip(ordered, texts, edited(texts))
    )
    for frame in (docs, clashing):
        found = fp.edited_documents(frame).collect()
        assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256) for r in found) == wanted
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in found)


def test_likeness_tells_edited_from_other(docs):
    found = [r for r in fp.edited_documents(docs).collect() if 200 <= r.n_chars <= 5000 and (r.doc_id or 0) < 100]
    assert len(found) > 20
    assert sum(r.near_edited > r.near_next for r in found) > 0.9 * len(found)


def prints(spark, *texts):
    frame = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "n int, text string")
    rows = frame.select("n", fp.as_text(fp.fingerprint(F.col("text"))).alias("p")).orderBy("n").collect()
    return [r.p for r in rows]


def test_equality_is_that_of_paragraphs_in_any_order(spark):
    a, b, c, d, e, f = prints(spark, "one two\nthree\n\nfour", "four\nthree\none two\n", "one two\nthree\nfour", None, "", "one two\nthree\n\nfour ")
    assert a == b and d == e
    assert len({a, c, d, f}) == 4


def test_paragraphs_are_inserted_and_deleted(spark):
    x, y = F.lit("one two three four\nfive"), F.lit("six seven eight\n\nnine")
    both = fp.combined(fp.fingerprint(x), fp.fingerprint(y))
    row = spark.range(1).select(
        fp.as_text(both).alias("both"), fp.as_text(fp.fingerprint(F.lit("nine\nfive\none two three four\nsix seven eight\n"))).alias("whole"),
        fp.as_text(fp.combined(both, fp.fingerprint(y), -1)).alias("less"), fp.as_text(fp.fingerprint(x)).alias("first"),
    ).first()
    assert row.both == row.whole and row.less == row.first


def test_counters_against_plain_counts(spark):
    xxhash = pytest.importorskip("xxhash")
    words = [f"w{n}" for n in range(60)] + ["same"] * 10
    hashes = []
    for n in range(len(words) - 2):
        seed = 42
        for word in words[n : n + 3]:
            seed = xxhash.xxh64_intdigest(word.encode(), seed)
        hashes.append(seed)
    print_ = spark.range(1).select(fp.fingerprint(F.lit(" ".join(words)))).first()[0]
    assert print_[fp.WIDE] == len(hashes)
    for bit in range(63):
        value = print_[fp.WIDE + 1 + bit % 21] >> 21 * (bit // 21) & 0x1FFFFF
        assert value == sum(h >> bit & 1 for h in hashes)
    digest = hashlib.sha512(" ".join(words).encode()).hexdigest()
    assert print_[: fp.WIDE] == [int(digest[8 * n : 8 * n + 8], 16) for n in range(fp.WIDE)]


def test_counters_wrap_alone(spark):
    """2^21 shingles and more: a counter goes round without a carry into the next."""
    hashes = lambda n: F.array_repeat(F.lit(-1).cast("long"), n)
    print_ = spark.range(1).select(F.concat(F.array_repeat(F.lit(0), fp.WIDE), fp._sketch(hashes((1 << 21) + 4)))).first()[0]
    one = spark.range(1).select(F.concat(F.array_repeat(F.lit(0), fp.WIDE), fp._sketch(hashes(4)))).first()[0]
    assert print_[fp.WIDE :] == one[fp.WIDE :]


def test_few_rows(spark, no_docs):
    assert fp.edited_documents(no_docs).collect() == []
    row = fp.edited_documents(spark.createDataFrame([(7, "abcdef")], "doc_id long, text string")).first()
    assert row.edited_sha256 == hashlib.sha256(b"abcabc").hexdigest()


def test_intervals(spark):
    bounds = [3, 5, 5, 9, 12]
    frame = spark.range(0, 15).select("id", fp._interval(F.col("id"), sorted(set(bounds))).alias("n"))
    assert all(r.n == sum(b <= r.id for b in {3, 5, 9, 12}) for r in frame.collect())
