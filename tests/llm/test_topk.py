import math

import numpy as np
import pytest

from tieweave.llm import topk

SCHEMA = "vec_id long, embedding array<float>"


def plain(rows, queries, k):
    usable = [
        (i, [math.floor(float(np.float32(x)) * 1024) for x in v])
        for i, v in rows
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for q in sorted({i for i, _ in usable if queries(i)}):
        own = min(v for i, v in usable if i == q)
        found = [(-sum(a * b for a, b in zip(own, v)), i) for i, v in usable if i != q and len(v) == len(own)]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(sorted(found)[:k])]
    return sorted(out)


def searched(spark, rows, queries, k=10):
    vectors = topk.integer_vectors(spark.createDataFrame(rows, SCHEMA).repartition(4))
    found = topk.search(vectors, vectors.where(queries), k)
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in found.collect())


def odd_vectors():
    rng = np.random.default_rng(4)
    rows = [(n, [float(x) for x in rng.normal(size=6)]) for n in range(300)]
    rows += [(400 + n, rows[17][1]) for n in range(80)]  # one vector many times
    rows += [(17, rows[17][1]), (100, [9.0] * 6)]  # ids again
    rows += [
        (500, None), (501, [1.0, None, 2.0, 0.0, 0.0, 0.0]), (502, [float("nan")] * 6), (503, [float("inf")] + [0.0] * 5),
        (None, [1.0] * 6), (504, []), (600, []), (505, [1.0, 2.0]), (700, [3.0, 4.0]), (506, [-1.0, 0.5]),
    ]
    return rows


@pytest.mark.parametrize("k", [1, 10, 500])
def test_search_against_brute_force(spark, k):
    rows = odd_vectors()
    assert searched(spark, rows, "vec_id % 100 = 0 OR vec_id = 17", k) == plain(rows, lambda i: i % 100 == 0 or i == 17, k)


def test_search_in_several_blocks_with_narrow_histograms(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 4)
    monkeypatch.setattr(topk, "BINS", 3)
    monkeypatch.setattr(topk, "CHUNK", 7)
    rows = odd_vectors()
    assert searched(spark, rows, "vec_id % 20 = 0", 5) == plain(rows, lambda i: i % 20 == 0, 5)


def test_huge_components_are_exact_or_held(spark):
    rows = [(0, [1e6, -1e6]), (1, [2.5e6, 1e6]), (2, [-3e6, 7e5]), (3, [1e30, 0.0]), (4, [-1e30, 0.0])]
    found = {(r[0], r[2]): r[3] for r in searched(spark, rows, "vec_id <= 1")}
    assert found[0, 1] == math.floor(1e6 * 1024) * (2560000000 - 1024000000)
    assert found[0, 3] == 2**63 - 1 and found[0, 4] == -(2**63)


def test_no_vectors(spark):
    assert searched(spark, [], "vec_id % 100 = 0") == []
    assert searched(spark, [(100, [1.0])], "vec_id % 100 = 0") == []


def test_extra_columns_do_no_harm(spark):
    from pyspark.sql import functions as F

    rows = [(n, [float(n), 1.0]) for n in range(20)]
    frame = spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit(1).alias(c) for c in ("v", "x", "score", "rank", "place")])
    vectors = topk.integer_vectors(frame)
    assert topk.search(vectors, vectors.where("vec_id = 0"), 3).count() == 3
