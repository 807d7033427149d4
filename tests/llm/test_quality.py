import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from .conftest import LANGUAGES, invented
from tieweave.llm import quality


def labelled(spark, n=600):
    rng = random.Random(3)
    rows, labels = [], []
    for doc_id in range(n):
        text = invented(rng, rng.randint(10, 80), LANGUAGES["aa"])
        good = rng.random() < 0.8
        if not good:
            text = text.upper().replace(" ", "!! ") if doc_id % 2 else " ".join([text.split()[0]] * 40)
        rows.append((doc_id, text))
        labels.append((doc_id, int(good), 0))
    return (
        spark.createDataFrame(rows, "doc_id long, text string"),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
        {i: q for i, q, _ in labels},
    )


def test_held_out_accuracy(spark):
    docs, labels, truth = labelled(spark)
    found = quality.scored(docs, labels).collect()
    held = [r for r in found if r.held_out]
    assert len(found) == 600 and 80 < len(held) < 160
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) and 0 < r.rules < 300 for r in found)


def test_score_is_that_of_the_rules(spark):
    docs, labels, _ = labelled(spark, 300)
    rows = quality.with_statistics(docs)
    model = quality.fit(rows.join(labels.select("doc_id", F.col("quality").alias("label")), "doc_id"))
    assert model.rules
    for r in rows.select("*", model.score().alias("score")).collect():
        total = model.intercept + sum(
            w for rule, w in model.rules if all(low < r[name] <= high for name, low, high in rule)
        )
        assert r.score == pytest.approx(1 / (1 + np.exp(-total)), rel=1e-9)


def test_statistics():
    values = dict(zip(quality.STATISTICS, quality.statistics("The cat! the\ncat 12 the\n\nthe")))
    assert (values["words"], values["lines"], values["distinct_words"], values["top_word"]) == pytest.approx((7, 3, 5 / 7, 3 / 7))
    assert (values["digit_bytes"], values["upper_bytes"]) == pytest.approx((2 / 28, 1 / 28))
    assert quality.statistics(None) == quality.statistics("") == [0.0] * len(quality.STATISTICS)
    assert all(np.isfinite(quality.statistics(t)).all() for t in (" \n ", "a", "\x00", "日本", "a" * 100_000))


def test_odd_rows(spark, docs, rows, no_docs, clashing):
    labels = spark.createDataFrame(
        [(n, n % 2, 0) for n in range(40)] + [(3, 0, 0), (None, 1, 0), (5, None, 0), (9999, 1, 1), (6, 7, 0)],
        "doc_id long, quality int, toxic int",
    )
    found = quality.scored(clashing, labels.withColumn("score", F.lit(1))).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 for r in found)
    assert not any(r.held_out for r in found if r.doc_id is None)
    assert quality.scored(no_docs, labels).collect() == []
    for value, score in ((1, 1), (0, 0)):
        ones = labels.withColumn("quality", F.lit(value))
        assert {round(r.score) for r in quality.scored(docs, ones).collect()} == {score}
    assert {r.score for r in quality.scored(docs, labels.limit(0)).collect()} == {0.5}
