"""Quality scores by a sparse ensemble of rules over text statistics."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tieweave.llm.common import pmod_of_id, slices
from tieweave.session import materialize

#: Statistics of a whole text.  Shares are of bytes, words or lines as their names say.
STATISTICS = (
    "bytes", "words", "lines", "word_length", "line_words", "upper_bytes", "digit_bytes", "letter_bytes", "foreign_bytes",
    "stop_bytes", "mark_bytes", "bang_bytes", "pipe_bytes", "quote_bytes", "slash_bytes", "bracket_bytes", "distinct_words",
    "top_word", "repeated_words", "distinct_lines", "long_words", "short_words", "marked_words", "ended_lines",
)
#: Labelled rows that trees and weights are fitted on, about, chosen by a hash of their id.
TRAINING_ROWS = 20_000
TREES, DEPTH = 24, 3
#: Strength of the lasso.
PENALTY = 0.001
THRESHOLD = 0.3

_GROUPS = {
    "upper_bytes": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit_bytes": b"0123456789", "stop_bytes": b".,;:?", "mark_bytes": b"#$%&*@^~+=_",
    "bang_bytes": b"!", "pipe_bytes": b"|", "quote_bytes": b"\"'`", "slash_bytes": b"/\\", "bracket_bytes": b"()[]{}<>",
}


def statistics(text: str | None) -> list[float]:
    """The values of ``STATISTICS``, in that order; all 0 for a null or empty text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    if not raw:
        return [0.0] * len(STATISTICS)
    counts = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    words = raw.split()
    lines = [line for line in raw.split(b"\n") if line.strip()]
    n, w, size = len(words), Counter(words), len(raw)
    out = {name: counts[list(group)].sum() / size for name, group in _GROUPS.items()}
    per_word = 1 / n if n else 0.0
    per_line = 1 / len(lines) if lines else 0.0
    out |= {
        "bytes": size, "words": n, "lines": len(lines), "word_length": sum(map(len, words)) * per_word,
        "line_words": n * per_line, "letter_bytes": (counts[65:91].sum() + counts[97:123].sum()) / size,
        "foreign_bytes": counts[128:].sum() / size, "distinct_words": len(w) * per_word,
        "top_word": max(w.values(), default=0) * per_word,
        "repeated_words": sum(a == b for a, b in zip(words, words[1:])) * per_word,
        "distinct_lines": len(set(lines)) * per_line, "long_words": sum(len(x) > 14 for x in words) * per_word,
        "short_words": sum(len(x) < 3 for x in words) * per_word,
        "marked_words": sum(x[-1] in b"#$%&*!|" for x in words) * per_word,
        "ended_lines": sum(line.rstrip()[-1:] in (b".", b"!", b"?") for line in lines) * per_line,
    }
    return [float(out[name]) for name in STATISTICS]


def with_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, and a column for each statistic) of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                rows = np.array([statistics(t) for t in part.column("text").to_pylist()]).reshape(-1, len(STATISTICS))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *[pa.array(rows[:, n]) for n in range(len(STATISTICS))]],
                    names=["doc_id", *STATISTICS],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, " + ", ".join(f"{s} double" for s in STATISTICS))


#: A rule: for each statistic in it, the open lower and closed upper bound.
Rule = tuple[tuple[str, float, float], ...]


def condition(rule: Rule) -> Column:
    out = F.lit(True)
    for name, low, high in rule:
        if low > -np.inf:
            out = out & (F.col(name) > low)
        if high < np.inf:
            out = out & (F.col(name) <= high)
    return out


def paths(tree) -> set[Rule]:
    """The conjunctions on the ways from the root to each node below it."""
    found: set[Rule] = set()

    def walk(node, bounds: dict[str, tuple[float, float]]) -> None:
        if bounds:
            found.add(tuple((name, *bounds[name]) for name in sorted(bounds)))
        if node.getClass().getSimpleName() != "InternalNode":
            return
        name, cut = STATISTICS[node.split().featureIndex()], node.split().threshold()
        low, high = bounds.get(name, (-np.inf, np.inf))
        walk(node.leftChild(), bounds | {name: (low, min(high, cut))})
        walk(node.rightChild(), bounds | {name: (max(low, cut), high)})

    walk(tree._call_java("rootNode"), {})
    return found


@dataclass
class RuleEnsemble:
    """Rules with their weights; what the lasso set to zero is not kept."""

    rules: list[tuple[Rule, float]] = field(default_factory=list)
    intercept: float = 0.0

    def score(self) -> Column:
        """The probability of label 1, as an expression over the columns of statistics."""
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            total = total + F.when(condition(rule), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def fit(rows: DataFrame, most: int = TRAINING_ROWS) -> RuleEnsemble:
    """Fits on about ``most`` of ``rows`` (doc_id, statistics, label 0 or 1).

    A forest of shallow trees finds the rules, a lasso logistic regression over which of them hold
    weighs them.  With labels of one kind only, or none, there are no rules, and the score of all
    is the label's share (0.5 without any).
    """
    kinds = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    total = sum(kinds.values())
    if not kinds.get(0) or not kinds.get(1):
        share = min(max(kinds.get(1, 0) / total, 1e-6), 1 - 1e-6) if total else 0.5
        return RuleEnsemble([], float(np.log(share / (1 - share))))
    chosen = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < min(1.0, most / total) * (1 << 20)
    rows = materialize(rows.where(chosen).select("label", *STATISTICS), "training")
    vectors = VectorAssembler(inputCols=list(STATISTICS), outputCol="_vector").transform(rows)
    vectors = vectors.withColumn("label", F.col("label").cast("double"))
    forest = RandomForestClassifier(
        featuresCol="_vector", labelCol="label", numTrees=TREES, maxDepth=DEPTH, featureSubsetStrategy="0.5",
        minInstancesPerNode=5, seed=7,
    ).fit(vectors.select("_vector", "label"))
    rules = sorted(set().union(*map(paths, forest.trees)))
    if not rules:
        share = kinds[1] / total
        return RuleEnsemble([], float(np.log(share / (1 - share))))
    holds = F.array(*[condition(rule).cast("double") for rule in rules])
    binary = materialize(rows.select(F.col("label").cast("double").alias("label"), holds.alias("holds")), "rules")
    lasso = LogisticRegression(featuresCol="_holds", labelCol="label", regParam=PENALTY, elasticNetParam=1.0, maxIter=60)
    model = lasso.fit(binary.select("label", array_to_vector("holds").alias("_holds")))
    weights = model.coefficients.toArray()
    return RuleEnsemble([(r, float(w)) for r, w in zip(rules, weights) if w != 0], float(model.intercept))


def scored(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Scores every one of ``docs`` (doc_id, text): doc_id, held_out, score, predicted, rules.

    Learns from ``labels`` (doc_id, quality 0 or 1) of rows whose crc32(doc_id) mod 5 is not 0; the
    id serves that split only.  The statistics are of the whole text; the rules are Spark columns
    over them.  ``rules`` is how many the ensemble has.

    Null and empty texts have statistics of 0 and a score like others.  Null ids are scored, not
    held out, and not learned from.  Labels that repeat an id count once, the highest; null ones
    not.  Rows that repeat are scored alike.  An empty table gives no rows.
    """
    rows = materialize(with_statistics(docs), "statistics")
    known = labels.where(F.col("quality").isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max("quality").alias("label")
    )
    taught = rows.where(pmod_of_id(5) != 0).join(known, "doc_id")
    model = fit(taught)
    score = model.score()
    judged = rows.select("doc_id", F.coalesce(pmod_of_id(5) == 0, F.lit(False)).alias("held_out"), score.alias("score"))
    return judged.select(
        "*", (F.col("score") >= threshold).cast("int").alias("predicted"), F.lit(len(model.rules)).alias("rules")
    )
