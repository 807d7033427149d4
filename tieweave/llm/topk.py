"""Exact top-k search by inner product: distributed histogram selection."""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tieweave.session import materialize

#: Queries in a block, and vectors scored with it at a time: a task holds their product.
BLOCK = 2048
CHUNK = 1024
#: Intervals of a score histogram.
BINS = 256
_LONG = np.iinfo(np.int64)


def integer_vectors(rows: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, v): each component x as floor(1024 x), computed as double.

    Vectors that are null or hold a null or non-finite component are left out.
    """
    x = F.col(vector).cast("array<double>")
    return rows.select(F.col(key).cast("long").alias("vec_id"), x.alias("x")).where(F.col("x").isNotNull()).where(
        F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    ).select("vec_id", F.transform("x", lambda c: F.floor(c * F.lit(1024.0))).cast("array<long>").alias("v"))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of ``a`` and ``b`` (whole numbers), held to 64 bits."""
    dim = a.shape[1]
    most = float(np.abs(a.astype(np.float64)).max(initial=0)) * float(np.abs(b.astype(np.float64)).max(initial=0)) * dim
    if most < 2.0**53:  # every partial sum is a whole number that a double holds
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most < 2.0**62:
        return a @ b.T
    exact = a.astype(object) @ b.astype(object).T
    return np.clip(exact, _LONG.min, _LONG.max).astype(np.int64)


class Block:
    """Query vectors of one block by dimension; ``ids`` in ascending order."""

    def __init__(self, ids: list[int], vectors: list[list[int]]) -> None:
        self.ids = np.array(ids, dtype=np.int64)
        self.by_dim: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        dims = np.array([len(v) for v in vectors])
        for dim in np.unique(dims):
            at = np.flatnonzero(dims == dim)
            self.by_dim[int(dim)] = at, np.array([vectors[i] for i in at], dtype=np.int64).reshape(len(at), dim)

    def scored(self, batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(queries' places, vec_ids, scores, which of them count) for parts of the batch."""
        ids = batch.column("vec_id").to_numpy(zero_copy_only=False)
        lists = batch.column("v")
        offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy()
        dims = np.diff(offsets)
        for dim, (places, queries) in self.by_dim.items():
            rows = np.flatnonzero(dims == dim)
            for begin in range(0, len(rows), CHUNK):
                some = rows[begin : begin + CHUNK]
                vectors = values[offsets[some][:, None] + np.arange(dim)].reshape(len(some), dim)
                scores = products(queries, vectors)
                yield places, ids[some], scores, self.ids[places][:, None] != ids[some][None, :]


def _histograms(vectors: DataFrame, block, low: np.ndarray, width: np.ndarray) -> DataFrame:
    """(place, bin, n): scores of each query in ``BINS`` intervals from its ``low``; the last one
    also holds all above.  Counted in each task before they are summed."""
    shipped = vectors.sparkSession.sparkContext.broadcast((block, low, width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, low, width = shipped.value
        counts = np.zeros((len(block.ids), BINS), dtype=np.int64)
        for batch in batches:
            for places, _, scores, counted in block.scored(batch):
                above = scores >= low[places][:, None]
                # Unsigned, as a difference of two longs may need 64 bits.
                gap = scores.view(np.uint64) - low[places].view(np.uint64)[:, None]
                bins = np.minimum(gap // width[places][:, None], np.uint64(BINS - 1)).astype(np.int64)
                flat = (bins + places[:, None] * BINS)[above & counted]
                counts += np.bincount(flat, minlength=counts.size).reshape(counts.shape)
        place, at = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(place.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(counts[place, at])],
            names=["place", "bin", "n"],
        )

    return vectors.mapInArrow(run, "place int, bin int, n long").groupBy("place", "bin").agg(F.sum("n").alias("n"))


def _kth_scores(vectors: DataFrame, block: Block, k: int) -> np.ndarray:
    """The k-th highest score of each query, or the lowest long if it has fewer candidates.

    Each pass counts the scores of an interval in equal parts, over all rows, and goes on with the
    part that holds the k-th one, until parts are one score wide.
    """
    shipped = vectors.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shipped.value
        least = np.full(len(block.ids), _LONG.max)
        most = np.full(len(block.ids), _LONG.min)
        for batch in batches:
            for places, _, scores, counted in block.scored(batch):
                least[places] = np.minimum(least[places], np.where(counted, scores, _LONG.max).min(axis=1))
                most[places] = np.maximum(most[places], np.where(counted, scores, _LONG.min).max(axis=1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(least), dtype=np.int32)), pa.array(least), pa.array(most)], names=["place", "least", "most"]
        )

    size = len(block.ids)
    low, high = np.full(size, 0, np.int64), np.full(size, 0, np.int64)
    ranges = vectors.mapInArrow(run, "place int, least long, most long")
    for place, least, most in ranges.groupBy("place").agg(F.min("least"), F.max("most")).collect():
        low[place], high[place] = (least, most) if least <= most else (0, 0)
    span = high.view(np.uint64) - low.view(np.uint64)
    width = span // np.uint64(BINS) + np.uint64(1)
    found, answer = np.zeros(size, bool), np.full(size, _LONG.min)
    while not found.all():
        by_bin = Window.partitionBy("place").orderBy(F.col("bin").desc())
        reached = _histograms(vectors, block, low, width).withColumn("upto", F.sum("n").over(by_bin)).where(F.col("upto") >= k)
        rows = reached.groupBy("place").agg(F.max("bin")).collect()
        enough = np.zeros(size, bool)
        for place, at in rows:
            enough[place] = True
            if not found[place]:
                low.view(np.uint64)[place : place + 1] += np.uint64(at) * width[place]
        found |= ~enough
        done = enough & ~found & (width == 1)
        answer[done] = low[done]
        found |= done
        width = np.where(found, width, (width - np.uint64(1)) // np.uint64(BINS) + np.uint64(1))
    return answer


def _survivors(vectors: DataFrame, block: Block, kth: np.ndarray, k: int) -> DataFrame:
    """Rows (query_id, vec_id, score) that score above the k-th score, and those that equal it: of the
    latter each batch gives its k smallest ids, which hold the smallest of all."""
    shipped = vectors.sparkSession.sparkContext.broadcast((block, kth))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, kth = shipped.value
        for batch in batches:
            for places, ids, scores, counted in block.scored(batch):
                limit = kth[places][:, None]
                q, c = np.nonzero((scores > limit) & counted)
                tied = np.nonzero((scores == limit) & counted)
                order = np.lexsort((ids[tied[1]], tied[0]))
                tq, tc = tied[0][order], tied[1][order]
                nth = np.arange(len(tq)) - np.searchsorted(tq, tq)
                q, c = np.concatenate([q, tq[nth < k]]), np.concatenate([c, tc[nth < k]])
                if q.size:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(block.ids[places[q]]), pa.array(ids[c]), pa.array(scores[q, c])],
                        names=["query_id", "vec_id", "score"],
                    )

    return vectors.mapInArrow(run, "query_id long, vec_id long, score long")


def search(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` highest inner products of each of ``queries`` with ``vectors`` (vec_id, v: array<long>).

    Returns query_id, rank, vec_id, score; ties go to the smaller vec_id; a query's own id is no
    candidate of its own.  Queries are taken in blocks of about 2048 by a hash of their id; each
    block is sent to all tasks (2048 vectors at most some times over, whatever the table's size)
    and meets every row: once for the range of scores, then for each histogram, then once to put
    out the rows at or above the k-th score.

    Only vectors of the query's dimension are candidates.  Rows that repeat an id are candidates
    each for itself; of query rows with one id the smallest vector is the query.  Null ids are
    left out.  Products beyond 64 bits are held to the ends of the range.  An empty table gives no
    rows.
    """
    if k < 1:
        raise ValueError("k must be positive")
    vectors = vectors.where(F.col("vec_id").isNotNull())
    asked = materialize(
        queries.where(F.col("vec_id").isNotNull()).groupBy("vec_id").agg(F.min("v").alias("v")), "queries"
    )
    blocks = -(-asked.count() // BLOCK)
    results: DataFrame | None = None
    for n in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == n).orderBy("vec_id").collect()
        if not rows:
            continue
        block = Block([r["vec_id"] for r in rows], [r["v"] for r in rows])
        kth = _kth_scores(vectors, block, k)
        found = _survivors(vectors, block, kth, k)
        ranks = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
        best = found.withColumn("rank", F.row_number().over(ranks)).where(F.col("rank") <= k)
        best = materialize(best.select("query_id", "rank", "vec_id", "score"), "best")
        results = best if results is None else results.union(best)
    if results is None:
        results = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return results
