"""Sum-of-squares packing of token sequences into windows of a fixed number of tokens."""

from __future__ import annotations

import zlib
from collections import defaultdict
from functools import reduce
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tieweave.llm.common import slices, shuffle_partitions
from tieweave.llm.encoder import definition, encoder_of
from tieweave.session import materialize

#: Open windows whose pieces a packer holds at most.  Of others it keeps a number each; their pieces go out
#: as pending rows, and what is still open at the end is settled in a second step.
HELD_WINDOWS = 4096

PIECES = pa.schema(
    [
        ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
        ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary()),
    ]
)
ROWS = PIECES.append(pa.field("pending", pa.bool_()))
KINDS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def as_batch(found: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), schema)], schema=schema)


class Packer:
    """Online packing that keeps the squares of the numbers of equally full windows small.

    ``counts[h]`` is the number of open windows with ``h`` tokens.  A piece of ``s`` tokens goes
    to the level ``h`` (0: a new window) with the least sum of ``counts ** 2`` afterwards, which
    keeps windows of many fill levels at hand, so that most later pieces find an exact fit.
    """

    def __init__(self, capacity: int, first_sequence: int = 0, most_held: int = HELD_WINDOWS) -> None:
        self.capacity, self.most_held = capacity, most_held
        self.counts = np.zeros(capacity + 1, dtype=np.int64)
        #: By level: pieces of each held window, or the sequence of one whose pieces went out.
        self.windows: dict[int, list[list[tuple] | int]] = defaultdict(list)
        self.sequence = first_sequence
        self.held = 0

    def best_level(self, size: int) -> int:
        levels = self.counts[: self.capacity - size + 1]
        after = self.counts[size:]
        change = 2 * after + 2 - 2 * levels  # one window moves from level h to level h + size
        change[0] += 2 * levels[0] - 1  # nothing leaves level 0
        change[-1] -= 2 * after[-1] + 1  # a full window is no longer counted
        usable = levels > 0
        usable[0] = True
        best = np.where(usable, change, np.iinfo(np.int64).max)
        return int(best.size - 1 - np.argmin(best[::-1]))  # of equals, the fullest

    def emit(self, pieces: list[tuple], pending: bool = False) -> list[tuple]:
        """``pieces``: (doc_id, start, ids, doc_tokens); rows of the next sequence."""
        out, offset = [], 0
        for piece in pieces:
            out.append(row(piece, self.sequence, offset, pending))
            offset += len(piece[2]) // 4
        self.sequence += 1
        return out

    def add(self, doc_id: int | None, ids: bytes) -> list[tuple]:
        """Places one document; returns rows of windows that are full, or no longer held."""
        total, out, start = len(ids) // 4, [], 0
        while total - start >= self.capacity:
            out += self.emit([(doc_id, start, ids[4 * start : 4 * (start + self.capacity)], total)])
            start += self.capacity
        size = total - start
        if not size:
            return out
        piece = (doc_id, start, ids[4 * start :], total)
        level = self.best_level(size)
        window = self.windows[level].pop() if level else []
        full = level + size == self.capacity
        if level:
            self.counts[level] -= 1
        if isinstance(window, int):
            out.append(row(piece, window, level, True))
        else:
            window.append(piece)
            self.held += (not full) - (level > 0)
            if full:
                out += self.emit(window)
        if not full:
            self.windows[level + size].append(window)
            self.counts[level + size] += 1
        if self.held > self.most_held:
            out += self.let_go()
        return out

    def let_go(self) -> list[tuple]:
        """Puts out the pieces of half of the held windows of each level, those that would be filled last."""
        out = []
        for level in sorted(self.windows):
            held = [n for n, window in enumerate(self.windows[level]) if not isinstance(window, int)]
            for n in held[: -(-len(held) // 2)]:
                out += self.emit(self.windows[level][n], pending=True)
                self.windows[level][n] = self.sequence - 1
                self.held -= 1
        return out

    def close(self) -> list[tuple]:
        """Empties the held windows into each other (``Cutter``), fullest first."""
        held = (w for level in sorted(self.windows, reverse=True) for w in self.windows[level] if not isinstance(w, int))
        cutter = Cutter(self)
        out = [found for window in held for piece in window for found in cutter.add(piece)]
        self.windows.clear()
        self.counts[:] = self.held = 0
        return out + cutter.close()


def row(piece: tuple, sequence: int, offset: int, pending: bool) -> tuple:
    doc_id, start, ids, total = piece
    return (doc_id, start, len(ids) // 4, zlib.crc32(ids), total, sequence, offset, ids, pending)


class Cutter:
    """Fills one window after the other, cutting pieces where it is full.

    What is left at the end becomes windows of falling powers of two, which need no padding.
    """

    def __init__(self, packer: Packer) -> None:
        self.packer = packer
        self.window: list[tuple] = []
        self.room = packer.capacity

    def add(self, piece: tuple) -> list[tuple]:
        doc_id, start, ids, total = piece
        out: list[tuple] = []
        while ids:
            take = min(self.room, len(ids) // 4)
            self.window.append((doc_id, start, ids[: 4 * take], total))
            ids, start, self.room = ids[4 * take :], start + take, self.room - take
            if not self.room:
                out += self.packer.emit(self.window)
                self.window, self.room = [], self.packer.capacity
        return out

    def close(self) -> list[tuple]:
        rest, left, out = self.window, self.packer.capacity - self.room, []
        self.window = []
        while left:
            self.room = 1 << (left.bit_length() - 1)
            left -= self.room
            while self.room:
                doc_id, start, ids, total = rest.pop(0)
                take = min(self.room, len(ids) // 4)
                self.window.append((doc_id, start, ids[: 4 * take], total))
                self.room -= take
                if 4 * take < len(ids):
                    rest.insert(0, (doc_id, start + take, ids[4 * take :], total))
            out += self.packer.emit(self.window)
            self.window = []
        self.room = self.packer.capacity
        return out


def pack(
    docs: DataFrame, vocabulary: str, capacity: int = 1024, end_id: int = 0, with_ids: bool = True,
    slice_bytes: int = 8 << 20, kept_parts: int | None = None,
) -> DataFrame:
    """Packs the token ids of ``docs`` (doc_id, text) into sequences of at most ``capacity`` tokens.

    Each document's ids end with ``end_id``.  Documents are dealt to packers by a hash of id and
    text and come to them in the order of both, so a task that runs again gives the same rows.
    Whole windows are cut from a document first; what remains is placed by ``Packer``, however many windows
    are open.  A packer holds the pieces of at most ``HELD_WINDOWS`` of them and never its documents; windows
    that it let go and that are open at the end are cut into full ones in a second step.

    Null text counts as empty: the end id alone.  A null id stays null.  Repeated rows and ids
    are packed each for itself.  An empty table gives no rows.  Other columns are not read.

    ``slice_bytes`` of text are encoded at once and about twice ``kept_parts`` parts of texts remembered
    (None: the encoder's ``KEPT_PARTS``): fewer take a task less memory and more time; the rows are the same.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    spark = docs.sparkSession
    shipped = spark.sparkContext.broadcast(definition(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = encoder_of(shipped, kept_parts)
        packer = Packer(capacity, TaskContext.get().partitionId() << 40, HELD_WINDOWS)

        def out(found: list[tuple]) -> pa.RecordBatch:
            if not with_ids:  # but for those that may be cut again
                found = [f if f[8] else (*f[:7], None, f[8]) for f in found]
            return as_batch(found, ROWS)

        for batch in batches:
            for part in slices(batch, "text", slice_bytes):
                found: list[tuple] = []
                encoded = codec.encode(part.column("text").to_pylist(), end_id)
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), encoded):
                    found += packer.add(doc_id, ids)
                if found:
                    yield out(found)
        if found := packer.close():
            yield out(found)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Cutter(Packer(capacity, 1 << 62 | TaskContext.get().partitionId() << 40))
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("doc_id", "start", "ids", "doc_tokens")]
            found = [each for piece in zip(*columns) for each in cutter.add(piece)]
            if found:
                yield as_batch([f[:8] for f in found], PIECES)
        if found := cutter.close():
            yield as_batch([f[:8] for f in found], PIECES)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    dealt = rows.repartition(shuffle_partitions(spark), "doc_id", "text").sortWithinPartitions("doc_id", "text")
    # Beside the shuffled texts the largest of what stands on disk.
    placed = materialize(dealt.mapInArrow(run, KINDS + ", pending boolean"), "placed", compression="zstd")
    filled = F.sum("length").over(Window.partitionBy("sequence_id"))
    pending = placed.where("pending").withColumn("filled", filled)
    open_ = pending.where(F.col("filled") < capacity).repartition(shuffle_partitions(spark), "sequence_id")
    settled = open_.sortWithinPartitions(F.desc("filled"), "sequence_id", "offset").mapInArrow(cut, KINDS)
    names = [n for n in PIECES.names if with_ids or n != "ids"]
    whole = [placed.where("NOT pending"), pending.where(F.col("filled") == capacity), settled]
    return reduce(DataFrame.union, [frame.select(*names) for frame in whole])
