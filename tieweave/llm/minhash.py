"""Near-duplicates by MinHash with tensored banding, confirmed on full sets of shingles."""

from __future__ import annotations

import hashlib
from itertools import combinations
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tieweave.llm.common import shuffle_partitions, slices
from tieweave.llm.components import components
from tieweave.session import materialize

#: Collections of minhashes and minhashes in each; a table's key joins two collections, so 48 minhashes give 120
#: tables of six.  Sets of similarity 0.85 agree in fewer than two collections once in 150 000 pairs.
COLLECTIONS, WIDTH = 16, 3
#: Bits of the parity sketch that bounds a difference from below.
SKETCH = 1024
#: Rows of either side of a block at most.
BLOCK = 256
TABLES = np.array(list(combinations(range(COLLECTIONS), 2)), dtype=np.int64)
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def mixed(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers in which every bit depends on all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def constants(n: int, seed: int) -> np.ndarray:
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


FLIPS, FACTORS = constants(COLLECTIONS * WIDTH, 1), constants(COLLECTIONS * WIDTH, 2) | np.uint64(1)
TABLE_SALT = constants(len(TABLES), 3)


class WordHashes(dict):
    """XXH64 of words, kept while there are not too many."""

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        if len(self) >= 1 << 18:
            self.clear()
        value = self[word] = xxh64_intdigest(word)
        return value


def shingle_set(text: str | None, words: int, known: WordHashes) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of the words, A-Z in lower case.

    Fewer words than a shingle has are one shingle, which meets no longer one; no words are none.
    """
    found = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not found:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
    width = min(words, len(found))
    total = np.full(len(found) - width + 1, width, np.uint64)
    for at in range(width):
        total = mixed(total + hashes[at : at + len(total)])
    return np.unique(total)


def collections(shingles: np.ndarray) -> np.ndarray:
    """One number for each collection: its minhashes of the set."""
    least = np.full(COLLECTIONS * WIDTH, np.iinfo(np.uint64).max, np.uint64)
    for begin in range(0, len(shingles), 4096):
        values = (shingles[begin : begin + 4096, None] ^ FLIPS) * FACTORS
        least = np.minimum(least, (values ^ (values >> np.uint64(32))).min(axis=0))
    joined = np.zeros(COLLECTIONS, np.uint64)
    for at in range(WIDTH):
        joined = mixed(joined + least[at::WIDTH])
    return joined


def sketch(shingles: np.ndarray) -> bytes:
    """Whether each of ``SKETCH`` cells holds an odd number of shingles."""
    cells = np.bincount((shingles >> np.uint64(54)).astype(np.int64), minlength=SKETCH)
    return np.packbits((cells & 1).astype(bool)).tobytes()


def table_keys(numbers: np.ndarray) -> np.ndarray:
    """Keys of all tables for rows of collection numbers: tensoring pairs the collections."""
    return mixed(mixed(numbers[:, TABLES[:, 0]] + TABLE_SALT) + numbers[:, TABLES[:, 1]])


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, n, print, numbers, bits) of each row of ``docs`` (doc_id, text); ``print`` is an md5 of the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                sizes, prints, numbers, bits = [], [], [], []
                for text in part.column("text").to_pylist():
                    found = shingle_set(text, words, known)
                    sizes.append(len(found))
                    prints.append(hashlib.md5(found.tobytes()).digest())
                    numbers.append(collections(found).tobytes() if len(found) else b"")
                    bits.append(sketch(found) if len(found) else b"")
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(sizes, pa.int64()), *[pa.array(c, pa.binary()) for c in (prints, numbers, bits)]],
                    names=["doc_id", "n", "print", "numbers", "bits"],
                )

    return docs.mapInArrow(run, "doc_id long, n long, print binary, numbers binary, bits binary")


def keyed(nodes: DataFrame) -> DataFrame:
    """(key, node): a row for each table of each node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 1024):
                part = batch.slice(begin, 1024)
                rows = np.frombuffer(b"".join(part.column("numbers").to_pylist()), "<u8").reshape(-1, COLLECTIONS)
                nodes = np.repeat(part.column("node").to_numpy(), len(TABLES))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(table_keys(rows).reshape(-1).view(np.int64)), pa.array(nodes)], names=["key", "node"]
                )

    return nodes.select("node", "numbers").mapInArrow(run, "key long, node long")


def pairs_with_leaders(members: DataFrame) -> DataFrame:
    """(a, b, degree): each node b with the leaders a of its buckets, from ``members`` (key, node, all).

    The leader of a bucket is its node that meets most others, in all buckets together: an original agrees
    with its copies more often than these with each other.
    """
    degrees = materialize(members.groupBy("node").agg(F.sum("all").alias("degree")), "degrees")
    leaders = members.join(degrees, "node").groupBy("key").agg(F.max(F.struct("degree", "node")).alias("lead"))
    pairs = members.select("key", "node").join(leaders, "key").where(F.col("lead.node") != F.col("node"))
    return materialize(
        pairs.select(F.col("lead.node").alias("a"), F.col("node").alias("b"), F.col("lead.degree").alias("degree")).distinct(), "pairs"
    )


def may_link(a_n: np.ndarray, b_n: np.ndarray, apart: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of these sizes that differ in ``apart`` shingles at least can reach ``percent``."""
    return (100 * np.minimum(a_n, b_n) >= percent * np.maximum(a_n, b_n)) & ((100 + percent) * apart <= (100 - percent) * (a_n + b_n))


def near_pairs(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sizes and sketches allow a link; none that is one is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u8").reshape(batch.num_rows, -1) for c in ("a_bits", "b_bits"))
            apart = np.bitwise_count(left ^ right).sum(axis=1, dtype=np.int64)
            kept = may_link(batch.column("a_n").to_numpy(), batch.column("b_n").to_numpy(), apart, percent)
            yield batch.select(["a", "b"]).filter(pa.array(kept))

    side = lambda end: nodes.select(
        F.col("node").alias(end), F.col("n").alias(f"{end}_n"), F.col("bits").alias(f"{end}_bits")
    )
    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(run, "a long, b long")


def full_sets(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(node, shingles) of the ``wanted`` (node): the set of one of each node's documents, read again."""
    chosen = nodes.join(wanted.distinct(), "node", "left_semi").select("node", "first_id", "print")
    ids = chosen.select(F.col("first_id").alias("of")).distinct()
    texts = docs.join(ids, docs["doc_id"].eqNullSafe(ids["of"]), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                sets = [shingle_set(text, words, known).tobytes() for text in part.column("text").to_pylist()]
                prints = [hashlib.md5(found).digest() for found in sets]
                yield pa.RecordBatch.from_arrays([pa.array(prints, pa.binary()), pa.array(sets, pa.binary())], names=["print", "shingles"])

    found = texts.select("text").mapInArrow(run, "print binary, shingles binary")
    # Rows that share an id may hold other texts, and the same one twice.
    return chosen.join(found, "print").dropDuplicates(["node"]).select("node", "shingles")


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) that are links by their full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = (batch.column(c).to_pylist() for c in ("a_set", "b_set"))
            kept = [linked(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8"), percent) for x, y in zip(*sides)]
            yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    side = lambda end: sets.select(F.col("node").alias(end), F.col("shingles").alias(f"{end}_set"))
    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(run, "a long, b long")


def open_blocks(members: DataFrame, classes: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """(block, second, node) of the nodes in blocks of buckets (``members``: key, node) that may link two classes.

    Parts of up to ``BLOCK`` of a bucket's rows meet parts of as many of those that are not of its largest class,
    so rows grow with a bucket as long as most of it is one class, and a bucket of one class gives nothing.  Pairs
    are left out if they are of one class, too far apart by size or sketch, or meet in an earlier table; rows
    without a pair go, and pairs are never put out.
    """
    placed = materialize(members.join(classes, "node").select("key", "node", "class"), "bucket-members")
    shares = placed.groupBy("key", "class").agg(F.count(F.lit(1)).alias("n"))
    buckets = shares.groupBy("key").agg(
        F.count(F.lit(1)).alias("classes"), F.sum("n").alias("all"), F.max(F.struct("n", "class")).alias("main")
    )
    buckets = materialize(
        buckets.where("classes > 1").select(
            "key", F.ceil(F.col("all") / BLOCK).alias("parts"), F.ceil((F.col("all") - F.col("main.n")) / BLOCK).alias("sides"),
            F.col("main.class").alias("main"),
        ), "buckets",
    )
    dealt = placed.join(buckets, "key").withColumn("drawn", F.xxhash64("node", "key"))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    first = dealt.select(
        "key", F.pmod("drawn", "parts").alias("part"), each("sides").alias("side"), F.lit(False).alias("second"), "node", "class"
    )
    second = dealt.where(F.col("class") != F.col("main")).select(
        "key", each("parts").alias("part"), F.pmod("drawn", "sides").alias("side"), F.lit(True).alias("second"), "node", "class"
    )
    rows = first.union(second).join(nodes.select("node", "n", "numbers", "bits"), "node")
    columns = ("key", "part", "side", "second", "node", "class", "n", "numbers", "bits")

    def block(key: int, part: int, side: int, rows: list[tuple]) -> pa.RecordBatch:
        second = np.array([r[0] for r in rows])
        node, class_, n = (np.array([r[at] for r in rows], np.int64) for at in (1, 2, 3))
        numbers, bits = (np.frombuffer(b"".join(r[at] for r in rows), "<u8").reshape(len(rows), -1) for at in (4, 5))
        left, right = np.flatnonzero(~second), np.flatnonzero(second)
        wanted: set[int] = set()
        step = max(1, (1 << 18) // max(1, len(right)))
        for begin in range(0, len(left), step):
            some = left[begin : begin + step]
            like = 100 * np.minimum(n[some, None], n[right]) >= percent * np.maximum(n[some, None], n[right])
            x, y = np.nonzero(like & (class_[some, None] != class_[right]))
            x, y = some[x], right[y]
            if not len(x):
                continue
            near = may_link(n[x], n[y], np.bitwise_count(bits[x] ^ bits[y]).sum(axis=1, dtype=np.int64), percent)
            x, y = x[near], y[near]
            same = numbers[x] == numbers[y]
            # Two collections at least agree; the first two are the table they are compared in.
            one = same.argmax(axis=1)
            same[np.arange(len(x)), one] = False
            two = same.argmax(axis=1)
            table = one * (2 * COLLECTIONS - one - 1) // 2 + two - one - 1
            here = mixed(mixed(numbers[x, one] + TABLE_SALT[table]) + numbers[x, two]).view(np.int64) == key
            wanted.update((2 * x[here]).tolist(), (2 * y[here] + 1).tolist())
        found = np.array(sorted(wanted), np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array([f"{key}.{part}.{side}"] * len(found), pa.string()), pa.array(found % 2 == 1), pa.array(node[found // 2])],
            names=["block", "second", "node"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            for key, part, side, *row in zip(*[batch.column(c).to_pylist() for c in columns]):
                if (key, part, side) != at and held:
                    yield block(*at, held)
                    held = []
                at = key, part, side
                held.append(tuple(row))
        if held:
            yield block(*at, held)

    sorted_rows = rows.select(*columns).repartition("key", "part", "side").sortWithinPartitions("key", "part", "side")
    return sorted_rows.mapInArrow(run, "block string, second boolean, node long")


def links_of_block(rows: list[tuple], percent: int) -> list[tuple[int, int]]:
    """Links that join what all links between the two sides of a block join; rows are (second, node, class, shingles)."""
    sets = [np.frombuffer(r[3], "<u8") for r in rows]
    names: dict[int, int] = {}
    roots = np.array([names.setdefault(r[2], len(names)) for r in rows])
    sizes = np.array([len(s) for s in sets], np.int64)
    second = np.array([r[0] for r in rows])
    found = []
    for i in np.flatnonzero(~second).tolist():
        near = second & (100 * np.minimum(sizes, sizes[i]) >= percent * np.maximum(sizes, sizes[i]))
        for j in np.flatnonzero(near).tolist():
            if roots[i] != roots[j] and linked(sets[i], sets[j], percent):
                found.append((rows[i][1], rows[j][1]))
                roots[roots == roots[j]] = roots[i]
    return found


def confirmed_blocks(blocks: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of ``blocks`` (block, second, node, class, shingles)."""
    columns = ("block", "second", "node", "class", "shingles")

    def out(rows: list[tuple]) -> pa.RecordBatch:
        found = links_of_block(rows, percent)
        ends = zip(*found) if found else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(end, pa.int64()) for end in ends], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held = None, []
        for batch in batches:
            for block, *row in zip(*[batch.column(c).to_pylist() for c in columns]):
                if block != name and held:
                    yield out(held)
                    held = []
                name = block
                held.append(tuple(row))
        if held:
            yield out(held)

    return blocks.select(*columns).repartition("block").sortWithinPartitions("block").mapInArrow(run, "a long, b long")


def classes_of(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, class) of all nodes, from the ``roots`` of those with a link."""
    return nodes.select("node").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("class"))


def near_duplicates(docs: DataFrame, words: int = 3, percent: int = 85) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    A document's set are its distinct ``words``-word shingles, A-Z in lower case; documents are linked where
    100 * intersection reaches ``percent`` * union.  component_id is the smallest doc_id that links reach, kept
    marks it.  Equal sets are one node.  Nodes that share a table's key are candidates: pairs with the
    leaders of buckets are confirmed first, then all pairs of a bucket that are still in two classes.  Documents without
    words (null texts too) have no shingle and are linked with nothing.  Rows of a null id get a row; a null is a
    component's id only where it holds no other.  Other columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = materialize(signatures(docs, words), "signatures")
    nodes = rows.where("n > 0").groupBy("print").agg(
        F.min("doc_id").alias("first_id"), *[F.first(c).alias(c) for c in ("n", "numbers", "bits")]
    )
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    keys = keyed(nodes)
    buckets = keys.groupBy("key").agg(F.count(F.lit(1)).alias("all")).where("`all` > 1")
    members = materialize(keys.join(buckets, "key").select("key", "node", "all"), "members")
    pairs = pairs_with_leaders(members)
    near = materialize(near_pairs(pairs, nodes, percent).join(pairs, ["a", "b"]), "near")
    sets = full_sets(docs, nodes, near.select(F.explode(F.array("a", "b")).alias("node")), words)
    sets = materialize(sets, "sets")
    # One leader of each node first; the others only where that has left the two in different classes.
    best = near.groupBy("b").agg(F.max(F.struct("degree", "a")).alias("best")).select(F.col("best.a").alias("a"), "b")
    links = materialize(confirmed(best, sets, percent), "links")
    classes = materialize(classes_of(nodes, components(links)), "classes")
    ends = near.join(classes.select(F.col("node").alias("a"), F.col("class").alias("a_class")), "a").join(
        classes.select(F.col("node").alias("b"), F.col("class").alias("b_class")), "b"
    )
    more = materialize(confirmed(ends.where("a_class <> b_class").select("a", "b"), sets, percent), "links")
    if not more.isEmpty():
        links = links.union(more)
        classes = materialize(classes_of(nodes, components(links)), "classes")
    # In a bucket of two both have met; larger ones may hold links between others than their leader.
    members = members.where("`all` > 2")
    blocks = materialize(open_blocks(members.select("key", "node"), classes, nodes, percent), "blocks")
    if not blocks.isEmpty():
        sets = materialize(full_sets(docs, nodes, blocks.select("node"), words), "sets")
        late = confirmed_blocks(blocks.join(classes, "node").join(sets, "node"), percent)
        late = materialize(late, "late")
        if not late.isEmpty():
            classes = classes_of(nodes, components(links.union(late)))
    rooted = nodes.select("node", "print", "first_id").join(classes, "node")
    least = rooted.groupBy("class").agg(F.min("first_id").alias("component_id"))
    found = rooted.join(least, "class").select("print", "component_id")
    whole = rows.select("doc_id", "n", "print").join(found, "print", "left")
    id_ = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return whole.select(
        "doc_id", F.col("n").alias("n_shingles"), id_.alias("component_id"), F.col("doc_id").eqNullSafe(id_).alias("kept")
    )
