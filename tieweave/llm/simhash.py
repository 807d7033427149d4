"""Near-duplicates by SimHash: fingerprints, tiled exact comparison, classes."""

from __future__ import annotations

import hashlib
from itertools import product
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tieweave.llm.common import slices, shuffle_partitions
from tieweave.llm.components import components
from tieweave.session import materialize

#: Fingerprints in a tile at most, and the number of shares of the second side of a comparison.
TILE = 4096
SHARES = 8
#: Rows of either side of a block at most, whose texts one task holds together.
BLOCK = 256
#: Texts of at most so many distinct shingles meet by shared shingles too, as few shingles make rough fingerprints.
FEW = 64
#: Columns that ``fingerprints`` adds.
INNER = ("print", "bucket", "wording", "print_2")
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_DIGIT = 128  # of a packed class, above the largest count of bits


def shingles(text: str | None, words: int) -> list[bytes]:
    """Word shingles of the lower-cased text; bytes.split() cuts at exactly 0x20 and 0x09-0x0D."""
    found = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not found:
        return []
    if len(found) < words:
        return [b" ".join(found)]
    return [b" ".join(found[i : i + words]) for i in range(len(found) - words + 1)]


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.array([xxh64_intdigest(s, 42) for s in shingles(text, words)], dtype="<u8")


def simhash(hashes: np.ndarray) -> int:
    """Bit set where over half of the hashes have it; 0 without any."""
    counts = np.zeros(64, dtype=np.int64)
    for begin in range(0, len(hashes), 65_536):
        some = hashes[begin : begin + 65_536]
        counts += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def remixed(hashes: np.ndarray) -> np.ndarray:
    """Hashes of the hashes, whose bits tell nothing of the first ones: multiplied and shifted, as often as it takes."""
    out = hashes.astype(np.uint64)
    for factor in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        out = (out ^ (out >> np.uint64(30))) * np.uint64(factor)
    return (out ^ (out >> np.uint64(31))).astype("<u8")


def length_class(distinct: int) -> int:
    """Classes of the number of distinct shingles; sets of similarity 0.8 are at most one apart."""
    return int(np.floor(np.log(distinct) / np.log(1.25))) if distinct else -2


def fingerprints(docs: DataFrame, words: int = 3, once: bool = False) -> DataFrame:
    """Adds to ``docs`` (text): ``print`` (the 64 bits as a long), ``bucket`` (class of length) and
    ``wording`` (md5 of the lower-cased words).  ``once`` counts each distinct shingle once, and adds
    ``print_2``, a fingerprint of the same shingles by other hashes.

    Null texts and texts without words have the fingerprint 0.  Columns of ``docs`` with the names
    of these four are left out.
    """
    kept = [c for c in docs.columns if c.lower() not in INNER]
    docs = docs.select(*kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                prints, others, buckets, wordings = [], [], [], []
                for text in part.column("text").to_pylist():
                    hashes = shingle_hashes(text, words)
                    distinct = np.unique(hashes)
                    prints.append(simhash(distinct if once else hashes))
                    if once:
                        others.append(simhash(remixed(distinct)))
                    buckets.append(length_class(len(distinct)))
                    plain = b" ".join((text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split())
                    wordings.append(hashlib.md5(plain).hexdigest())
                second = [pa.array(np.array(others, dtype=np.uint64).view(np.int64))] if once else []
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(np.array(prints, dtype=np.uint64).view(np.int64)),
                     pa.array(buckets, pa.int32()), pa.array(wordings, pa.string()), *second],
                    names=[*kept, "print", "bucket", "wording", *["print_2"][: len(second)]],
                )

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{kinds}, print long, bucket int, wording string" + ", print_2 long" * once)


def _offsets(buckets: int, segments: int, radius: int) -> list[int]:
    """Differences of packed classes that may hold a link, one of each pair of opposite ones."""
    found = set()
    for near in range(-buckets, buckets + 1):
        for steps in product(range(-radius, radius + 1), repeat=segments):
            if sum(map(abs, steps)) <= radius and (near, *steps) >= (0,) * (segments + 1):
                packed = near
                for step in steps:
                    packed = packed * _DIGIT + step
                found.add(packed)
    return sorted(found)


def spanning(i: np.ndarray, j: np.ndarray, d: np.ndarray, size: int) -> np.ndarray:
    """Indexes of a minimum spanning forest of the edges (i, j) of length d among ``size`` nodes."""
    order = np.argsort(d, kind="stable")
    roots = np.arange(size)
    chosen: list[np.ndarray] = []
    while order.size:
        a, b = roots[i[order]], roots[j[order]]
        apart = a != b
        order, a, b = order[apart], a[apart], b[apart]
        if not order.size:
            break
        # The first, hence shortest, edge of each component.
        first = np.unique(np.unique(np.concatenate([a, b]), return_index=True)[1] % order.size)
        chosen.append(order[first])
        parent = np.arange(size)
        for x, y in zip(a[first].tolist(), b[first].tolist()):
            while parent[x] != x:
                x = parent[x]
            while parent[y] != y:
                y = parent[y]
            parent[max(x, y)] = min(x, y)
        while (parent != parent[parent]).any():
            parent = parent[parent]
        roots = parent[roots]
    return np.concatenate(chosen) if chosen else np.empty(0, dtype=np.int64)


def compare_tiles(a: np.ndarray, b: np.ndarray, radius: int, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of ``a`` and ``b`` at most ``radius`` bits apart, thinned to a minimum spanning forest."""
    n, m = len(a), len(b)
    i = j = d = np.empty(0, dtype=np.int64)
    step = max(1, (1 << 20) // max(m, 1))
    for begin in range(0, n, step):
        bits = np.bitwise_count(a[begin : begin + step, None] ^ b[None, :])
        x, y = np.nonzero(bits <= radius)
        if same:
            above = y > x + begin
            x, y = x[above], y[above]
        if x.size:
            i = np.concatenate([i, x + begin])
            j = np.concatenate([j, y + (0 if same else n)])
            d = np.concatenate([d, bits[x, y].astype(np.int64)])
            if i.size > 2 * (n + m):
                kept = spanning(i, j, d, n + m)
                i, j, d = i[kept], j[kept], d[kept]
    kept = spanning(i, j, d, n + m)
    i, j, d = i[kept], j[kept], d[kept]
    return i, j if same else j - n, d


def tile_pairs(points: DataFrame, radius: int, segments: int, buckets: int = 0) -> DataFrame:
    """Pairs of tiles of ``points`` (print, bucket and any other longs) that may hold near fingerprints.

    Gives (a_kind, a_tile, a_prints, b_kind, b_tile, b_prints).  Two fingerprints at most ``radius`` bits
    apart have population counts at most ``radius`` apart, in whole and in the sum over ``segments`` equal
    parts of the 64 bits; buckets may be ``buckets`` apart.  Tiles hold up to 4096 points of equal counts
    and bucket, each as its print and other longs.  A tile meets those whose counts are near enough,
    found by an equi-join on the counts.
    """
    spark = points.sparkSession
    width = 64 // segments
    names = ["print", *[c for c in points.columns if c not in ("print", "bucket")]]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, kind = TaskContext.get().partitionId() << 32, [], None

        def tile() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([kind], pa.int64()), pa.array([at], pa.int64()),
                 pa.array([np.concatenate(held).tobytes()], pa.binary())],
                names=["kind", "tile", "prints"],
            )

        for batch in batches:
            kinds = batch.column("kind").to_numpy()
            prints = np.stack([batch.column(c).to_numpy() for c in names], axis=1)
            cuts = np.flatnonzero(np.diff(kinds)) + 1
            for run, begin in zip(np.split(prints, cuts), np.concatenate([[0], cuts])):
                if not len(run):
                    continue
                if held and kinds[begin] != kind:
                    yield tile()
                    held, at = [], at + 1
                kind = int(kinds[begin])
                while len(run):
                    room = TILE - sum(map(len, held))
                    held.append(run[:room])
                    run = run[room:]
                    if sum(map(len, held)) == TILE:
                        yield tile()
                        held, at = [], at + 1
        if held:
            yield tile()

    mask = (1 << width) - 1
    kind = F.col("bucket").cast("long") + 2
    for s in range(segments):
        part = F.shiftrightunsigned("print", s * width).bitwiseAND(F.lit(mask)) if segments > 1 else F.col("print")
        kind = kind * _DIGIT + F.bit_count(part).cast("long")
    sorted_points = points.select(kind.alias("kind"), *names).repartitionByRange(
        shuffle_partitions(spark), "kind", *names
    ).sortWithinPartitions("kind", *names)
    tiles = materialize(sorted_points.mapInArrow(build, "kind long, tile long, prints binary"), "tiles")

    steps = F.array(*[F.lit(x) for x in _offsets(buckets, segments, radius)])
    # A tile of the first side picks one share by its number; the second side stands in each.
    first = tiles.select(
        F.explode(steps).alias("step"), F.col("kind").alias("a_kind"), F.col("tile").alias("a_tile"),
        F.col("prints").alias("a_prints"), F.pmod(F.xxhash64("tile"), F.lit(SHARES)).alias("share"),
    ).withColumn("b_kind", F.col("a_kind") + F.col("step"))
    second = tiles.select(
        F.col("kind").alias("b_kind"), F.col("tile").alias("b_tile"), F.col("prints").alias("b_prints"),
        F.explode(F.array(*[F.lit(x).cast("long") for x in range(SHARES)])).alias("share"),
    )
    pairs = first.join(second, ["b_kind", "share"]).where((F.col("step") != 0) | (F.col("a_tile") <= F.col("b_tile")))
    return pairs.select("a_kind", "a_tile", "a_prints", "b_kind", "b_tile", "b_prints")


def links(points: DataFrame, radius: int, segments: int, buckets: int = 0) -> DataFrame:
    """Links between the distinct ``points`` (print, bucket): (a, a_bucket, b, b_bucket, bits).

    Pairs of tiles (``tile_pairs``) are compared bit for bit by exclusive or and bit count.  Of the
    links inside a pair of tiles a minimum spanning forest is put out: it joins the same rows at
    every distance, and has fewer links than the tiles have rows, however many alike rows they hold.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scale = _DIGIT**segments
        for batch in batches:
            columns = [batch.column(c) for c in ("a_kind", "a_tile", "a_prints", "b_kind", "b_tile", "b_prints")]
            for a_kind, a_tile, a, b_kind, b_tile, b in zip(*columns):
                left, right = (np.frombuffer(x.as_py(), dtype="<u8") for x in (a, b))
                i, j, d = compare_tiles(left, right, radius, a_tile == b_tile)
                if i.size:
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(left[i].view(np.int64)), pa.array(np.full(i.size, a_kind.as_py() // scale - 2, np.int32)),
                            pa.array(right[j].view(np.int64)), pa.array(np.full(i.size, b_kind.as_py() // scale - 2, np.int32)),
                            pa.array(d.astype(np.int32)),
                        ],
                        names=["a", "a_bucket", "b", "b_bucket", "bits"],
                    )

    pairs = tile_pairs(points.select("print", "bucket"), radius, segments, buckets)
    return pairs.mapInArrow(compare, "a long, a_bucket int, b long, b_bucket int, bits int")


def open_blocks(points: DataFrame, radius: int, buckets: int) -> DataFrame:
    """Blocks of the ``points`` (print, bucket, tag, class) that are near one of another class.

    Gives (block, second, print, tag).  A block holds at most ``BLOCK`` rows of either side; each pair
    of points of two classes at most ``radius`` bits apart is in one block, on its two sides or, if no
    row of the block is a second one, on the same.  So rows go out, not pairs.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("a_tile", "a_prints", "b_tile", "b_prints")]
            for a_tile, a, b_tile, b in zip(*columns):
                left, right = (np.frombuffer(x, dtype="<u8").reshape(-1, 3) for x in (a, b))
                for x in range(0, len(left), BLOCK):
                    some = left[x : x + BLOCK]
                    for y in range(x if a_tile == b_tile else 0, len(right), BLOCK):
                        other = right[y : y + BLOCK]
                        near = np.bitwise_count(some[:, None, 0] ^ other[None, :, 0]) <= radius
                        near &= some[:, None, 2] != other[None, :, 2]
                        if not near.any():
                            continue
                        rows = some[near.any(axis=1)]
                        sides = np.zeros(len(rows), bool)
                        if a_tile != b_tile or x != y:
                            rows = np.concatenate([rows, other[near.any(axis=0)]])
                            sides = np.concatenate([sides, np.ones(len(rows) - len(sides), bool)])
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([f"{a_tile}-{b_tile}-{x}-{y}"] * len(rows)), pa.array(sides),
                             pa.array(rows[:, 0].view(np.int64)), pa.array(rows[:, 1].view(np.int64))],
                            names=["block", "second", "print", "tag"],
                        )

    pairs = tile_pairs(points.select("print", "bucket", "tag", "class"), radius, 1, buckets)
    return pairs.mapInArrow(compare, "block string, second boolean, print long, tag long")


def links_of_block(rows: list[tuple], words: int, similarity: float) -> list[tuple[str, str]]:
    """Verified links that join what all links of a block join; rows are (second, wording, print, class,
    reach, text).

    Every pair within ``reach`` bits whose wordings are not yet in one class is verified; only those
    that are in one already are passed over.
    """
    second = np.array([r[0] for r in rows])
    prints = np.array([r[2] for r in rows], dtype=np.int64).view(np.uint64)
    reach = rows[0][4]
    numbers: dict[bytes, int] = {}
    sets = [np.array([numbers.setdefault(s, len(numbers)) for s in set(shingles(r[5], words))], np.int64) for r in rows]
    sizes = np.array([len(x) for x in sets])
    names: dict[int, int] = {}
    roots = np.array([names.setdefault(r[3], len(names)) for r in rows])
    held = np.zeros(len(numbers), bool)
    at = np.arange(len(rows))
    found = []
    for i in np.flatnonzero(~second):
        others = np.flatnonzero(second if second.any() else at > i)
        near = np.bitwise_count(prints[others] ^ prints[i]) <= reach
        near &= np.minimum(sizes[others], sizes[i]) >= similarity * np.maximum(sizes[others], sizes[i]) - 1e-9
        others = others[near & (sizes[others] > 0)]
        held[sets[i]] = True
        for j in others.tolist():
            if roots[i] == roots[j]:
                continue
            common = int(held[sets[j]].sum())
            if common >= similarity * (sizes[i] + sizes[j] - common) - 1e-9:
                found.append((rows[i][1], rows[j][1]))
                roots[roots == roots[j]] = roots[i]
        held[sets[i]] = False
    return found


def verified_blocks(blocks: DataFrame, words: int, similarity: float) -> DataFrame:
    """Links (a, b) of ``blocks`` (block, second, wording, print, class, reach, text), see ``links_of_block``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, rows = None, []
        for batch in batches:
            for name, *row in zip(*[batch.column(c).to_pylist() for c in columns]):
                if name != block and rows:
                    yield out(links_of_block(rows, words, similarity))
                    rows = []
                block = name
                rows.append(tuple(row))
        if rows:
            yield out(links_of_block(rows, words, similarity))

    def out(found: list[tuple[str, str]]) -> pa.RecordBatch:
        ends = zip(*found) if found else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(end, pa.string()) for end in ends], names=["a", "b"])

    columns = ["block", "second", "wording", "print", "class", "reach", "text"]
    return blocks.select(*columns).repartition("block").sortWithinPartitions("block").mapInArrow(run, "a string, b string")


def near_classes(docs: DataFrame, words: int = 3, radius: int = 2) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, fingerprint, component_id.

    Documents are linked where their fingerprints differ in ``radius`` bits at most; component_id is
    the smallest doc_id that links reach.  Equal fingerprints are one point, so copies are never
    paired.  Null and wordless texts have the fingerprint zero and are linked like others.  A null
    id gets a row; it is a component's id only if that holds no other.
    """
    prints = materialize(fingerprints(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), words).select("doc_id", "print"), "prints")
    points = prints.groupBy("print").agg(F.min("doc_id").alias("first_id"))
    points = materialize(points, "points")
    found = links(points.select("print", F.lit(0).alias("bucket")), radius, segments=4)
    roots = components(found.select("a", "b"))
    rooted = points.join(roots, points["print"] == roots["node"], "left").select(
        "print", "first_id", F.coalesce("root", "print").alias("root")
    )
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = rooted.join(smallest, "root").select("print", "component_id")
    return prints.join(classes, "print").select(
        "doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id"
    )


def few_blocks(prints: DataFrame, classes: DataFrame, words: int, similarity: float) -> DataFrame:
    """Blocks (block, second, wording) of the short texts that share a shingle and may be similar.

    ``prints`` are rows with text, bucket and wording, ``classes`` has the class of each wording.  Sets
    of n shingles as similar as that share one of the first ``n - ceil(similarity n) + 1`` of either,
    in any one order; the rarest come first here, so a passage that many texts hold makes no blocks.
    Both sets of a pair are met if the smaller has at most ``FEW`` shingles.  A shingle whose texts
    are in one class makes none.  Blocks have at most about ``BLOCK`` rows of either side.
    """
    most = int(FEW / similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wordings, hashes = [], []
            for wording, text in zip(batch.column("wording").to_pylist(), batch.column("text").to_pylist()):
                found = np.unique(shingle_hashes(text, words))
                if len(found) <= most:
                    wordings += [wording] * len(found)
                    hashes.append(found.view(np.int64))
            hashes = np.concatenate([np.empty(0, np.int64), *hashes])
            yield pa.RecordBatch.from_arrays([pa.array(wordings, pa.string()), pa.array(hashes)], names=["wording", "shingle"])

    short = prints.where(F.col("bucket").between(0, length_class(most))).select("wording", "text")
    few = materialize(short.mapInArrow(run, "wording string, shingle long").distinct(), "few")
    often = materialize(few.groupBy("shingle").agg(F.count("*").alias("n")), "often")
    ordered = few.join(often, "shingle").groupBy("wording").agg(F.sort_array(F.collect_list(F.struct("n", "shingle"))).alias("all"))
    size = F.size("all")
    first = ordered.select(
        "wording", F.explode(F.slice("all", F.lit(1), size - F.ceil(size * similarity - 1e-9).cast("int") + 1)).alias("one")
    )
    first = first.where("one.n > 1").select("wording", F.col("one.shingle").alias("shingle")).join(
        classes.select("wording", "class"), "wording"
    )
    first = materialize(first, "first")
    open_ = first.groupBy("shingle").agg(F.count("*").alias("n"), F.min("class").alias("a"), F.max("class").alias("b"))
    open_ = materialize(open_.where("a <> b").select("shingle", F.ceil(F.col("n") / BLOCK).alias("parts")), "open")
    mine = F.pmod(F.xxhash64("wording", "shingle"), F.col("parts"))
    dealt = first.join(open_, "shingle").select(
        "wording", "shingle", mine.alias("mine"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("other")
    )
    return dealt.select(
        F.concat_ws("-", F.lit("few"), "shingle", F.least("mine", "other"), F.greatest("mine", "other")).alias("block"),
        (F.col("mine") > F.col("other")).alias("second"), "wording",
    )


def near_copies_removed(docs: DataFrame, words: int = 5, similarity: float = 0.8, radius: int = 13) -> DataFrame:
    """``docs`` (doc_id, text and any others) without all but one document of each near-copy class.

    Each document has two fingerprints of its distinct ``words``-word shingles, by independent hashes.
    Documents of which either differs in at most ``radius`` bits are candidates, and so are all texts of
    which one has at most ``FEW`` distinct shingles; a candidate is a link if the sets of shingles have
    a Jaccard similarity of ``similarity`` or more.
    A forest of the candidates by the first fingerprint is verified first, with the smallest wording of each
    for all; then every candidate, of all wordings, whose ends are not in one class of verified links is.
    A class is what links reach; its document with the smallest id stays (ties: by wording).
    Texts with the same words, case aside, are one class, so empty and null texts are one.  Rows
    that repeat an id and wording are one document.  Other columns keep their names, whatever these are.
    """
    if not 0.8 <= similarity <= 1:
        raise ValueError("classes of length are cut for a similarity of 0.8 or more")
    columns = docs.columns
    # The caller's columns of the same names as inner ones step aside until the end.
    aside = {c: f"_own{n}" for n, c in enumerate(columns) if c.lower() in INNER}
    docs = docs.withColumnsRenamed(aside)
    # Holds every text and stays until the folder is emptied.
    prints = materialize(fingerprints(docs, words, once=True), "prints", compression="zstd")
    nodes = materialize(
        prints.groupBy("wording", "print", "print_2", "bucket").agg(F.min("doc_id").alias("first_id")), "nodes"
    )
    by_print = nodes.groupBy("print", "bucket").agg(F.min("wording").alias("lead"))
    found = links(by_print, radius, segments=1, buckets=1)
    leads = materialize(by_print, "leads")
    side = lambda end: leads.select(
        F.col("print").alias(end), F.col("bucket").alias(f"{end}_bucket"), F.col("lead").alias(f"{end}_lead")
    )
    across = found.join(side("a"), ["a", "a_bucket"]).join(side("b"), ["b", "b_bucket"]).select("a_lead", "b_lead")
    inside = nodes.join(leads, ["print", "bucket"]).where(F.col("lead") != F.col("wording")).select(
        F.col("lead").alias("a_lead"), F.col("wording").alias("b_lead")
    )
    candidates = materialize(across.union(inside), "candidates")

    def texts_of(wordings: DataFrame) -> DataFrame:
        # One document's text for each wording: met by id and wording, so many copies are no one task's.
        first = nodes.join(wordings.distinct(), "wording", "left_semi").select(F.col("wording").alias("of"), "first_id")
        return (
            prints.select("doc_id", "wording", "text")
            .join(first, (F.col("wording") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("first_id")))
            .groupBy("wording")
            .agg(F.min("text").alias("text"))
        )

    involved = candidates.select(F.col("a_lead").alias("wording")).union(candidates.select("b_lead"))
    texts = materialize(texts_of(involved), "texts")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for left, right in zip(batch.column("a_text").to_pylist(), batch.column("b_text").to_pylist()):
                a, b = set(shingles(left, words)), set(shingles(right, words))
                common = len(a & b)
                kept.append(common >= similarity * (len(a) + len(b) - common) - 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    paired = candidates.join(
        texts.select(F.col("wording").alias("a_lead"), F.col("text").alias("a_text")), "a_lead"
    ).join(texts.select(F.col("wording").alias("b_lead"), F.col("text").alias("b_text")), "b_lead")
    verified = paired.select(F.col("a_lead").alias("a"), F.col("b_lead").alias("b"), "a_text", "b_text").mapInArrow(
        verify, "a string, b string"
    )
    verified = materialize(verified, "verified")
    # The forest took one way between wordings, which may have failed: what is still apart meets again, whole.
    roots = components(verified)
    apart = nodes.join(roots, nodes["wording"] == roots["node"], "left").select(
        "wording", "print", "print_2", "bucket", F.xxhash64("wording").alias("tag"),
        F.xxhash64(F.coalesce("root", "wording")).alias("class"),
    )
    apart = materialize(apart, "apart")
    near = []
    for name in ("print", "print_2"):
        points = apart.select(F.col(name).alias("print"), "bucket", "tag", "class", "wording")
        blocks = open_blocks(points, radius, buckets=1).join(points.drop("bucket"), ["print", "tag"])
        block = F.concat_ws("-", F.lit(name), "block").alias("block")
        near.append(blocks.select(block, "second", "wording", "print", "class", F.lit(radius).alias("reach")))
    few = few_blocks(prints, apart, words, similarity).join(apart.select("wording", "print", "class"), "wording")
    few = few.select("block", "second", "wording", "print", "class", F.lit(64).alias("reach"))
    blocks = materialize(near[0].union(near[1]).union(few), "blocks")
    late = verified_blocks(blocks.join(texts_of(blocks.select("wording")), "wording"), words, similarity)
    roots = components(verified.union(late))
    rooted = nodes.join(roots, nodes["wording"] == roots["node"], "left").select(
        "wording", "first_id", F.coalesce("root", "wording").alias("root")
    )
    stays = rooted.groupBy("root").agg(
        F.min(F.struct(F.col("first_id").isNull(), F.col("first_id"), F.col("wording"))).alias("least")
    ).select(F.col("least.first_id").alias("kept_id"), F.col("least.wording").alias("kept_wording"))
    # The kept document is one row: of equal ids and wordings any one stands for all.
    one = prints.dropDuplicates(["doc_id", "wording"])
    return one.join(
        stays, one["doc_id"].eqNullSafe(F.col("kept_id")) & (one["wording"] == F.col("kept_wording")), "left_semi"
    ).select(*[F.col(f"`{aside.get(c, c)}`").alias(c) for c in columns])
