"""Language identification by interpolated Kneser-Ney character models."""

from __future__ import annotations

import sys
import unicodedata
from dataclasses import dataclass, field
from functools import reduce
from typing import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tieweave.llm.common import pmod_of_id, slices
from tieweave.session import materialize

ORDER = 4
#: Symbols have 16 bits, so a gram of four is one unsigned 64-bit number.
_BITS = np.uint64(16)
_SPACE = 32
#: Odd, so multiplying by it is one-to-one on 64 bits: hashes spread evenly and never collide.
_HASH = np.uint64(0x9E3779B97F4A7C15)
#: Entries of all tables up to which a model is held by the driver and sent to the tasks (about 12 bytes each);
#: a larger one stays a table and is met by joins, with the same results.
HELD = 1 << 22
#: A text is rejected if its entropy is beyond this share of the way from that of known texts of its
#: language to that of texts of other languages; texts of fewer than SHORT symbols get a wider limit,
#: as their entropy spreads more.
REJECTED_FROM = 0.5
SHORT = 60
#: Texts that set a language's limit at least, and the folds that languages with fewer are held out in.
LEAST_CHECKED = 5
FOLDS = 4
UNDETERMINED = "und"
#: Bytes of text whose grams a task holds at once; each becomes some sixty bytes of numbers on the way.
SLICE = 1 << 19
#: Bytes of text in a block of documents that meets a model which is not held, and grams sent in a batch.
BLOCK = 1 << 23
SENT = 100_000

_kinds: np.ndarray | None = None


def _kind_table() -> np.ndarray:
    """For each code point: 2 a letter, 1 a mark that belongs to one, 0 anything else."""
    global _kinds
    if _kinds is None:
        kind = {"L": 2, "M": 1}
        _kinds = np.array([kind.get(unicodedata.category(chr(c))[0], 0) for c in range(sys.maxunicode + 1)], np.uint8)
    return _kinds


def symbols(text: str | None) -> np.ndarray:
    """Lower-cased letters and marks, anything between them as one blank, blanks at both ends.

    Three blanks in front give the first symbol a full context.  Empty without a letter.
    """
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    kinds = _kind_table()[points]
    if not (kinds == 2).any():
        return np.empty(0, dtype=np.uint64)
    letter = kinds > 0
    folded = np.where(points < 65_536, points, 0xE000 + points % 0x1900)  # beyond 16 bits: private use area
    found = np.where(letter, folded, _SPACE)[letter | np.concatenate([[True], letter[:-1]])]
    return np.concatenate([[_SPACE] * (ORDER - 1), found, [_SPACE]]).astype(np.uint64)


def grams(found: np.ndarray) -> np.ndarray:
    """The packed grams of a text's symbols, one for each symbol after the context in front."""
    packed = np.zeros(len(found) - ORDER + 1, dtype=np.uint64)
    for n in range(ORDER):
        packed = (packed << _BITS) | found[n : n + len(packed)]
    return packed


def _merge(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if keys.size else np.empty(0, int)
    return keys[first], np.add.reduceat(counts, first) if keys.size else counts


class HashArray:
    """Values by gram: hashes in ascending order beside the values."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        hashes = keys * _HASH
        order = np.argsort(hashes)
        self.hashes, self.values = hashes[order], values[order].astype(np.float32)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Value of each key, and whether it is there (else the value means nothing)."""
        if not self.hashes.size:
            return np.zeros(len(keys), np.float32), np.zeros(len(keys), bool)
        hashes = keys * _HASH
        at = np.minimum(np.searchsorted(self.hashes, hashes), self.hashes.size - 1)
        return self.values[at], self.hashes[at] == hashes


class CharModel:
    """The tables of one language as sorted hash arrays: logarithms of chances and of weights, by order.

    ``kinds`` has 2n for each chance of order n and 2n + 1 for each weight.
    """

    def __init__(self, kinds: np.ndarray, keys: np.ndarray, values: np.ndarray, uniform: float) -> None:
        self.uniform = uniform
        self.probability: list[HashArray] = []
        self.backoff: list[HashArray] = []
        for n in range(1, ORDER + 1):
            for weight, arrays in ((0, self.probability), (1, self.backoff)):
                own = kinds == 2 * n + weight
                arrays.append(HashArray(keys[own].view(np.uint64), values[own]))

    def log_probability(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), np.float32)
        open_ = np.arange(len(keys))
        for n in range(ORDER, 0, -1):
            suffix = keys[open_] & np.uint64((1 << 16 * n) - 1) if n < ORDER else keys[open_]
            value, known = self.probability[n - 1].find(suffix)
            out[open_[known]] += value[known]
            open_, suffix = open_[~known], suffix[~known]
            if not open_.size:
                return out
            weight, known = self.backoff[n - 1].find(suffix >> _BITS)
            out[open_[known]] += weight[known]
        out[open_] += self.uniform
        return out


@dataclass
class LanguageModel:
    """Languages by name, their tables, and each one's mean entropies, which limit what is accepted.

    ``tables`` has a row (lang, n, weight, key, value) for each gram of each order n: the logarithm of its
    chance, or (weight) of what its context leaves to the order below.  ``models`` are the same tables as hash
    arrays, in the order of the languages; they are there only if the entries are no more than ``HELD``.
    """

    languages: list[str] = field(default_factory=list)
    models: list[CharModel] = field(default_factory=list)
    limits: dict[str, tuple[float, float]] = field(default_factory=dict)
    uniform: float = 0.0
    tables: DataFrame | None = None

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy in nats per symbol, texts by languages, and the symbols of each text."""
        return entropies(texts, [m.log_probability for m in self.models])

    def rejected(self, language: str, entropy: float, size: int) -> bool:
        if language not in self.limits:
            return False
        own, other = self.limits[language]
        return entropy > own + REJECTED_FROM * (other - own) * max(1.0, (SHORT / size) ** 0.5)

    def for_tasks(self) -> "LanguageModel":
        return LanguageModel(self.languages, self.models, self.limits, self.uniform)


def entropies(texts: list[str | None], chances: list[Callable]) -> tuple[np.ndarray, np.ndarray]:
    """See ``LanguageModel.entropies``; ``chances`` give the logarithms for distinct grams, by language."""
    found = [grams(s) if s.size else np.empty(0, np.uint64) for s in map(symbols, texts)]
    sizes = np.array([len(g) for g in found], dtype=np.int64)
    out = np.full((len(texts), len(chances)), np.inf)
    some = np.flatnonzero(sizes)
    if some.size and chances:
        distinct, inverse = np.unique(np.concatenate([found[i] for i in some]), return_inverse=True)
        starts = np.concatenate([[0], np.cumsum(sizes[some])[:-1]])
        for n, chance in enumerate(chances):
            each = chance(distinct).astype(np.float64)
            out[some, n] = -np.add.reduceat(each[inverse], starts) / sizes[some]
    return out, sizes


def count_grams(texts: DataFrame) -> DataFrame:
    """(lang, gram, count) of all ``texts`` (lang, text); counted per task, then summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, (keys, counts) in held.items():
                for begin in range(0, len(keys), SENT):
                    part = keys[begin : begin + SENT].view(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(part)), pa.array(part), pa.array(counts[begin : begin + SENT])],
                        names=["lang", "gram", "count"],
                    )
            held.clear()

        for batch in batches:
            for part in slices(batch, "text", SLICE):
                by_lang: dict[str, list[np.ndarray]] = {}
                for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist()):
                    found = symbols(text)
                    if found.size:
                        by_lang.setdefault(lang, []).append(grams(found))
                for lang, found in by_lang.items():
                    keys, counts = np.unique(np.concatenate(found), return_counts=True)
                    if lang in held:
                        keys = np.concatenate([held[lang][0], keys])
                        counts = np.concatenate([held[lang][1], counts])
                    held[lang] = _merge(keys, counts.astype(np.int64))
                if sum(len(k) for k, _ in held.values()) > 2_000_000:
                    yield from flush()
        yield from flush()

    counted = texts.select("lang", "text").mapInArrow(run, "lang string, gram long, count long")
    return counted.groupBy("lang", "gram").agg(F.sum("count").alias("count"))


def _suffix(n: int):
    return F.col("key").bitwiseAND(F.lit((1 << 16 * n) - 1))


def orders(counted: DataFrame) -> list[DataFrame]:
    """(lang, key, count) for each order from 1: the highest counts occurrences in ``counted`` (lang, gram,
    count), each lower one in how many contexts a gram follows another symbol."""
    found = [counted.select("lang", F.col("gram").alias("key"), "count")]
    for n in range(ORDER - 1, 0, -1):
        shorter = found[0].groupBy("lang", _suffix(n).alias("key")).agg(F.count("*").alias("count"))
        found.insert(0, materialize(shorter, f"order{n}"))
    return found


def kneser_ney(levels: list[DataFrame], alphabet: int) -> DataFrame:
    """The tables (lang, n, weight, key, value) of interpolated Kneser-Ney models, one for each ``lang``.

    Each order takes a discount ``D = n1 / (n1 + 2 n2)`` off (0.75 where n1 or n2 is 0) and gives it to the
    one below; the lowest shares with all symbols alike.  All grams count; all is done by joins and windows,
    of which none is larger than the 65 536 symbols that may follow a context.
    """
    below: DataFrame | None = None
    parts = []
    for n, level in enumerate(levels, start=1):
        counts = [F.sum((F.col("count") == k).cast("double")).alias(name) for k, name in ((1, "once"), (2, "twice"))]
        once, twice = F.col("once"), F.col("twice")
        discount = F.when((once > 0) & (twice > 0), once / (once + 2 * twice)).otherwise(0.75)
        discounts = level.groupBy("lang").agg(*counts).select("lang", discount.alias("discount"))
        context = Window.partitionBy("lang", "context")
        rows = level.withColumn("context", F.shiftrightunsigned("key", 16)).select(
            "lang", "key", "context", "count", F.sum("count").over(context).alias("total"),
            F.count("*").over(context).alias("kinds"),
        ).join(discounts, "lang").withColumn("left", F.col("discount") * F.col("kinds") / F.col("total"))
        if below is None:
            rows = rows.withColumn("lower", F.lit(1.0 / alphabet))
        else:
            lower = below.select("lang", F.col("key").alias("suffix"), F.col("chance").alias("lower"))
            rows = rows.withColumn("suffix", _suffix(n - 1)).join(lower, ["lang", "suffix"])
        own = F.greatest(F.col("count") - F.col("discount"), F.lit(0.0)) / F.col("total")
        below = materialize(
            rows.select("lang", "key", "context", "left", (own + F.col("left") * F.col("lower")).alias("chance")), "chances"
        )
        order, weight = F.lit(n).alias("n"), lambda yes: F.lit(yes).alias("weight")
        parts.append(below.select("lang", order, weight(False), "key", F.log("chance").cast("float").alias("value")))
        parts.append(
            below.groupBy("lang", "context").agg(F.first("left").alias("left"))
            .select("lang", order, weight(True), F.col("context").alias("key"), F.log("left").cast("float").alias("value"))
        )
    return materialize(reduce(DataFrame.unionByName, parts), "models")


def _model(languages: list[str], tables: DataFrame, uniform: float) -> LanguageModel:
    model = LanguageModel(languages, uniform=uniform, tables=tables)
    if tables.count() <= HELD:
        # As Arrow columns of 18 bytes an entry: rows would take the driver some 500 bytes each.
        names = F.create_map(*[F.lit(x) for pair in zip(languages, range(len(languages))) for x in pair])
        kind = (2 * F.col("n") + F.col("weight").cast("int")).cast("short").alias("kind")
        held = tables.select(F.element_at(names, F.col("lang")).alias("place"), kind, "key", "value").toArrow()
        places, kinds, keys, values = (held.column(n).to_numpy() for n in range(4))
        for n in range(len(languages)):
            own = places == n
            model.models.append(CharModel(kinds[own], keys[own], values[own], uniform))
    return model


def fit(docs: DataFrame, learned=None) -> LanguageModel:
    """Fits a model for each non-null ``lang`` of ``docs`` (doc_id, text, lang).

    ``learned`` is the condition of the rows to learn from (default: all).  All of them are
    counted, but for one in 32 by crc32 of the id.  Those set the limit of rejection, by their mean
    entropy under their own language and under the nearest other one (alone: a uniform one).  A language
    with fewer than ``LEAST_CHECKED`` of them of ``SHORT`` symbols or more is checked in ``FOLDS`` folds of
    its rows, each under a model of the others; with too few still, the means of all languages count.
    Only where no language has a text that can be held out is there no limit.

    Every gram of every order counts, however rare.  Models of up to ``HELD`` entries come to the driver;
    larger ones stay written tables (see ``met_by_joins``).  Only the languages' names and limits are always listed.

    Null texts, texts without letters and null languages teach nothing.  Without any row to learn
    from the model has no language.
    """
    own = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    own = (own if learned is None else own.where(learned)).select("doc_id", "lang", "text")
    checked = F.coalesce(F.floor(F.crc32(F.col("doc_id").cast("string")) / 4) % 32 == 0, F.lit(False))
    levels = orders(materialize(count_grams(own.where(~checked)), "grams"))
    languages = sorted(r.lang for r in levels[0].select("lang").distinct().collect())
    if not languages:
        return LanguageModel()
    alphabet = levels[0].select("key").distinct().count() + 1
    model = _model(languages, kneser_ney(levels, alphabet), float(np.log(1.0 / alphabet)))
    sums = _sums(calibration(own.where(checked), model))
    few = [lang for lang in languages if lang not in sums or sums[lang][2] < LEAST_CHECKED]
    if few:
        sums = {lang: known for lang, known in sums.items() if lang not in few}
        theirs = own.where(F.col("lang").isin(few))
        fold = F.coalesce(F.floor(F.crc32(F.col("doc_id").cast("string")) / 4) % FOLDS, F.lit(0))
        others = F.explode(F.array_remove(F.array(*[F.lit(n).cast("long") for n in range(FOLDS)]), fold.cast("long")))
        taught = theirs.select(others.alias("fold"), "lang", "text")
        taught = taught.select(F.concat_ws(":", "fold", "lang").alias("lang"), "text")  # a model for each fold
        folded = kneser_ney(orders(materialize(count_grams(taught), "grams")), alphabet)
        names = {r.lang for r in folded.select("lang").distinct().collect()}
        for n in range(FOLDS):
            here = [lang for lang in few if f"{n}:{lang}" in names]
            of_fold = folded.where(F.col("lang").startswith(f"{n}:")).withColumn("lang", F.expr("substring(lang, 3)"))
            rest = model.tables.where(~F.col("lang").isin(here)) if here else model.tables
            held = theirs.where((fold == n) & F.col("lang").isin(here))
            for lang, new in _sums(calibration(held, _model(languages, rest.unionByName(of_fold), model.uniform))).items():
                sums[lang] = tuple(a + b for a, b in zip(sums.get(lang, (0.0, 0.0, 0)), new))
    pooled = [sum(x) for x in zip(*sums.values())]
    for lang in languages:
        mean, other, n = sums.get(lang, (0.0, 0.0, 0))
        if n < LEAST_CHECKED and pooled:
            mean, other, n = pooled
        if n:
            model.limits[lang] = (mean / n, other / n)
    return model


def _sums(checked: DataFrame) -> dict[str, tuple[float, float, int]]:
    """By language: the sums of its texts' own and other entropies, and their number."""
    rows = checked.groupBy("lang").agg(F.sum("own"), F.sum("other"), F.count("*")).collect()
    return {lang: (own, other, n) for lang, own, other, n in rows}


Finish = Callable[[pa.RecordBatch, np.ndarray, np.ndarray, LanguageModel], pa.RecordBatch]


def _scored(docs: DataFrame, model: LanguageModel, finish: Finish, schema: str) -> DataFrame:
    """What ``finish`` makes of rows of ``docs`` (text), their entropies and their numbers of symbols."""
    if model.languages and not model.models:
        return met_by_joins(docs, model, finish, schema)
    shipped = docs.sparkSession.sparkContext.broadcast(model.for_tasks())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shipped.value
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                yield finish(part, *known.entropies(part.column("text").to_pylist()), known)

    return docs.mapInArrow(run, schema)


def gram_scores(wanted: DataFrame, model: LanguageModel) -> DataFrame:
    """(gram, chances) of the distinct grams of ``wanted`` (gram): logarithms in the order of the languages."""
    found = wanted.select("gram").distinct()
    names = F.create_map(*[F.lit(x) for pair in zip(model.languages, range(len(model.languages))) for x in pair])
    tables = model.tables.withColumn("place", F.element_at(names, F.col("lang")))
    for n in range(ORDER, 0, -1):
        suffix = F.col("gram").bitwiseAND(F.lit((1 << 16 * n) - 1)) if n < ORDER else F.col("gram")
        for weight, name, key in ((False, f"p{n}", suffix), (True, f"b{n}", F.shiftrightunsigned(suffix, 16))):
            values = tables.where((F.col("n") == n) & (F.col("weight") == weight)).groupBy("key").agg(
                F.map_from_entries(F.collect_list(F.struct("place", "value"))).alias(name)  # one for each language
            )
            found = found.withColumn("key", key).join(values, "key", "left").drop("key")

    def chance(place: Column) -> Column:
        ways, left = [], F.lit(0.0).cast("float")
        for n in range(ORDER, 0, -1):
            ways.append(left + F.element_at(f"p{n}", place))
            left = left + F.coalesce(F.element_at(f"b{n}", place), F.lit(0.0).cast("float"))
        return F.coalesce(*ways, left + F.lit(model.uniform).cast("float"))

    places = F.sequence(F.lit(0), F.lit(len(model.languages) - 1))
    return found.select("gram", F.transform(places, chance).alias("chances"))


def met_by_joins(docs: DataFrame, model: LanguageModel, finish: Finish, schema: str) -> DataFrame:
    """``_scored`` for models of any size: no task holds more of them than the grams of one block.

    Documents are written in blocks of about ``BLOCK`` bytes of text (a longer text alone).  The distinct grams
    of each block meet the tables by joins, so a frequent gram is one row for each block, and come back to
    the block's documents.
    """
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema)
    columns = docs.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, size = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                if size >= BLOCK:
                    at, size = at + 1, 0
                size += part.column("text").nbytes
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array([at] * part.num_rows, pa.int64())], names=[*columns, "_block"]
                )

    def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                of_block: dict[int, list[np.ndarray]] = {}
                for block, text in zip(part.column("_block").to_pylist(), part.column("text").to_pylist()):
                    found = symbols(text)
                    if found.size:
                        of_block.setdefault(block, []).append(np.unique(grams(found)))
                for block, found in of_block.items():
                    every = np.unique(np.concatenate(found)).view(np.int64)
                    for begin in range(0, len(every), SENT):
                        some = every[begin : begin + SENT]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([block] * len(some), pa.int64()), pa.array(some)], names=["_block", "gram"]
                        )

    known = model.for_tasks()

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        keys = right.column("gram").to_numpy().view(np.uint64)
        order = np.argsort(keys)
        keys = keys[order]
        values = right.column("chances").combine_chunks().flatten().to_numpy()
        values = values.reshape(len(keys), len(known.languages))[order]
        chances = [lambda some, n=n: values[np.searchsorted(keys, some), n] for n in range(len(known.languages))]
        out = []
        for batch in left.select(columns).combine_chunks().to_batches():
            for part in slices(batch, "text", SLICE):
                out.append(finish(part, *entropies(part.column("text").to_pylist(), chances), known))
        return pa.Table.from_batches(out)

    blocks = materialize(docs.mapInArrow(cut, kinds + "_block long"), "blocks")
    wanted = blocks.select("_block", "text").mapInArrow(needed, "_block long, gram long").distinct()
    wanted = materialize(wanted, "wanted")
    scores = materialize(gram_scores(wanted, model), "scores")
    back = wanted.join(scores, "gram").select("_block", "gram", "chances")
    return blocks.groupBy("_block").cogroup(back.groupBy("_block")).applyInArrow(score, schema)


def calibration(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """(lang, own, other): entropy of known texts of SHORT symbols or more, see ``fit``."""
    place = {lang: n for n, lang in enumerate(model.languages)}

    def finish(part: pa.RecordBatch, found: np.ndarray, sizes: np.ndarray, known: LanguageModel) -> pa.RecordBatch:
        rows = [
            (lang, each[place[lang]], min(np.delete(each, place[lang]), default=-known.uniform))
            for lang, each, size in zip(part.column("lang").to_pylist(), found, sizes)
            if size >= SHORT and lang in place
        ]
        names, own, other = zip(*rows) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array(own, pa.float64()), pa.array(other, pa.float64())],
            names=["lang", "own", "other"],
        )

    return _scored(docs.select("lang", "text"), model, finish, "lang string, own double, other double")


def judge(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """Adds to ``docs`` (text): lang_pred, lang_score, entropy, symbols, rejected.

    The language with the least cross-entropy per symbol is chosen, the first by name of equals.
    The score is its share of the likelihoods of (at most 40 symbols of) the text, from 0 to 1.
    ``rejected`` marks a text that its best language gives an entropy beyond the calibrated limit.
    Null texts and texts without letters are ``und`` with score 0, no entropy, and rejected; so is
    any text if no language was learned.  Columns of ``docs`` with the names of the added ones are
    left out.
    """
    added = ("lang_pred", "lang_score", "entropy", "symbols", "rejected")
    columns = [c for c in docs.columns if c.lower() not in (*added, "_block")]
    docs = docs.select(*columns)

    def finish(part: pa.RecordBatch, found: np.ndarray, sizes: np.ndarray, known: LanguageModel) -> pa.RecordBatch:
        out: list[tuple] = []
        for each, size in zip(found, sizes.tolist()):
            if not size or not len(each):
                out.append((UNDETERMINED, 0.0, None, size, True))
                continue
            best = int(np.argmin(each))
            likely = np.exp((each[best] - each) * min(size, 40))
            name = known.languages[best]
            beyond = bool(known.rejected(name, each[best], size))
            out.append((name, float(1 / likely.sum()), float(each[best]), size, beyond))
        kinds = (pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.bool_())
        new = [pa.array(values, kind) for values, kind in zip(zip(*out), kinds)]
        return pa.RecordBatch.from_arrays([*part.columns, *new], names=[*columns, *added])

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema)
    return _scored(
        docs, model, finish, kinds + "lang_pred string, lang_score double, entropy double, symbols long, rejected boolean"
    )


def predict(docs: DataFrame) -> DataFrame:
    """Learns from the rows whose crc32(doc_id) mod 4 is not 2 and judges all: see ``judge``."""
    held_out = pmod_of_id(4) == 2
    model = fit(docs, learned=~held_out)
    judged = judge(docs.select("doc_id", "text"), model)
    return judged.select(
        "doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"),
        "entropy", "rejected",
    )
