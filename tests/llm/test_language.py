import math
import random
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pytest

from pyspark.sql import functions as F

from .conftest import LANGUAGES, invented
from tieweave.llm import language


def plain_symbols(text):
    letters = "".join(c if c.isalpha() else " " for c in text.lower())
    return " " * 3 + ("" if letters[0] != " " else " ") + " ".join(letters.split()) + " " if any(map(str.isalpha, text)) else ""


class PlainModel:
    """Interpolated Kneser-Ney by its formulas, over strings."""

    def __init__(self, texts, alphabet):
        self.alphabet = alphabet
        counts = Counter(s[i : i + 4] for s in texts for i in range(len(s) - 3))
        self.levels = [counts]
        for _ in range(3):
            self.levels.append(Counter(g[1:] for g in self.levels[-1]))
        self.levels.reverse()

    def chance(self, gram):
        if not gram:
            return 1 / self.alphabet
        level = self.levels[len(gram) - 1]
        once, twice = (sum(c == n for c in level.values()) for n in (1, 2))
        discount = once / (once + 2 * twice) if once and twice else 0.75
        follow = {g: c for g, c in level.items() if g[:-1] == gram[:-1]}
        lower = self.chance(gram[1:])
        if not follow:
            return lower
        total = sum(follow.values())
        return max(level.get(gram, 0) - discount, 0) / total + discount * len(follow) / total * lower

    def entropy(self, s):
        return -sum(math.log(self.chance(s[i : i + 4])) for i in range(len(s) - 3)) / (len(s) - 3)


def as_text(found):
    return "".join(chr(int(c)) for c in found)


def test_symbols():
    assert as_text(language.symbols("Ab, c!!\nDé1x")) == "   ab c dé x "
    assert language.symbols("12 !?").size == 0 and language.symbols(None).size == 0 and language.symbols("").size == 0
    assert len(language.symbols("a\U00010400")) == 3 + 2 + 1  # letters beyond 16 bits are folded


def test_entropy_against_the_formulas(spark):
    rng = random.Random(2)
    rows = [(n, invented(rng, 12, LANGUAGES[lang]), lang) for n in range(60) for lang in ("aa", "bb")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(frame)
    checked = {r[0] for r in frame.where(F.floor(F.crc32(F.col("doc_id").cast("string")) / 4) % 32 == 0).collect()}
    texts = {lang: [as_text(language.symbols(t)) for i, t, g in rows if g == lang and i not in checked] for lang in ("aa", "bb")}
    alphabet = len({c for t in texts.values() for s in t for c in s[3:]}) + 1
    probes = [invented(rng, 6, LANGUAGES["aa"]), invented(rng, 6, LANGUAGES["cc"]), "zzz", "and"]
    found, sizes = model.entropies(probes)
    for n, lang in enumerate(model.languages):
        plain = PlainModel(texts[lang], alphabet)
        for probe, own in zip(probes, found):
            assert own[n] == pytest.approx(plain.entropy(as_text(language.symbols(probe))), rel=1e-4)


def many(rng, n, start=0):
    return [
        (start + k, invented(rng, rng.randint(4, 60), LANGUAGES[lang]), lang)
        for k, lang in ((k, rng.choice(sorted(LANGUAGES))) for k in range(n))
    ]


def test_held_out_accuracy_and_rejection(spark):
    rng = random.Random(8)
    rows = many(rng, 800)
    # An alphabet and syllables of no known language.
    rows += [(5000 + n, invented(rng, 40, "жук лод шир яма пет"), None) for n in range(10)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {r.doc_id: r for r in language.predict(frame).collect()}
    held = [r for r in rows if r[2] and found[r[0]].held_out]
    assert len(held) > 100
    assert sum(found[r[0]].lang_pred == r[2] for r in held) >= 0.99 * len(held)
    assert not any(found[r[0]].rejected for r in rows if r[2])
    assert all(found[5000 + n].rejected and found[5000 + n].lang_pred in LANGUAGES for n in range(10))
    assert all(0 <= r.score <= 1 for r in found.values())


def test_odd_rows(docs, rows, clashing):
    found = language.predict(docs).collect()
    assert len(found) == len(rows)
    by_id = defaultdict(list)
    for r in found:
        by_id[r.doc_id].append(r)
    for i in (300, 301, 302, 303):
        assert by_id[i][0].lang_pred == "und" and by_id[i][0].score == 0 and by_id[i][0].rejected
    assert by_id[305][0].lang_pred in LANGUAGES
    assert {r.lang_pred for r in by_id[None]} >= {"und"} and not any(r.held_out for r in by_id[None])
    assert sorted(map(str, language.predict(clashing).collect())) == sorted(map(str, found))


def test_nothing_to_learn(spark, no_docs, docs):
    assert language.predict(no_docs).collect() == []
    found = language.predict(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in found} == {"und"}


def test_rare_grams_and_many_languages_are_kept(spark):
    """40 languages of rare symbols: every gram of every order is in the tables, as the formulas have it."""
    rng = random.Random(40)
    rows, texts = [], defaultdict(list)
    for n in range(40):
        letters = [chr(0x4E00 + 97 * n + k) for k in range(60)]
        for k in range(6):
            text = " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 5))) for _ in range(15))
            rows.append((100 * n + k, text, f"l{n:02}"))
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    checked = {r[0] for r in frame.where(F.floor(F.crc32(F.col("doc_id").cast("string")) / 4) % 32 == 0).collect()}
    for i, text, lang in rows:
        if i not in checked:
            texts[lang].append(as_text(language.symbols(text)))
    model = language.fit(frame)
    assert model.languages == sorted(texts)
    alphabet = len({c for t in texts.values() for s in t for c in s[3:]}) + 1
    probes = [rows[0][1], rows[57][1], "丁 鼠"]
    found, _ = model.entropies(probes)
    for n in (0, 9, 39):
        plain = PlainModel(texts[model.languages[n]], alphabet)
        assert sum(len(level) for level in plain.levels) == sum(len(p.hashes) for p in model.models[n].probability)
        for probe, own in zip(probes, found):
            assert own[n] == pytest.approx(plain.entropy(as_text(language.symbols(probe))), rel=1e-4)


def test_models_too_large_to_hold_give_the_same(spark, docs, rows, monkeypatch):
    held = {str(r.doc_id): r for r in language.predict(docs).collect()}
    monkeypatch.setattr(language, "HELD", 0)
    monkeypatch.setattr(language, "BLOCK", 2000)
    monkeypatch.setattr(language, "SLICE", 1000)
    found = language.predict(docs).collect()
    assert len(found) == len(rows)
    for r in found:
        if r.doc_id is None:
            continue
        other = held[str(r.doc_id)]
        assert (r.lang_pred, r.held_out, r.rejected) == (other.lang_pred, other.held_out, other.rejected)
        assert r.score == pytest.approx(other.score, abs=1e-4)
        assert r.entropy is None and other.entropy is None or r.entropy == pytest.approx(other.entropy, rel=1e-5)


def test_a_large_model_of_nothing(spark, no_docs, monkeypatch):
    monkeypatch.setattr(language, "HELD", 0)
    assert language.predict(no_docs).collect() == []


def test_small_tables_reject_too(spark):
    rng = random.Random(21)
    rows = [(n, invented(rng, 40, LANGUAGES[sorted(LANGUAGES)[n % 3]]), sorted(LANGUAGES)[n % 3]) for n in range(60)]
    rows += [(200 + n, invented(rng, 40, "wij oe aar"), "dd") for n in range(3)]  # pooled
    junk = [(5000 + n, invented(rng, 40, "жук лод шир яма пет"), None) for n in range(10)]
    frame = spark.createDataFrame(rows + junk, "doc_id long, text string, lang string")
    assert set(language.fit(frame).limits) == {"aa", "bb", "cc", "dd"}
    found = {r.doc_id: r for r in language.predict(frame).collect()}
    print("junk rejected", sum(found[r[0]].rejected for r in junk), "known", sum(found[r[0]].rejected for r in rows))
    assert all(found[r[0]].rejected for r in junk)
    assert not any(found[r[0]].rejected for r in rows if r[2] != "dd")


def test_tables_come_to_the_driver_as_columns(spark):
    """Rows of Python objects took several hundred bytes an entry."""
    entries = 200_000
    tables = spark.range(entries).select(
        F.lit("x").alias("lang"), F.lit(language.ORDER).alias("n"), F.lit(False).alias("weight"), F.col("id").alias("key"),
        (-F.col("id") / entries).cast("float").alias("value"),
    )
    tracemalloc.start()
    try:
        model = language._model(["x"], tables, -1.0)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 100 * entries
    found = model.models[0].log_probability(np.arange(0, entries, 1000, dtype=np.uint64))
    assert found == pytest.approx(-np.arange(0, entries, 1000) / entries, abs=1e-6)
