"""Conversation repair, spelling variants and MinHash near-dedup beside brute force, and on odd input."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tieweave.llm import conversations as C
from tieweave.llm import minhash as M
from tieweave.llm import spelling as S

TURNS = "conv_id long, turn long, role string, text string"


def plain_repair(rows):
    """Cheapest edits of rows (turn, role, text), by exhausting ways in order of cost and letters."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, marked, counts = set(), [], Counter()
    for _, role, text in rows:
        kept = text.rstrip(C.BLANKS)
        fault = None
        if not kept:
            fault = "blank"
        elif (role, text) in seen:
            fault = "duplicate"
        elif kept[-1] not in ".!?":
            fault = "truncated"
        seen.add((role, text))
        counts[fault] += 1
        marked.append((role, text, fault))
    initials = [r[1][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    ways = {"": (0, "", [])}
    after = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}

    def with_inserts(ways):
        out = dict(ways)
        for _ in range(2):
            for state, (cost, letters, body) in list(out.items()):
                nxt = "a" if state == "u" else "u"
                new = (cost + 3, letters + "I", body + [("assistant" if nxt == "a" else "user") + ":"])
                if nxt not in out or new[:2] < out[nxt][:2]:
                    out[nxt] = new
        return out

    for role, text, fault in marked:
        new = {}

        def offer(state, way):
            if state not in new or way[:2] < new[state][:2]:
                new[state] = way

        for state, (cost, letters, body) in with_inserts(ways).items():
            offer(state, (cost + 4, letters + "D", body))
            if fault in ("blank", "duplicate"):
                continue
            extra = 3 if fault else 0
            if role[:1] in after[state]:
                offer(role[:1], (cost + extra, letters + "K", body + [f"{role}:{text}"]))
            nxt = "a" if state == "u" else "u"
            offer(nxt, (cost + 3 + extra, letters + "R", body + [("assistant" if nxt == "a" else "user") + f":{text}"]))
        ways = new
    cost, letters, body = min(w[:2] + (w[2],) for s, w in with_inserts(ways).items() if s in ("", "a"))
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    digest = hashlib.sha256("\n".join(body).encode()).hexdigest()
    return gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, letters, digest


def invented_turns(rng, conv, length):
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", "umpire", " "]
    texts = ["Yes.", "No", "", " \t", "Go on!", "well", "Why?", "ok.\n", "a b c."]
    return [(conv, rng.choice([None, n, n, n + 3]), rng.choice(roles), rng.choice(texts)) for n in range(length)]


@pytest.fixture(scope="module")
def turns(spark):
    rng = random.Random(5)
    rows = [row for conv in range(60) for row in invented_turns(rng, conv, rng.randint(1, 14))]
    rows += invented_turns(rng, None, 9) + invented_turns(rng, -4, 300) + [rows[3]] * 5
    rows += [(70, n, "user" if n % 2 else "assistant", f"{n}.") for n in range(400)]
    rows += [(71, n, "tool", f"{n}.") for n in range(301)]  # costs after it never stop mattering
    rows += [(72, 1, "user", "again.")] * 50 + [(73, None, "user", "x" * 200_000)]
    return rows


def judged(frame):
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    return {r["conv_id"]: tuple(r[c] for c in names) for r in frame.collect()}


@pytest.mark.parametrize("bits", [1, 3, 12])
def test_repair_beside_exhausted_ways(spark, turns, bits, monkeypatch):
    monkeypatch.setattr(C, "CHUNK_BITS", bits)
    frame = spark.createDataFrame(turns, TURNS).withColumn("place", F.lit("x")).withColumn("conv", F.lit(1)).repartition(3)
    found = judged(C.audited(frame, frame))
    by_conv = {}
    for conv, turn, role, text in turns:
        by_conv.setdefault(conv, []).append((turn, role, text))
    assert found == {conv: plain_repair(rows) for conv, rows in by_conv.items()}


def test_repaired_turns_are_legal(spark, turns):
    rows = C.repaired(spark.createDataFrame(turns, TURNS)).orderBy("conv_id", "position").collect()
    by_conv = {}
    for r in rows:
        by_conv.setdefault(r["conv_id"], []).append(r)
    for found in by_conv.values():
        assert re.fullmatch("(s?(ua)+)?", "".join(r["role"][0] for r in found))
        assert [r["position"] for r in found] == list(range(len(found)))
        assert all(r["text"] == "" for r in found if r["edit"] == "I")


def test_damage_and_conversations_without_rows(spark):
    rows = [(n, t, "user" if t % 2 == 0 else "assistant", f"Turn {t}. ok!") for n in range(40) for t in range(6)]
    rows += [(None, None, None, None), (41, None, "system", None)]
    damaged = C.damaged(spark.createDataFrame(rows, TURNS)).collect()
    expected = []
    for conv, turn, role, text in rows:
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = role or " ", text or " "
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        expected += [(conv, turn, "user" if h == 4 else role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
    assert Counter(map(tuple, damaged)) == Counter(expected)
    none = spark.createDataFrame([], TURNS)
    given = spark.createDataFrame([(5,), (None,)], "conv_id long")
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    assert judged(C.audited(none, given)) == {5: empty, None: empty}
    assert C.audited(none, none).count() == 0 and C.repaired(none).count() == 0


def test_corrected_run_equals_a_whole_one():
    rng = random.Random(1)
    for _ in range(300):
        symbols = [rng.randrange(12) for _ in range(rng.randint(0, 30))]
        one, two = (C.costs_before([rng.randrange(12) for _ in range(3)], C.END)[0] for _ in range(2))
        found, taken = C.costs_before(symbols, one)
        assert C.corrected(symbols, one, two, found, taken + 7) == (C.costs_before(symbols, two)[0], C.costs_before(symbols, two)[1] + 7)


def plain_runs(rows):
    counts = Counter()
    for doc_id, text in rows:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for run in re.findall("[a-zÀ-ÿ]+", text):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_variants(counts, times=10):
    out = {}
    for word, n in counts.items():
        near = sorted(((-m, w) for w, m in counts.items() if one_edit(w, word)))
        form = near[0][1] if near and -near[0][0] >= times * n else None
        out[word] = [form, None, n, len(near), counts[form] if form else None]
    for word, row in out.items():
        root = word
        while out[root][0]:
            root = out[root][0]
        row[1] = root
    return {w: tuple(r) for w, r in out.items()}


def variants(frame):
    return {r["word"]: tuple(r[c] for c in ("form", "root", "n", "n_near", "form_n")) for r in frame.collect()}


@pytest.mark.parametrize("leaf, block", [(16, 8192), (4, 16)])
def test_variants_beside_brute_force(spark, docs, rows, leaf, block, monkeypatch):
    monkeypatch.setattr(S, "LEAF", leaf)
    monkeypatch.setattr(S, "BLOCK", block)
    rng = random.Random(2)
    base = ["commonly", "variants", "ÿéàsùîûô", "groupings", "elements"]
    texts = []
    for n in range(600):
        word = rng.choice(base)
        if rng.random() < 0.2:
            at = rng.randrange(len(word))
            word = word[:at] + rng.choice(["", "x", word[at] * 2]) + word[at + 1 :]
        texts.append((1000 + n, word.upper() if n % 7 == 0 and word.isascii() else word))
    texts += [(1, "stop" + "p" * 3000), (2, "stop" + "p" * 3001), (3, "stop" + "p" * 3000), (4, "stop" + "p" * 3001)]
    texts += [(r[0], r[1]) for r in rows]
    frame = spark.createDataFrame(texts, "doc_id long, text string").withColumn("word", F.lit("x")).withColumn("n", F.lit(1))
    assert variants(S.spelling_variants(frame)) == plain_variants(plain_runs(texts))


def test_anagrams_and_chains(spark):
    rng = random.Random(4)
    letters = "abcdefgh"
    anagrams = {"".join(rng.sample(letters, 8)): 2 for _ in range(300)}
    words = {**anagrams, "abcdefgx": 20, "abcdefg": 300, "abcdef": 4000, "bbcdefg": 300}
    frame = spark.createDataFrame(list(words.items()), "word string, n long")
    assert variants(S.grouped(frame)) == plain_variants(words)
    assert S.grouped(frame.limit(0)).count() == 0


def test_spelling_without_words(spark, no_docs):
    assert S.spelling_variants(no_docs).count() == 0


def plain_sets(rows, words):
    out = []
    for doc_id, text in rows:
        found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        cut = [" ".join(found)] if 0 < len(found) < words else [" ".join(found[i : i + words]) for i in range(len(found) - words + 1)]
        out.append((doc_id, set(cut)))
    return out


def plain_components(rows, words, percent):
    sets = plain_sets(rows, words)
    root = list(range(len(sets)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(sets)), 2):
        a, b = sets[i][1], sets[j][1]
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            root[top(i)] = top(j)
    least = {}
    for i, (doc_id, _) in enumerate(sets):
        least.setdefault(top(i), []).append(doc_id)
    out = Counter()
    for i, (doc_id, s) in enumerate(sets):
        ids = [x for x in least[top(i)] if x is not None]
        id_ = min(ids) if ids else None
        out[(doc_id, len(s), id_, doc_id == id_)] += 1
    return out


def edited(rng, text, edits):
    words = text.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = rng.choice(["neu", "other", "ces"])
    return " ".join(words)


def near_rows(rng, rows):
    passage = " ".join(f"passage{k}" for k in range(60))
    out = [(r[0], r[1]) for r in rows]
    original = " ".join(f"w{rng.randrange(400)}" for _ in range(150))
    # A group whose members are nearer to the original than to each other, and texts that share a passage.
    out += [(2000 + n, edited(rng, original, rng.randint(0, 5))) for n in range(120)]
    out += [(3000 + n, passage + " " + " ".join(f"x{n}y{k}" for k in range(rng.choice([8, 12, 40])))) for n in range(60)]
    out += [(4000 + n, " ".join(f"s{k}" for k in range(n % 9))) for n in range(40)]
    return out


@pytest.mark.parametrize("block", [256, 4])
def test_near_duplicates_beside_brute_force(spark, rows, block, monkeypatch):
    monkeypatch.setattr(M, "BLOCK", block)
    texts = near_rows(random.Random(6), rows)
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    frame = frame.select("*", *[F.lit("x").alias(c) for c in ("node", "key", "print", "n", "class")]).repartition(5)
    found = M.near_duplicates(frame)
    assert found.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert Counter(map(tuple, found.collect())) == plain_components(texts, 3, 85)


def test_near_duplicates_without_rows(spark, no_docs):
    assert M.near_duplicates(no_docs).count() == 0


@pytest.mark.parametrize("size", [4, 12, 40, 200, 2000])
def test_tables_meet_pairs_just_above_the_limit(size):
    rng = np.random.default_rng(size)
    missed = 0
    for _ in range(300):
        # The least number of common shingles that is a link.
        common = -(-85 * 2 * size // 185)
        base = rng.integers(0, 1 << 63, 2 * size - common, dtype=np.uint64)
        a, b = np.unique(base[:size]), np.unique(base[size - common :])
        assert M.linked(a, b, 85)
        apart = np.bitwise_count(np.frombuffer(M.sketch(a), "<u8") ^ np.frombuffer(M.sketch(b), "<u8")).sum()
        assert M.may_link(np.array([len(a)]), np.array([len(b)]), np.array([apart]), 85)[0]
        keys = [set(M.table_keys(M.collections(x)[None])[0].tolist()) for x in (a, b)]
        missed += not keys[0] & keys[1]
    assert missed == 0
