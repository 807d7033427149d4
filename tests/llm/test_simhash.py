import random
import re
from itertools import combinations

import numpy as np
import pytest

xxhash = pytest.importorskip("xxhash")

from tieweave.llm import simhash  # noqa: E402
from tieweave.llm.components import components  # noqa: E402


def plain_shingles(text, k):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return []
    return [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]


def plain_print(text, k):
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in plain_shingles(text, k)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(nodes, linked):
    root = {n: n for n in nodes}

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in combinations(nodes, 2):
        if linked(a, b):
            root[top(a)] = top(b)
    return {n: top(n) for n in nodes}


def test_classes_against_brute_force(docs, rows):
    found = simhash.near_classes(docs, words=3, radius=2).collect()
    prints = {i: plain_print(r[1], 3) for i, r in enumerate(rows)}
    top = plain_components(range(len(rows)), lambda a, b: bin(prints[a] ^ prints[b]).count("1") <= 2)
    smallest = {}
    for i, root in top.items():
        ids = [rows[j][0] for j in top if top[j] == root and rows[j][0] is not None]
        smallest[i] = min(ids, default=None)
    wanted = sorted((str(rows[i][0]), f"{prints[i]:016x}", str(smallest[i])) for i in prints)
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in found) == wanted


def test_fingerprint_equals_sparks_hash(spark):
    from pyspark.sql import functions as F

    text = "One two\tthree"
    assert spark.range(1).select(F.xxhash64(F.lit("one two three"))).first()[0] == np.uint64(plain_print(text, 3)).astype(np.int64)
    assert simhash.simhash(simhash.shingle_hashes(text, 3)) == plain_print(text, 3)


@pytest.mark.parametrize("radius,segments", [(2, 4), (13, 1), (0, 2)])
def test_links_join_what_all_pairs_join(spark, monkeypatch, radius, segments):
    rng = random.Random(radius)
    monkeypatch.setattr(simhash, "TILE", 16)
    seeds = [rng.getrandbits(64) for _ in range(40)]
    points = set(seeds)
    for seed in seeds[:12]:
        for _ in range(25):
            bits = rng.sample(range(64), rng.randint(0, radius + 2))
            points.add(seed ^ sum(1 << b for b in bits))
    signed = [p - (1 << 64) if p >> 63 else p for p in points]
    frame = spark.createDataFrame([(p, 0) for p in signed], "print long, bucket int")
    found = simhash.links(frame, radius, segments).collect()
    for r in found:
        assert r.bits == bin((r.a ^ r.b) & (2**64 - 1)).count("1") <= radius
    pairs = {frozenset((r.a, r.b)) for r in found}
    mine = plain_components(signed, lambda a, b: frozenset((a, b)) in pairs)
    all_ = plain_components(signed, lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1") <= radius)
    groups = lambda top: {frozenset(n for n in top if top[n] == r) for r in top.values()}
    assert groups(mine) == groups(all_)


def test_links_of_a_large_group_are_few(spark):
    rng = random.Random(1)
    base = rng.getrandbits(60)
    points = list({base ^ (1 << a) ^ (1 << b) for a in range(60) for b in range(60)})
    frame = spark.createDataFrame([(p, 0) for p in points], "print long, bucket int")
    found = simhash.links(frame, 4, 1)
    assert found.count() < 10 * len(points)  # all pairs: 1.5 million
    assert components(found.select("a", "b")).select("root").distinct().count() == 1


def test_near_copies_against_brute_force(docs, rows, clashing):
    rng = random.Random(9)
    more = []
    for n in range(12):  # copies with some words changed
        words = rows[n][1].split() + rows[20 + n][1].split()
        more.append((1000 + 10 * n, " ".join(words), "aa", "s", None))
        for k in range(1, 4):
            changed = list(words)
            for _ in range(k):
                changed[rng.randrange(len(changed))] = "changed"
            more.append((1000 + 10 * n + k, " ".join(changed), "aa", "s", None))
    spark = docs.sparkSession
    frame = spark.createDataFrame(rows + more, docs.schema)
    kept = simhash.near_copies_removed(frame).collect()
    every = rows + more
    sets = [frozenset(plain_shingles(r[1], 5)) for r in every]
    wordings = [" ".join(plain_shingles(r[1], 1)) for r in every]

    def linked(a, b):
        if wordings[a] == wordings[b]:
            return True
        union = len(sets[a] | sets[b])
        alike = bool(union) and len(sets[a] & sets[b]) >= 0.8 * union
        return alike and bin(plain_print(every[a][1], 5) ^ plain_print(every[b][1], 5)).count("1") <= 13

    top = plain_components(range(len(every)), linked)
    groups = {}
    for i, root in top.items():
        groups.setdefault(root, []).append(i)
    wanted = sorted(
        str(min((every[i][0] is None, every[i][0] or 0) for i in g)[1] if any(every[i][0] is not None for i in g) else None)
        for g in groups.values()
    )
    assert sorted(str(r.doc_id) for r in kept) == wanted
    found = simhash.near_copies_removed(clashing)
    assert found.columns == clashing.columns and len(found.collect()) > 0


def test_nothing(no_docs):
    assert simhash.near_classes(no_docs).collect() == []
    assert simhash.near_copies_removed(no_docs).collect() == []


def test_components_of_a_chain_and_a_star(spark):
    chain = [(n, n + 1) for n in range(300)] + [(2000, n) for n in range(1000, 1200)] + [(5, 5), (None, 3)]
    found = components(spark.createDataFrame(chain, "a long, b long")).collect()
    roots = {r.node: r.root for r in found}
    assert len(roots) == 301 + 201
    assert len({roots[n] for n in range(301)}) == 1
    assert len({roots[n] for n in [2000, *range(1000, 1200)]}) == 1
    assert roots[0] != roots[2000]


def passage_rows(rng, shared, own, changed, pairs):
    """Pairs of near copies that all hold one passage; ids n and 1000 + n."""
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    passage = [word() for _ in range(shared)]
    rows = []
    for n in range(pairs):
        mine = [word() for _ in range(own)]
        other = mine[: own - changed] + [word() for _ in range(changed)]
        rows += [(n, " ".join(passage + mine)), (1000 + n, " ".join(passage + other))]
    return rows


def test_near_copies_among_texts_that_share_a_passage(spark):
    for shared in (120, 140):  # of 200 words
        rows = passage_rows(random.Random(shared), shared, 200 - shared, 16, 150)
        prints = {i: simhash.simhash(simhash.shingle_hashes(t, 5)) for i, t in rows}
        within = {n for n in range(150) if (prints[n] ^ prints[1000 + n]).bit_count() <= 13}
        kept = {r.doc_id for r in simhash.near_copies_removed(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        print("shared", shared, "pairs", len(within), "found", sum(1000 + n not in kept for n in within))
        assert kept >= set(range(150)) and not any(1000 + n in kept for n in within)


def test_every_wording_of_a_fingerprint_stands_for_itself(spark, monkeypatch):
    """One fingerprint for all: what tells documents apart is their sets alone."""
    monkeypatch.setattr(simhash, "simhash", lambda hashes: 7)
    rows = passage_rows(random.Random(4), 0, 100, 4, 40)
    kept = {r.doc_id for r in simhash.near_copies_removed(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    print("pairs 40 found", sum(1000 + n not in kept for n in range(40)))
    assert kept == set(range(40))


def planted_copies(rng, lengths, each):
    """Pairs whose copy has words of its own at an end, so that J is 0.8 or a little more."""
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    rows, size = [], {}
    for length in lengths:
        for _ in range(each):
            n = len(size)
            mine = [word() for _ in range(length + 4)]
            size[n] = length
            # length of n + c shingles, all n of them shared
            rows += [(n, " ".join(mine)), (100_000 + n, " ".join(mine + [word() for _ in range(length // 4)]))]
    return rows, size


def recall(spark, rows, size):
    kept = {r.doc_id for r in simhash.near_copies_removed(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept >= set(size)
    found = {}
    for n, length in size.items():
        found.setdefault(length, []).append(100_000 + n not in kept)
    return {length: sum(x) / len(x) for length, x in found.items()}


def test_recall_against_plain_jaccard(spark):
    rows, size = planted_copies(random.Random(6), (4, 8, 16, 32, 64, 128, 512), 150)
    texts = dict(rows)
    for n in size:
        a, b = (set(plain_shingles(texts[i], 5)) for i in (n, 100_000 + n))
        assert len(a & b) >= 0.8 * len(a | b)
    found = recall(spark, rows, size)
    print("recall", found)
    assert all(found[length] == 1 for length in (4, 8, 16, 32, 64))
    assert all(share > 0.8 for share in found.values())


def test_recall_above_the_few(spark):
    found = recall(spark, *planted_copies(random.Random(68), (68, 80, 96, 128, 512, 1024), 150))
    print("recall", found)
    assert all(share >= 0.98 for share in found.values())


def test_a_repeated_line_changes_no_likeness(spark):
    rng = random.Random(7)
    rows = []
    for n in range(20):
        words = [f"w{rng.randrange(10**6)}" for _ in range(100)]
        rows += [(n, " ".join(words)), (1000 + n, " ".join(words + words[:12] * 60))]
    kept = {r.doc_id for r in simhash.near_copies_removed(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    print("repeated 20 found", sum(1000 + n not in kept for n in range(20)))
    assert kept == set(range(20))
