import hashlib
import re
from collections import defaultdict

import pytest

from pyspark.sql import functions as F

from tieweave.llm import mixing


def plain_mix(rows):
    """Targets by filling up round after round; words along the order of the hashes."""
    sized = []
    for doc_id, text, _, source, _ in rows:
        size = len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        key = "|".join(["" if x is None else str(x) for x in (doc_id, source, text)])
        sized.append((source, hashlib.md5(key.encode()).hexdigest(), -1 if doc_id is None else doc_id, size))
    totals = defaultdict(int)
    for source, _, _, size in sized:
        totals[source] += size
    names = sorted(totals, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[n % 3] for n, s in enumerate(names)}
    target, open_ = {}, set(names)
    while True:
        left = 1.5 * sum(totals.values()) - sum(target.values())
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        full = {s for s in open_ if share[s] >= 2 * totals[s]}
        if not full:
            target |= share
            break
        target |= {s: 2.0 * totals[s] for s in full}
        open_ -= full
        if not open_:
            break
    taken = {s: 0 for s in names}
    for source, *_ in sized:
        pass
    out = []
    for name in names:
        at = 0
        for _, _, doc_id, size in sorted(x for x in sized if x[0] == name):
            words = sum(max(0, min(size, int(target[name]) - (at + c * totals[name]))) for c in (0, 1))
            out.append((doc_id, size, totals[name], round(target[name], 6), words))
            at += size
    return sorted(out)


def flat(found):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in found)


def test_mix_against_the_plain_way(docs, rows, clashing):
    assert flat(mixing.mix(docs).collect()) == plain_mix(rows)
    assert flat(mixing.mix(clashing).collect()) == plain_mix(rows)


def test_targets_are_met_and_no_document_is_over(docs):
    found = mixing.mix(docs).collect()
    assert all(0 <= r.taken <= 2 * r.size for r in found)
    by_target = defaultdict(int)
    for r in found:
        by_target[r.target] += r.taken
    assert all(abs(words - target) < 1 for target, words in by_target.items())


def test_training_time_inverts_the_integral(spark):
    for begin, end in ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5), (2.0, 0.0)):
        shares = [n / 20 for n in range(21)]
        frame = spark.createDataFrame([(s,) for s in shares], "share double")
        times = [r[0] for r in frame.select(mixing.training_time(F.col("share"), F.lit(begin), F.lit(end))).collect()]
        for share, t in zip(shares, times):
            assert 0 <= t <= 1 + 1e-9
            assert (begin * t + (end - begin) * t * t / 2) / ((begin + end) / 2) == pytest.approx(share, abs=1e-9)


def test_heavy_sources_come_early(spark):
    rows = [(n, "w " * 10, "aa", f"s{n % 3}", 20) for n in range(300)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    found = [r.source for r in mixing.mixed_documents(frame).collect()]
    early, late = found[: len(found) // 2], found[len(found) // 2 :]
    assert early.count("s0") > late.count("s0") and early.count("s2") < late.count("s2")


def test_mixed_documents_hold_the_words_taken(docs, clashing, rows):
    wanted = {}
    for r in mixing.mix(docs).collect():
        wanted[r.doc_id] = wanted.get(r.doc_id, 0) + r.taken
    got = defaultdict(int)
    for r in mixing.mixed_documents(docs).collect():
        got[r.doc_id] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
        assert r.n_chars is None or r.n_chars == len(r.text) or r.n_chars in [x[4] for x in rows]
    assert dict(got) == {i: n for i, n in wanted.items() if n}
    assert mixing.mixed_documents(clashing).columns == clashing.columns
    assert mixing.mixed_documents(clashing).count() == mixing.mixed_documents(docs).count()


def test_nothing(spark, no_docs):
    assert mixing.mix(no_docs).collect() == []
    assert mixing.mixed_documents(no_docs).collect() == []
    empty = spark.createDataFrame([(1, None, "aa", "s", 0), (2, " ", "aa", None, 1)], no_docs.schema)
    assert [(r.size, r.taken) for r in mixing.mix(empty).collect()] == [(0, 0), (0, 0)]
