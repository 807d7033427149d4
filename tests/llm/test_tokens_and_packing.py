import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from tieweave.llm import packing, tokens  # noqa: E402
from tieweave.llm.encoder import definition, encoder  # noqa: E402

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def whole():
    """Ids of a whole text, encoded at once."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(VOCABULARY)
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids + [0]


def crc(ids):
    return zlib.crc32(np.asarray(ids, dtype="<u4").tobytes())


def test_parts_give_the_ids_of_the_whole_text(whole, rows):
    odd = [
        "don't, we'll  'tis x…!y, a²,b  \n\n  tail  ", "   ", "a b ,c\t\tx  .", "éà,ß's don't!?'re 12,3x", "日本語,テスト 。",
        "<|endoftext|> x<|endoftext|>", "a b   c", "x" * 5000, " ,.,  ;", "é,x", "ⅣX,y ª,b º!",
    ]
    texts = odd + [r[1] for r in rows]
    found = encoder(definition(VOCABULARY)).encode(texts, 0)
    assert [np.frombuffer(f, dtype="<u4").tolist() for f in found] == [whole(t) for t in texts]


def test_ids_of_random_texts_are_the_untouched_tokenizers(whole):
    rng = random.Random(12)
    signs = [
        " ", " ", "  ", "\u00a0", "\u2003", "\u3000", "\u2028", "\u200b", "\u180e", "\x85", "\x1c", "\t", "\n", "\r\n", "\x0b", "\ufeff",
        "a", "word", "Été", "ß", "日本", "e\u0301", "9", "²", "Ⅳ", ".", "!?", "'s", "'", "’t", "…", "-", "|>", "<|", "<|endoftext|>", "🙂", "\x00",
    ]
    texts = ["".join(rng.choices(signs, k=rng.randint(1, 12))) for _ in range(20_000)] + ["a \u00a0 \u00a0"]
    found = encoder(definition(VOCABULARY)).encode(texts, 0)
    wrong = [t for t, f in zip(texts, found) if np.frombuffer(f, dtype="<u4").tolist() != whole(t)]
    assert wrong == []


def test_parts_are_forgotten_without_harm(whole, monkeypatch):
    from tieweave.llm import encoder as module

    monkeypatch.setattr(module, "KEPT_PARTS", 3)
    codec = module.Encoder(definition(VOCABULARY))
    for text in ("one two three four", "five two six", "one seven, two", "eight nine ten one"):
        assert np.frombuffer(codec.encode([text], 0)[0], dtype="<u4").tolist() == whole(text)
    assert len(codec.known) < 10


def test_encoders_go_when_workers_run_other_tasks(spark, docs):
    import pyarrow as pa

    from tieweave.llm import encoder as module

    def held(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(module._encoders)] * len(batch), pa.int64())], names=["n"])

    packing.pack(docs, VOCABULARY).count()
    other = spark.range(0, 64, 1, 8).mapInArrow(held, "n long").distinct().collect()
    assert [r.n for r in other] == [0]


def test_a_task_told_to_hold_less_gives_the_same_rows(spark, docs):
    every = lambda **less: sorted(packing.pack(docs, VOCABULARY, capacity=64, **less).collect(), key=str)
    assert every(slice_bytes=100, kept_parts=5) == every()


def test_new_parts_are_encoded_in_few_texts():
    from tieweave.llm.encoder import Encoder

    codec = Encoder(definition(VOCABULARY))
    tokenizer, texts = codec.tokenizer, []

    class Counted:
        def encode_batch_fast(self, some, **options):
            texts.extend(some)
            return tokenizer.encode_batch_fast(some, **options)

    codec.tokenizer = Counted()
    special = codec.special[0]
    given = [" ".join(f"wort{n}é x{n}," for n in range(1000)), f"a{special} {special}b", special, "x\x85y", "", "\n \t"]
    for codec.between in (codec.between, None):
        codec.known.clear()
        texts.clear()
        found = codec.encode(given, 0)
        plain = [tokenizer.encode(text, add_special_tokens=False).ids + [0] for text in given]
        assert [np.frombuffer(ids, "<u4").tolist() for ids in found] == plain
        assert len(texts) < 20 if codec.between else len(texts) > 2000


def check_packing(pieces, texts, whole, capacity):
    """Pieces cover each document once, sequences are gapless, and what is not full is a power of two."""
    sequences = defaultdict(list)
    covered = defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append((p.offset, p.length))
        covered[p.doc_id, p.doc_tokens].append((p.start, p.length, p.ids_crc32))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end and length > 0
            end += length
        assert end == capacity or end & (end - 1) == 0 and end < capacity
    wanted = defaultdict(list)
    for doc_id, text in texts:
        ids = whole(text)
        wanted[doc_id, len(ids)].append(ids)
    assert covered.keys() == wanted.keys()
    for key, lists in wanted.items():
        assert sum(length for _, length, _ in covered[key]) == key[1] * len(lists)
        for start, length, crc32 in covered[key]:
            assert crc32 in {crc(ids[start : start + length]) for ids in lists}
    return sequences


@pytest.mark.parametrize("capacity", [16, 1024])
def test_packing_keeps_every_id(docs, rows, whole, capacity):
    pieces = packing.pack(docs, VOCABULARY, capacity=capacity, with_ids=False).collect()
    check_packing(pieces, [(r[0], r[1]) for r in rows], whole, capacity)


def test_packing_again_gives_the_same_rows(docs, clashing):
    first = packing.pack(docs, VOCABULARY, 64).collect()
    assert sorted(map(str, first)) == sorted(map(str, packing.pack(clashing, VOCABULARY, 64).collect()))
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in first)


def test_packing_nothing(no_docs):
    assert packing.pack(no_docs, VOCABULARY).collect() == []


def plain_best(counts, size, capacity):
    """The level with the least sum of squares afterwards, by trying all."""
    best = None
    for level in range(capacity - size + 1):
        if level and not counts[level]:
            continue
        after = list(counts)
        if level:
            after[level] -= 1
        if level + size < capacity:
            after[level + size] += 1
        total = sum(c * c for c in after[1:capacity])
        if best is None or total <= best[0]:
            best = (total, level)
    return best[1]


def test_level_is_the_one_of_least_squares():
    rng = np.random.default_rng(5)
    packer = packing.Packer(12)
    for size in rng.integers(1, 12, 400):
        assert packer.best_level(int(size)) == plain_best(packer.counts.tolist(), int(size), 12)
        packer.add(1, b"\0\0\0\0" * int(size))


def test_held_windows_are_bounded_and_levels_stay_the_same():
    rng = np.random.default_rng(6)
    sizes = [6] * 200 + [int(n) for n in rng.integers(1, 10, 300)] + [4] * 80  # six tokens never fit beside six
    free = packing.Packer(10, most_held=10**9)
    for n, size in enumerate(sizes):
        free.add(n, np.full(size, n, "<u4").tobytes())
    packer, out = packing.Packer(10, most_held=5), []
    for n, size in enumerate(sizes):
        out += packer.add(n, np.full(size, n, "<u4").tobytes())
        assert packer.held <= 5
    assert packer.counts.tolist() == free.counts.tolist()  # what is held changes no choice
    out += packer.close()
    assert sum(r[2] for r in out) == sum(sizes)
    filled = defaultdict(list)
    for r in out:
        filled[r[5], r[8]].append((r[6], r[2]))
    assert sum(pending for _, pending in filled) > 100
    for (_, pending), parts in filled.items():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 10 and (pending or end == 10 or end & (end - 1) == 0)


@pytest.mark.parametrize("with_ids", [False, True])
def test_windows_let_go_are_settled(spark, whole, monkeypatch, with_ids):
    monkeypatch.setattr(packing, "HELD_WINDOWS", 3)
    rows = [(n, "word " * (n % 3 + 9)) for n in range(300)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    pieces = packing.pack(frame, VOCABULARY, capacity=16, with_ids=with_ids).collect()
    sequences = check_packing(pieces, rows, whole, 16)
    assert any(p.sequence_id >= 1 << 62 for p in pieces)
    assert sum(length for parts in sequences.values() for _, length in parts) > 0.95 * 16 * len(sequences)
    if with_ids:
        assert all(zlib.crc32(p.ids) == p.ids_crc32 for p in pieces)


def test_token_files_round_trip(spark, docs, rows, whole, clashing):
    path = tokens.token_files(clashing, VOCABULARY)
    read = tokens.read_tokens(spark, path).collect()
    assert sorted((str(r.doc_id), r.ids) for r in read) == sorted((str(r[0]), whole(r[1])) for r in rows)
    found = tokens.token_digest(spark, path).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in found) == sorted(
        (str(r[0]), len(whole(r[1])), crc(whole(r[1]))) for r in rows
    )
    start = 0
    for r in sorted(found, key=lambda r: r.start):
        assert r.start == start
        start += r.n_tokens
    ids = [r.doc_id for r in sorted(found, key=lambda r: r.start)]
    assert ids == sorted(ids, key=lambda i: (i is not None, i))


def test_token_files_are_pruned_by_id(spark, docs):
    path = tokens.token_files(docs, VOCABULARY)
    one = tokens.read_tokens(spark, path).where("doc_id = 305")
    assert one.count() == 1
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,305)]" in one._jdf.queryExecution().toString()


def test_token_files_of_nothing(spark, no_docs):
    assert tokens.token_digest(spark, tokens.token_files(no_docs, VOCABULARY)).collect() == []
