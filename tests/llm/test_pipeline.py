import random
import re

import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402

from .conftest import LANGUAGES, invented  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(12)
    rows = []
    for n in range(160):
        lang = sorted(LANGUAGES)[n % 3]
        text = invented(rng, rng.randint(30, 90), LANGUAGES[lang])
        if n % 10 == 0:
            text += f' token = "{rng.getrandbits(160):040x}" and ' + invented(rng, 5, LANGUAGES[lang])
        if n % 10 == 1:
            text += f" {rng.randrange(10**15, 10**16)} thaedingerontheandingeding"
        rows.append((n, text, lang, f"s{n % 3}", len(text)))
    copies = [(500 + n, rows[n][1], rows[n][2], "s1", rows[n][4]) for n in range(8)]
    near = []
    for n in range(20, 26):
        words = rows[n][1].split(" ")
        words[-1] = "changed"
        near.append((600 + n, " ".join(words), rows[n][2], "s2", None))
    junk = [(700, None, None, None, None), (701, "", "aa", "s1", 0), (702, "12 ?!", "aa", "s1", 5)]
    folder = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows + copies + near + junk, SCHEMA).write.parquet(str(folder / "documents.parquet"))
    return str(folder), {r[0]: r[1] for r in rows}


def test_stages_by_name():
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "language_id", "simhash_near_dedup", "secret_scan", "source_mixing", "packing",
    ]


def test_each_stage_takes_effect(spark, corpus, tmp_path):
    folder, clean = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = []
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(str(tmp_path / str(n)))
        docs = spark.read.parquet(str(tmp_path / str(n)))
        kept.append(docs)
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = [{r.doc_id for r in frame.collect()} for frame in kept]
    assert ids[0] == set(clean) | {500 + n for n in range(8)} | {600 + n for n in range(20, 26)}
    assert ids[1] == ids[2] == set(clean)
    for r in kept[2].collect():
        assert r.text == re.sub(r'(?<=token = ")[0-9a-f]{40}(?=")', "[SECRET]", clean[r.doc_id])
        assert r.n_chars == len(r.text)
    words = lambda frame: sum(len(r.text.split()) for r in frame.collect())
    assert abs(words(kept[3]) - 1.5 * words(kept[2])) <= 4
    assert ids[4] == ids[3] <= ids[2]
    assert sum(r.length for r in kept[4].collect()) > words(kept[3])


def test_run_gives_the_last_stages_rows(spark, corpus):
    folder, _ = corpus
    found = corpus_pipeline.run(spark, folder)
    assert "sequence_id" in found.columns and found.count() > 100


def test_tables_that_hold_all_texts_or_ids_are_zstd(spark, tmp_path, monkeypatch):
    import pyarrow.parquet as pq

    from tieweave import session

    monkeypatch.setattr(session, "shared_folder", lambda _: str(tmp_path))
    docs = spark.createDataFrame([(n, f"word {n} of it", "aa", "s1", 10) for n in range(20)], SCHEMA)
    corpus_pipeline.near_dedup(spark, docs, "")
    corpus_pipeline.pack_windows(spark, docs, "")
    for label in ("prints", "placed"):
        files = [pq.ParquetFile(f).metadata for f in tmp_path.rglob(f"{label}-*/part-*.parquet")]
        codecs = {m.row_group(0).column(c).compression for m in files if m.num_row_groups for c in range(m.num_columns)}
        assert "ZSTD" in codecs and "SNAPPY" not in codecs
