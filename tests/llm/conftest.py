import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# Names the operators use inside.
EXTRA = ("print", "bucket", "wording", "size", "rank", "score", "group", "slice", "value", "taken", "positions", "_part")


def invented(rng: random.Random, words: int, syllables: str) -> str:
    parts = syllables.split()
    text = []
    for n in range(words):
        word = "".join(rng.choice(parts) for _ in range(rng.randint(1, 3)))
        text.append(word + rng.choice(["", "", "", ",", ".\n", "."]))
    return " ".join(text)


LANGUAGES = {"aa": "tha ing ed on er the and", "bb": "schen über ung ein ach keit", "cc": "ción ado que los ñez ar"}


def odd_rows(rng: random.Random) -> list[tuple]:
    rows = []
    for n in range(60):
        lang = rng.choice(sorted(LANGUAGES))
        text = invented(rng, rng.randint(3, 80), LANGUAGES[lang])
        rows.append((n, text, lang, rng.choice(["s1", "s2", "s2", "s2"]), len(text)))
    rows += [rows[3], rows[3]]  # whole rows again
    rows += [(100 + n, rows[5][1], rows[5][2], "s1", rows[5][4]) for n in range(5)]  # copies
    rows += [(200, rows[7][1].upper(), "aa", "s3", None)]
    rows += [
        (300, None, "aa", "s1", 0), (301, "", None, "s2", 0), (302, " \t\n ", "bb", None, 4), (303, "12 34!", "cc", "s1", 6),
        (None, "a null id", None, None, None), (None, None, None, None, None), (304, "日本語 テスト x\x0by", "aa", "s1", None),
        (305, "one", None, "s1", 3), (306, "one two", None, "s1", 7),
    ]
    rows.append((307, invented(rng, 9000, LANGUAGES["aa"]), "aa", "s1", None))
    return rows


@pytest.fixture(scope="session")
def rows():
    return odd_rows(random.Random(3))


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5, "doc_id")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(spark, docs):
    from pyspark.sql import functions as F

    return docs.select("*", *[F.lit("x").alias(name) for name in EXTRA])
