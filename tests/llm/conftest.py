"""Documents with every awkward case that the operators promise to handle."""

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, score int, kept string, row_key int, v string, spans int"

SYLLABLES = ["th", "er", "an", "re", "on", "é", "ß", "ing ", "the ", "of ", " ", "日", ". ", "\n"]


def prose(rng: random.Random, n: int) -> str:
    return "".join(rng.choice(SYLLABLES) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Nulls in every column, empty and long texts, copies, near copies, ties, repeated rows."""
    rng = random.Random(7)
    passage = prose(rng, 60)
    out = []
    for i in range(60):
        text = prose(rng, rng.choice([1, 5, 40, 200]))
        if i % 4 == 0:
            text += passage + prose(rng, 20)
        if i % 7 == 3:
            text = out[rng.randrange(len(out))][1] or ""
        if i % 9 == 5:
            text = (out[rng.randrange(len(out))][1] or "") + " tail"
        out.append((i, text, "en", f"s{i % 4}", len(text)))
    out += [(60, None, None, None, None), (61, "", "en", "s1", 0), (None, passage, "de", None, 9), (None, None, None, "s2", 0)]
    out += [(62, prose(rng, 30_000), "fr", "s0", 5), (63, "one two", "fr", "s0", 7), (63, "one two", "fr", "s0", 7), (62, "other text of one id", None, "s3", 1)]
    out += [out[0], out[0], (64, " \t\n ", "en", "s3", 4), (-5, passage * 3, "en", "s1", 3), (65, "!!! ???", "en", "s3", 7)]
    return [(*r, "x", 1, "y", 2, "z", 3) for r in out]


@pytest.fixture(scope="session")
def documents(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)
