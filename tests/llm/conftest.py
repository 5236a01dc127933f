import random

import pytest

from veilmatch.llm.common import share_code

WORDS = "the of and Zeta éclair straße big red fox jumps over lazy dogs near river bank while MIT license holds 42 don't x".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ",", ".", "\n"]) for _ in range(n))


def texts():
    """Copies, near copies, shared passages, odd characters, empty and long texts, and null."""
    rng = random.Random(5)
    base = [prose(rng, rng.randrange(20, 120)) for _ in range(12)]
    passage = prose(rng, 90)
    out = [*base, base[0], base[0], base[1].replace("fox", "cat", 1), base[2] + " tail", passage, prose(rng, 30) + " " + passage + " " + prose(rng, 30), passage + " end"]
    out += ["", None, " ", "\n\n", "x", "Ünï 日本語 ４５ 😀", "a" * 3000, "ab " * 900, "line one\n" * 80, "<|endoftext|> a <|startoftext|>", "tab\tand\x1cfs \x85 nbsp\xa0.", "q" * 70 + " " + "z" * 70]
    return out


@pytest.fixture(scope="session")
def rows():
    """(doc_id, text): with a repeated row, a repeated id and a null id."""
    got = [(3 * i, t) for i, t in enumerate(texts())]
    return [*got, got[2], (0, "same id, other text"), (None, "no id at all"), (10_000, prose(random.Random(9), 9000))]


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The rows beside columns whose names clash with what operators use inside."""
    share_code(spark)
    extra = [(i, t, "en", "s", None if t is None else len(t), 0.5, b"k", "w") for i, t in rows]
    return spark.createDataFrame(extra, "doc_id long, text string, lang string, source string, n_chars long, score double, tkey binary, _text string").repartition(3)


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)


@pytest.fixture(scope="session")
def nulls(spark):
    return spark.createDataFrame([(None, None), (None, None), (1, None)], "doc_id long, text string")
