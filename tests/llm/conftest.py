from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng: random.Random, n: int, size: int = 400) -> list[str]:
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) + rng.choice(["", "", "", ",", "."]) for _ in range(n)]


@pytest.fixture
def rng():
    return random.Random(11)


@pytest.fixture
def corpus(rng):
    """Rows with copies, near copies, shared passages, nulls in each column, empty, short and very long texts, ties and repeated rows."""
    base = [" ".join(words(rng, rng.randint(60, 160))) for _ in range(25)]
    passage = " ".join(words(rng, 60))
    texts = list(base)
    texts += [base[0], base[0], base[0].upper(), base[1] + "\n", base[2]]
    for i in range(8):  # a group of near copies of one text
        w = base[3].split()
        w[5 + i] = f"changed{i}"
        texts.append(" ".join(w))
    for i in range(6):  # a passage that documents share
        w = words(rng, 40)
        texts.append(" ".join([*w[:20], passage, *w[20:]]))
    texts += ["", None, " \t\n", "one", "one two", "one  two", "a b c d e", "é ß 日本 Ωmega " * 3, None, ""]
    texts.append(" ".join(words(rng, 20_000)))
    rows = [(i, t, rng.choice(["en", "fr", None]), rng.choice(["s1", "s2", None]), len(t) if t else None) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows


@pytest.fixture
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA)


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
