"""Small tables that hold the awkward cases: nulls, empty and long texts, repeats, clashing columns."""

from __future__ import annotations

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, row int"


def words(rng: random.Random, n: int) -> list[str]:
    return [f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.randrange(4000)}" for _ in range(n)]


@pytest.fixture(scope="session")
def doc_rows():
    rng = random.Random(5)
    base = [words(rng, n) for n in (60, 90, 200, 40, 25)]
    texts = [" ".join(w) for w in base]
    for w in base:  # copies with one and with many words changed
        for changes in (1, 2, 12):
            copy = list(w)
            for _ in range(changes):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(9999)}"
            texts.append("\n".join(copy))
    texts += [texts[0], texts[0].upper(), None, "", " \t\n", "one", "One", "two words", "Ünï ☃ 漢字 text"]
    texts.append(" ".join(words(rng, 9000)))
    rows = [(i, t, "en", f"s{i % 4}" if i % 7 else None, 0, "k", 1) for i, t in enumerate(texts)]
    return rows + [rows[1], (None, texts[2], None, None, None, None, None)]


@pytest.fixture(scope="session")
def docs(spark, doc_rows):
    return spark.createDataFrame(doc_rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
