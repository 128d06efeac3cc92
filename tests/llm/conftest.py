from __future__ import annotations

import random

import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long, length int, rank string, bucket long, label string, copy string, keep string"
VOCABULARY = [a + b for a in "ba ke lo mi nu ra sto ti ve zu".split() for b in "dan ner lish mont tor pik sal gen fox rub é".split()]


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    words = [r.choice(VOCABULARY) for _ in range(n)]
    return "".join(w + (r.choice([". ", ",\n", " "]) if r.random() < 0.2 else " ") for w in words).strip()


def edited(text: str, seed: int, n: int) -> str:
    r = random.Random(seed)
    words = text.split(" ")
    for _ in range(n):
        words[r.randrange(len(words))] = "edit" + str(r.randrange(1000))
    return " ".join(words)


def awkward_rows() -> list[tuple]:
    """Nulls in every column, empty and very long texts, ties, repeated rows; columns with names that operators use."""
    base = [prose(k, 60 + 7 * k) for k in range(12)]
    texts = [*base, base[3], edited(base[4], 1, 1), edited(base[5], 2, 2), prose(77, 9000), "", None, " ", "\n\n", "one", base[0] + " " + base[1], "word " * 300, "Ünï\u00a0cödé \U0001f600 @x.", None]
    rows = [(k, t, "en" if k % 3 else None, f"src{k % 3}" if k % 5 else None, None if k % 4 == 0 else len(t or ""), k, "r", 1, "x", "c", "k") for k, t in enumerate(texts)]
    return [*rows, rows[2], rows[2], (None, "text without an id", None, None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(awkward_rows(), DOC).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOC)
