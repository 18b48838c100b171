from __future__ import annotations

import random

import pytest

#: An id, a text, and columns whose names the operators use inside.
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, kept string, size string, "
          "component string, position string, __id string, _h string, a string")
EXTRA = ("x",) * 7


def row(doc_id, text, source="s"):
    return (doc_id, text, "en", source, len(text or ""), *EXTRA)


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls, empty, white and very long texts, near copies, exact copies, repeated rows, ties."""
    rnd = random.Random(5)
    vocabulary = [f"w{i}" for i in range(4000)]
    long = " ".join(rnd.choice(vocabulary) for _ in range(30000))
    base = [rnd.choice(vocabulary) for _ in range(200)]
    near = list(base)
    near[100] = "CHANGED"
    passage = " ".join(rnd.choice(vocabulary) for _ in range(60))
    return [
        row(1, "The cat sat\ton the  mat"), row(2, None), row(3, ""), row(4, " \t\n"), row(5, "the CAT sat on the mat", None),
        row(5, "the CAT sat on the mat", None), row(None, "the cat sat on the mat"), row(7, long, "t"), row(8, long + " end", "t"),
        row(9, " ".join(base), "u"), row(10, " ".join(near), "u"), row(11, "one"), row(12, "One", ""), row(13, "x " * 80),
        row(14, "before this " + passage + " and after"), row(15, "other words " + passage + " closing it", None),
        row(16, "È ça là 中文 👍\x00\x1f é"), row(17, None, None), row(18, "The cat sat on the mat"),
    ]


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    return spark.createDataFrame(edge_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
