from __future__ import annotations

import pytest

#: Names that the operators use inside, to see that they don't clash.
EXTRA = {"h": "a", "norm": "b", "n": "c", "s": "d", "key": "e", "class": "f", "spans": "g", "keep_id": "h", "label": "i", "component_id": "j", "size": "k", "row": "l", "n_words": "m", "kept": "n", "score": "o", "f": "p", "__sha": "q"}
LONG = "lorem " * 30_000 + "the end. " + "y" * 120_000


@pytest.fixture(scope="session")
def edge(spark):
    """Null text and id, empty and very long texts, repeated rows, ties, and extra columns with clashing names."""
    rows = [(1, ""), (2, None), (3, LONG), (4, "MIT License here"), (4, "MIT License here"), (5, "mit license HERE"), (None, "mit license here"), (6, "   \n\t "), (7, "é ñ 日本 😀 <|endoftext|> a@b.co +1 (555) 555-0100, 4111 1111 1111 1111; 10.0.0.1"), (None, None)]
    names = ", ".join(f"`{k}` string" for k in EXTRA)
    return spark.createDataFrame([(*r, *EXTRA.values()) for r in rows], f"doc_id long, text string, {names}").repartition(3)


@pytest.fixture(scope="session")
def none(spark, edge):
    return spark.createDataFrame([], edge.schema)
