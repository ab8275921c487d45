from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """A function of (doc_id, text) rows to a documents table with extra columns whose names operators might want."""

    def make(rows, partitions: int = 2):
        extra = "score double, kept boolean, seed long, tokens string, local_id long, _length long, _score string"
        full = [(i, t, "en", "s", len(t or ""), 0.5, True, 1, "x", 7, 8, "y") for i, t in rows]
        return spark.createDataFrame(full, f"{SCHEMA}, {extra}").repartition(partitions)

    return make


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls, empty and blank texts, ties, repeated rows, one very long text, a hot group of copies."""
    long = " ".join(f"w{k % 977}x{k % 13}." for k in range(60_000))
    hot = "The same words again and again, in every one of these many copies."
    return [(1, None), (2, ""), (3, " \n\t "), (4, "a"), (4, "a"), (5, "A"), (None, "a text without an id"), (None, None), (6, long), *((100 + k, hot) for k in range(60))]
