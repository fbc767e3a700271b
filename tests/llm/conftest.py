import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, rules int, spans string, n bigint, key string"


@pytest.fixture(scope="session")
def make(spark):
    """Documents of (doc_id, text[, lang[, source]]), with columns whose names clash with the operators' own."""

    def build(rows, parts=3):
        full = [(r[0], r[1], (list(r) + [None] * 4)[2], (list(r) + [None] * 4)[3], len(r[1] or ""), 1, "x", 2, "k") for r in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(parts)

    return build


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls, empty and blank texts, repeated rows, a null id, and a long text."""
    return [(1, None), (2, ""), (3, " \t\n\x0b"), (4, "one two"), (4, "one two"), (None, "one two three four five six"), (5, "word " * 30000), (6, "a\x00b ünï   x")]
