from __future__ import annotations

import pytest

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
SF = "/root/testdata/sf0.001"

#: Nulls, empty texts, ties, repeated rows, a long text, and columns whose names the operators use themselves.
ODD_ROWS = [
    (1, "The same text with quite a few words in it. It ends here.", "a", 1, "x"),
    (1, "The same text with quite a few words in it. It ends here.", "a", 1, "x"),
    (2, None, None, None, None),
    (3, "", "b", 3, "y"),
    (None, "No id at all, but words. Mail me: a.b@c.example.com", "c", 4, "z"),
    (4, "\n\n \t\n", "d", 5, "z"),
    (5, "word " * 40_000, "e", 6, "z"),
    (6, "x" * 100_000, "f", 7, "z"),
    (7, "é日本\U0001f642 <|endoftext|> don't   +1 (555) 010-9999 4111 1111 1111 1111 10.0.0.1", "g", 8, "z"),
]
ODD_SCHEMA = "doc_id bigint, text string, kept string, n_tokens int, row string"


@pytest.fixture
def odd(spark):
    return spark.createDataFrame(ODD_ROWS, ODD_SCHEMA)


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], ODD_SCHEMA)


@pytest.fixture
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
