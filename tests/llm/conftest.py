import pytest

LONG = " ".join(f"w{k % 977}x{k % 31}" for k in range(30_000))
#: Nulls, empty and blank texts, ties, repeated rows, a very long text; (doc_id, text).
EDGE = [
    (1, None), (2, ""), (3, " \n\t"), (4, "alpha beta gamma delta epsilon zeta"), (4, "alpha beta gamma delta epsilon zeta"),
    (5, "alpha  beta gamma delta epsilon zeta"), (6, "alphabetagammadeltaepsilonzeta"), (None, "no id"), (None, None), (7, LONG),
    (8, LONG + " tail"), (9, "Ünïcode ÀÉ — 日本語 😀\u0085 end"), (10, "a\na\n\nb\nA "), (11, "one two three " * 40), (12, "### </turn> \\ x"),
]
CLASHES = {"row": "r", "key": "k", "score": 1.5, "failed_rule": "f", "bucket": 3, "digest": "d", "words": "w", "n": 7, "start": 0, "label": None}


def documents(spark, rows):
    """A documents table with columns whose names the operators use inside."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, `row` string, key string, score double, failed_rule string, " \
        "bucket int, digest string, words string, n int, `start` int, label string"
    return spark.createDataFrame([(i, t, None, "s", len(t or ""), *CLASHES.values()) for i, t in rows], schema)


@pytest.fixture(scope="session")
def edge(spark):
    return documents(spark, EDGE)


@pytest.fixture(scope="session")
def none(spark):
    return documents(spark, [])
