import pytest

#: Columns that documents have, and some whose names operators use themselves.
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, fingerprint string, component_id string, score string, "
    "ids string, held_out string, bucket string, h string, kept string, id string, path string, spans string, i int, node string"
)


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, blanks, repeated rows, a long text, and clashing extra columns."""
    long = " ".join(f"word{i % 9973} of a long text" for i in range(20_000))
    texts = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one two"), (6, "The quick brown fox jumps over it"), (6, "The quick brown fox jumps over it")]
    texts += [(7, long), (None, "a row without an id"), (None, None), (8, "ONE TWO"), (9, "ı İ ß 漢字 \u0000 ▁ 😀")]
    rows = [(i, t, None if k % 3 else "en", None if k % 2 else "s", None, *["x"] * 11, k, "x") for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
