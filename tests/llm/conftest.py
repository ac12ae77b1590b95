import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Rows (doc_id, text) or (doc_id, text, lang) as a documents table."""

    def make(*rows):
        return spark.createDataFrame([(r[0], r[1], r[2] if len(r) > 2 else "en", "s", len(r[1] or "")) for r in rows], SCHEMA)

    return make


@pytest.fixture(scope="session")
def odd(docs_of):
    """Null, empty and very long texts, ties and repeated rows, null ids, columns with clashing names."""
    from pyspark.sql import functions as F

    long = " ".join(f"w{k % 997}x{k}" for k in range(30_000))
    rows = docs_of((1, None, None), (2, ""), (3, "one two three"), (3, "one two three"), (4, long), (None, "a line of more than ten letters\nb"), (5, "a line of more than ten letters\nB  c"), (6, "12 34 %%"), (7, "x y <|endoftext|> z"))
    return rows.withColumns({"size": F.lit("?"), "id": F.lit("?"), "key": F.lit("?"), "spans": F.lit("?"), "h1": F.lit("?"), "fp": F.lit("?"), "text_hash": F.lit("?"), "kept": F.lit("?"), "word": F.lit("?")})
