import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
# Names that operators use inside, as columns of the caller.
CLASHING = ("__text", "__id", "size", "shard", "key", "copy", "n", "p", "words", "n_words", "kept", "label", "rid", "fp")


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (doc_id, text[, source[, lang]])."""
    def build(rows, extra=False):
        full = [(r[0], r[1], r[3] if len(r) > 3 else "en", r[2] if len(r) > 2 else "s1", None) for r in rows]
        df = spark.createDataFrame(full, DOCS).repartition(3)
        if extra:
            from pyspark.sql import functions as F
            df = df.withColumns({c: F.lit("x") for c in CLASHING})
        return df
    return build


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, blanks, a very long text, ties and repeated rows."""
    long = " ".join(f"word{i % 977} and{i % 31}" for i in range(30_000))
    return [(None, "a text without an id", None, None), (1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, long), (6, "tie of texts here"),
            (7, "tie of texts here"), (8, "repeated row"), (8, "repeated row"), (8, "repeated row"), (None, None, None, None),
            (9, "ünïcode ÉÀ <|endoftext|> \x85  x"), (10, "!!! ### 123 456"), (2**60, "A large id, kept exact.")]
