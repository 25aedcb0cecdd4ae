"""Small tables for the tests of this folder."""

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, first=1):
    """Texts as documents, with columns whose names clash with those that operators use inside."""
    rows = [(first + i, t, "en", "s", len(t or ""), "x", "y", 0) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS + ", fp string, root string, block int")
