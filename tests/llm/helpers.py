"""Small tables with everything that may go wrong in them."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, size long, block string, bucket string, one string"

PROSE = "The quick brown fox jumps over the lazy dog while seven wizards quietly box near the old stone bridge at dawn"


def documents(spark, rows, extra=True):
    """A table of (doc_id, text, source) rows; with extra columns whose names operators use inside."""
    full = [(i, t, None, s, None if t is None else len(t), "x", 7, "b", "q", "o") for i, t, s in rows]
    df = spark.createDataFrame(full, SCHEMA)
    return df if extra else df.select("doc_id", "text", "lang", "source", "n_chars")


def odd_documents(spark, extra=True):
    """Null and empty texts, null ids and sources, repeated rows, ties, a long text, a very long word."""
    long_text = " ".join(f"word{i % 977} and{i}" for i in range(6000))
    return documents(spark, [(1, PROSE, "a"), (1, PROSE, "a"), (2, None, "a"), (3, "", None), (4, " \n\t ", "b"), (5, "one", "b"), (None, "no id here at all", "b"), (6, long_text, "c"), (7, "x" * 70000, "c"), (8, PROSE.upper(), None), (9, "Ünïcode ‮ text 日本語 😀 ok", "a")], extra)


def empty(spark):
    return documents(spark, [])
