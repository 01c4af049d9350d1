"""Rows that every operator must take."""

from pyspark.sql import types as T

COLUMNS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that operators use themselves
    *[T.StructField(n, T.StringType()) for n in ("kept", "fingerprint", "block", "score", "key", "words", "host", "root", "piece", "bigram", "n_tokens", "hash", "position")],
])
PROSE = "The river rose again in the night and by morning the lower fields were under water as they had been in most springs that anyone could remember"
LONG = " ".join(f"{w}{i % 977}" for i in range(4000) for w in ("field", "river", "barn", "mill", "road"))
EDGE_ROWS = [
    (1, PROSE, "en", "a"), (2, PROSE, "en", "a"), (2, PROSE, "en", "a"), (3, None, "en", "a"), (4, "", "en", "b"), (5, " \n\t ", None, None),
    (None, PROSE + " and more of it came", None, "b"), (6, LONG, "en", None), (7, "12 34 !! ..", "de", "b"), (None, None, None, None), (8, "one", "fr", "c"),
    (9, "\n".join(["same line here"] * 30), "en", "c"), (10, "Ünï códé 中文字 😀 <|endoftext|> ok", "xx", "c"),
]


def docs_of(spark, rows):
    """Documents from (id, text, lang, source)."""
    return spark.createDataFrame([(*r, len(r[1] or ""), *[None] * 13) for r in rows], COLUMNS)
