"""Small tables with the cases that every operator must stand."""

from __future__ import annotations

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "alpha beta gamma delta " * 30_000
PROSE = "The old mill stood by the river and nobody had been inside it for years. Its wheel turned when the water was high, and children said it sang at night. " * 3

#: Nulls in every column, empty and blank texts, ties, repeated rows and ids, a very long text, text outside ASCII.
ODD = [
    (1, PROSE, "en", "a", 9),
    (2, PROSE, "en", "a", 9),
    (2, PROSE, "en", "a", 9),
    (3, "", "en", "b", 0),
    (4, None, None, None, None),
    (5, " \t\n ", "en", "b", 4),
    (6, LONG, "en", "c", None),
    (7, "ÀÉÎ ŝtrange 😀 text with marks here", "fr", "c", 5),
    (None, "a row without an id", "en", None, 3),
    (8, "one", "en", "b", 3),
    (9, "line again\nline again\nline again\n", "en", "b", 3),
]


def odd(spark, extra: bool = True):
    """The odd rows, with columns whose names operators might use themselves."""
    df = spark.createDataFrame(ODD, DOCS)
    if not extra:
        return df
    for name in ("digest", "fp", "row", "queue", "ids", "host", "size", "rank", "kept", "text_sha256", "component_id", "score", "__t", "block", "a", "b", "n"):
        df = df.withColumn(name, df.n_chars)
    return df


def none(spark):
    return spark.createDataFrame([], DOCS)


def texts(spark, sf_dir):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
