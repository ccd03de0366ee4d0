"""Small documents with the awkward cases that every operator must take."""

from pyspark.sql import Row

LONG = " ".join(f"word{i % 977}" for i in range(30_000))
AWKWARD = [
    (None, "no id at all", "en", "a"),
    (1, None, "en", "a"),
    (2, "", None, "b"),
    (3, " \t\n ", "en", None),
    (4, "one", "en", "a"),
    (5, "One two three", "de", "b"),
    (6, "one two THREE", "de", "b"),
    (7, LONG, "en", "a"),
    (8, "naïve café " * 40 + "\n" + "résumé \U0001f600 " * 30, "fr", "ü"),
    (9, "x" * 5000, "en", "a"),
    (4, "one", "en", "a"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component_id long, fp string, s string, block int"


def awkward(spark):
    """AWKWARD, a repeated row among it, with extra columns whose names operators use inside."""
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), 5, "x", "y", 1) for r in AWKWARD], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df, *columns):
    return {r[df.columns[0]]: tuple(r[c] for c in columns) for r in df.collect()}


def rows(df) -> list[Row]:
    return sorted(df.collect(), key=repr)
