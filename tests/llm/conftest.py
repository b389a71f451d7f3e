import pytest

from pyspark.sql import types as T

DOCUMENTS = T.StructType([T.StructField(n, t) for n, t in (
    ("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()))])
#: Columns that operators use as working names.
CLASHES = ("size", "n", "word", "words", "tokens", "matches", "node", "component", "score", "copies", "path", "start", "label", "row", "_key", "text_")


@pytest.fixture()
def documents(spark):
    """A documents table of (id, text) or (id, text, source), with columns of clashing names on demand."""
    def make(rows, clashing=False):
        df = spark.createDataFrame([(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows], DOCUMENTS)
        if clashing:
            from pyspark.sql import functions as F

            df = df.select("*", *[F.lit("x").alias(c) for c in CLASHES])
        return df
    return make


@pytest.fixture()
def labelled(spark):
    def make(rows, name):
        return spark.createDataFrame(rows, f"doc_id long, {name} int")
    return make
