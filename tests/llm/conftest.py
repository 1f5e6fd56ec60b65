from __future__ import annotations

import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # Names that operators might use themselves.
        T.StructField("fp", T.StringType()),
        T.StructField("size", T.StringType()),
        T.StructField("key", T.StringType()),
        T.StructField("n", T.StringType()),
        T.StructField("_draw", T.StringType()),
        T.StructField("quota", T.StringType()),
        T.StructField("kept", T.StringType()),
    ]
)


@pytest.fixture(scope="session")
def make_docs(spark):
    """Rows (doc_id, text, lang, source) with columns whose names clash with the operators' own."""

    def make(rows):
        full = [(i, t, lang, s, len(t) if t else None, *["x"] * 7) for i, t, lang, s in rows]
        return spark.createDataFrame(full, DOCS)

    return make
