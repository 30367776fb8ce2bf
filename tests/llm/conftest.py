import datetime

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    def make(texts, ids=None):
        ids = range(len(texts)) if ids is None else ids
        return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in zip(ids, texts)], DOCS)
    return make


def in_use(df, *more):
    """The table with columns whose names an operator might use itself."""
    from pyspark.sql import functions as F
    out = df
    for name in ("key_a", "key_b", "n_words", "kept", "start", "component_id", "bucket", "spans", *more):
        if name not in out.columns:
            out = out.withColumn(name, F.lit(str(datetime.date(2000, 1, 1))))
    return out
