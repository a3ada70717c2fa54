import os

import pytest

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def sf():
    if not os.path.isdir(SF):
        pytest.skip("test tables not available")
    return SF


@pytest.fixture
def documents(spark):
    """Build documents from ``(doc_id, text)`` or ``(doc_id, text, lang, source)``."""

    def build(rows):
        full = [(r[0], r[1], *(r[2:] or ("en", "s")), None if r[1] is None else len(r[1])) for r in rows]
        return spark.createDataFrame(full, DOCUMENTS)

    return build


@pytest.fixture
def clashing(documents):
    """Documents with further columns whose names the operators use inside."""
    from pyspark.sql import functions as F

    def build(rows):
        df = documents(rows)
        for name in ("id", "row", "key", "n0", "k0", "size", "slot", "rank", "kind", "a", "b", "lists", "members", "score", "target", "host", "label", "value"):
            df = df.withColumn(name, F.lit("x"))
        return df

    return build


def texts_of(spark, sf):
    return [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
