import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cases import HARD  # noqa: E402

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def docs_of(spark):
    """documents from {doc_id: text} or pairs; extra columns carry names that operators use inside."""

    def make(rows, lang="en", clash=False):
        pairs = rows.items() if isinstance(rows, dict) else rows
        df = spark.createDataFrame([(d, t, lang, "s", len(t) if t is not None else None) for d, t in pairs], DOCS)
        if clash:
            from pyspark.sql import functions as F

            for name in ("name", "fp", "kept", "score", "names", "spans", "level", "host", "length", "salt", "rank", "keep_id", "toxic", "unit", "ids"):
                df = df.withColumn(name, F.lit("clash"))
        return df

    return make


@pytest.fixture(scope="session")
def sample(spark, sf_dir):
    """documents of the smallest scale, as pairs."""
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]


@pytest.fixture
def hard(docs_of):
    return docs_of(HARD, clash=True)


@pytest.fixture
def empty(docs_of):
    return docs_of({})
