import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))


@pytest.fixture(scope="session")
def rows(spark, sf):
    """Rows of a sample table as a list of dicts."""
    def get(name):
        return [r.asDict() for r in spark.read.parquet(f"{sf}/{name}.parquet").collect()]

    return get


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table of (doc_id, text, lang) rows; other columns by rule."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"

    def make(items):
        full = [(i, t, lang, "s", None if t is None else len(t)) for i, t, lang in items]
        return spark.createDataFrame(full, schema)

    return make
