import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))


@pytest.fixture(scope="session")
def documents(spark):
    """The whole smallest table: id -> text."""
    from plain import SF
    return {r[0]: r[1] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


@pytest.fixture(scope="session")
def awkward(spark):
    from plain import AWKWARD
    return spark.createDataFrame([(i, t, "other", k) for k, (i, t) in enumerate(AWKWARD)], "doc_id long, text string, n_lines string, key int")
