import os
import sys

import pytest
from pyspark.sql import types as T

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from conftest_rows import DOCUMENT, rows  # noqa: E402

@pytest.fixture(scope="session")
def odd(spark):
    """The odd documents with extra columns whose names clash with those that operators work with."""
    extra = [(*r, k, "m", 1.5) for k, r in enumerate(rows())]
    return spark.createDataFrame(extra, DOCUMENT + ", size int, _m string, bucket double")


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCUMENT)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, 1, None), (3, None, 0), (None, 1, 1), (9, 1, 0), (9, 1, 0), (99, 0, 0)], "doc_id bigint, quality int, toxic int")


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("quality", T.IntegerType()), T.StructField("toxic", T.IntegerType())]))
