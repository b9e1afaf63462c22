"""Every registered query of the folder: those with SQL against it, the others give whole results."""

import pytest

from checking import connect, differences
from spreadlens.llm.registry import ORACLE, QUERIES

OWN_TESTS = set(QUERIES) - set(ORACLE)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, sf_dir, name):
    assert differences(QUERIES[name](spark, sf_dir), connect(sf_dir), ORACLE[name]) == []


@pytest.mark.parametrize("name", sorted(OWN_TESTS - {"op7_hnsw", "pipeline"}))
def test_one_row_for_each_document(spark, sf_dir, name):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert sorted(r.doc_id for r in QUERIES[name](spark, sf_dir).collect()) == sorted(r.doc_id for r in docs.select("doc_id").collect())
