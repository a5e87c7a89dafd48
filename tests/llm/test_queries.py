import pytest

from strideway.llm.queries import ORACLES, QUERIES
from tests.compare import assert_same


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_its_sql(spark, sf_dir, name):
    assert_same(QUERIES[name](spark, sf_dir), ORACLES[name], sf_dir)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - {"op13_spelling_variants"}))
def test_query_gives_a_row_for_each_row(spark, sf_dir, name):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = QUERIES[name](spark, sf_dir)
    assert found.select("doc_id").distinct().count() == docs.count()
