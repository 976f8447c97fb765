"""Queries that have to compare every document of their table."""

import oracle
import pytest

from claimloom.plans import queries


@pytest.mark.parametrize("name", ["document_dedup_all", "register_documents_all"])
def test_no_document_is_left_out(spark, small, name):
    got = queries.QUERIES[name](spark, small)
    assert oracle.difference(got, oracle.connect(small), queries.SQL[name]) is None
    assert got.select("sha256").distinct().count() == spark.read.parquet(f"{small}/documents.parquet").where("text is not null").select("text").distinct().count()
