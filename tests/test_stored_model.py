"""The model's tables as stored: equal to the derived ones, written once, and anew when the sources change."""

import os
import shutil
from dataclasses import fields

import pytest

from claimloom.plans import lineage
from claimloom.schemas import Tables
from claimloom.sources import starschema, tables


def written(spark):
    """The versions that lie in the shared folder."""
    return {d for d, _, files in os.walk(lineage.shared_folder(spark).removeprefix("file:")) if "/model-" in d and "_SUCCESS" in files}


@pytest.mark.parametrize("brand", [False, True])
def test_stored_tables_are_the_derived_ones(spark, small, brand):
    derived, stored = starschema.tables(spark, small, brand), starschema.stored_tables(spark, small, brand)
    for f in fields(Tables):
        a, b = getattr(derived, f.name), getattr(stored, f.name)
        assert a.schema.simpleString() == b.schema.simpleString()
        assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty(), f.name


def test_written_once_and_anew_for_other_files(spark, small, tmp_path):
    for name in starschema.SOURCES:
        shutil.copy(f"{small}/{name}.parquet", tmp_path / f"{name}.parquet")
    folder = str(tmp_path)
    starschema.stored_tables(spark, folder)
    before = written(spark)
    assert starschema.stored_tables(spark, folder).claims.count() == spark.read.parquet(f"{folder}/lineitem.parquet").count()
    assert written(spark) == before
    fewer = spark.read.parquet(f"{small}/lineitem.parquet").where("l_orderkey % 2 = 0")
    os.remove(f"{folder}/lineitem.parquet")
    fewer.write.parquet(f"{folder}/lineitem.parquet")
    assert starschema.stored_tables(spark, folder).claims.count() == fewer.count()
    assert len(written(spark)) == len(before) + 5


def test_an_unfinished_version_is_not_read(spark, tmp_path):
    path, rows = f"{tmp_path}/t", spark.range(10)
    rows.where("id < 3").write.parquet(f"{path}/0")
    os.remove(f"{path}/0/_SUCCESS")
    assert tables.once(path, rows, "id").count() == 10
    assert tables.once(path, spark.range(0)).count() == 10  # it is there


def test_a_document_is_found_by_the_filter(spark, small):
    t = starschema.stored_tables(spark, small)
    plan = t.claims.where("document_id = 7")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(document_id,7)" in plan and "Join" not in plan and "Window" not in plan


def test_empty_sources(spark, small, tmp_path):
    for name in starschema.SOURCES:
        spark.read.parquet(f"{small}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    t = starschema.stored_tables(spark, str(tmp_path))
    assert all(getattr(t, f.name).isEmpty() for f in fields(Tables))


def test_a_query_writes_what_it_reads(spark, small, tmp_path):
    from claimloom.plans import queries

    for name in starschema.SOURCES:
        shutil.copy(f"{small}/{name}.parquet", tmp_path / f"{name}.parquet")
    before = written(spark)
    assert not queries.QUERIES["kb_batches"](spark, str(tmp_path)).isEmpty() and written(spark) == before
    assert not queries.QUERIES["alias_upsert"](spark, str(tmp_path)).isEmpty() and len(written(spark)) == len(before) + 1


def test_claims_are_shuffled_by_keys_alone(spark, small):
    found = starschema.entities(spark, small)
    assert not {"subject_text", "object_text", "evidence_text", "qualifiers", "qualifiers_hash"} & set(starschema.lines(spark, small, found, True).columns)
    claims = starschema.stored_tables(spark, small, True).claims
    plan = starschema.project.relations_of(claims)[0]._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan  # claims are combined by hash; the few spellings are sorted


def test_ids_of_claims_are_never_broadcast(spark):
    from claimloom.operators import assemble

    scope = lineage.cut(spark.range(5))
    claims = lineage.cut(spark.range(9).selectExpr("id", "'{}' as claim_json"))
    plan = assemble.failed_ids(claims, scope)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
