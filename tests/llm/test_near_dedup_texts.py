"""Near-dedup moves the texts that it compares, not all."""

import pytest
from pyspark.sql import functions as F

from claimloom.llm import near_dedup


def shuffled_rows(df):
    """Rows that enter the exchanges of a plan that has run."""
    plan, rows = df._jdf.queryExecution().executedPlan(), 0
    df._jdf.queryExecution().toRdd().count()
    todo = [plan.finalPhysicalPlan() if hasattr(plan, "finalPhysicalPlan") else plan]
    while todo:
        node = todo.pop()
        if "QueryStage" in node.getClass().getSimpleName():
            todo.append(node.plan())
            continue
        if node.getClass().getSimpleName() == "ShuffleExchangeExec" and "text" in node.output().toString():
            rows += node.metrics().apply("shuffleRecordsWritten").value()
        todo += [node.children().apply(k) for k in range(node.children().size())]
    return rows


@pytest.mark.parametrize("marks", (1, 1 << 22))
def test_only_texts_that_are_compared_are_shuffled(spark, monkeypatch, marks):
    monkeypatch.setattr(near_dedup, "MARKS", marks)
    asked, sets = [], near_dedup.sets
    monkeypatch.setattr(near_dedup, "sets", lambda docs: asked.append(docs) or sets(docs))
    words = F.transform(F.sequence(F.lit(1), F.lit(40)), lambda k: F.hex(F.xxhash64("id", k)))
    alone = spark.range(1000).select(F.col("id").alias("doc_id"), F.array_join(words, " ").alias("text"))
    near = alone.where("doc_id < 20").select((F.col("doc_id") + 5000).alias("doc_id"), F.concat("text", F.lit(" end")).alias("text"))
    docs = alone.unionByName(near)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = {r.doc_id: r.component_id for r in near_dedup.components(docs).collect()}
        moved = shuffled_rows(asked[0])
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert found == {i: i for i in range(1000)} | {5000 + i: i for i in range(20)}
    assert moved >= 1020 if marks == 1 else 40 <= moved < 100
