"""How plans deal with large tables: what is broadcast, and how rows are dealt to tasks."""

from __future__ import annotations

import re

import pytest

from idcordon.operators.gate import gate, overall_verdict
from idcordon.plans import registry, views

SMOKE = "/root/testdata/sf0.001"


def joins(df) -> list[str]:
    return re.findall(r"\b(\w+Join)\b", df._jdf.queryExecution().sparkPlan().toString())


def test_answers_are_not_broadcast(spark):
    texts = views.SPIKED.frame(spark, SMOKE)
    answers = views.RESPONSES.frame(spark, SMOKE)
    assert joins(gate(texts, "k", "text", answers)) == ["SortMergeJoin"]
    assert joins(overall_verdict(texts, answers, "k")) == ["SortMergeJoin"]


# Joins of the ends of turns' stretches, one row for each stretch, may be broadcast.
@pytest.mark.parametrize("query, merged", [("tool_gate", 3), ("extract_text", 1), ("map_controls_rbi", 1)])
def test_rows_made_of_each_event_or_text_are_not_broadcast(spark, query, merged):
    assert joins(registry.QUERIES[query](spark, SMOKE)).count("SortMergeJoin") >= merged


@pytest.mark.parametrize("view", [views.SPIKED, views.RESPONSES, views.PAYLOADS, views.IDS])
def test_narrow_rows_are_dealt_to_all_tasks(spark, view):
    source = spark.read.parquet(f"{SMOKE}/{view.table}.parquet")
    frame = view.frame(spark, SMOKE)
    assert source.rdd.getNumPartitions() == 1
    sizes = [r["count"] for r in frame.selectExpr("spark_partition_id() AS p").groupBy("p").count().collect()]
    assert len(sizes) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert max(sizes) <= 2 * min(sizes)
