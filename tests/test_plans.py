"""The physical plans of queries over big tables: pruned scans, pushed filters, top-k without a sort, no nested loops."""

from __future__ import annotations

import re

import pytest

from lorecast.plans import registry

FOLDER = "/root/testdata/sf0.001"


def plan(spark, name):
    df = registry.queries()[name](spark, FOLDER)
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_vector_search_is_a_top_k_over_a_pruned_scan(spark):
    text = plan(spark, "vector_topk")
    assert "TakeOrderedAndProject" in text
    assert "label" not in re.search(r"ReadSchema: (.*)", text).group(1)


def test_filters_reach_the_scan(spark):
    text = plan(spark, "scan_filter_project")
    assert re.search(r"PushedFilters: \[.*o_orderstatus.*o_totalprice", text)
    assert "Exchange" not in text


@pytest.mark.parametrize("name", ["contradictions", "similar_names", "cooccurrence_pairs", "or_join_expand", "chained_left_joins", "provenance_lineage", "hybrid_search", "multi_manifold"])
def test_no_join_without_keys(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text
    nested = len(re.findall(r"^\(\d+\) BroadcastNestedLoopJoin", text, re.M))
    assert nested <= (1 if name == "hybrid_search" else 0)  # the one row of corpus statistics


def test_cooccurrence_aggregates_before_the_shuffle(spark):
    assert plan(spark, "op_stats_view").count("HashAggregate") >= 2
