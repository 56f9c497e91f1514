"""Guards on the physical plans of the registered queries."""
import contextlib
import io
import re

import pytest

from conftest import SF_SMALL
import __spark_entry__ as E

BATCH_QUERIES = sorted(n for n in E.queries() if not n.startswith("stream_"))
NATIVE_ONLY = ["error_metrics", "outcome_counts", "feature_summary_pop", "welch_report", "paired_ttest",
               "histogram20", "rule_matches", "assign_groups", "longest_run", "first_lookup", "batch_ids"]


def plan(spark, name):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        E.queries()[name](spark, SF_SMALL).explain("formatted")
    return buf.getvalue()


@pytest.mark.parametrize("name", BATCH_QUERIES)
def test_no_cartesian_or_nested_loop(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize("name", NATIVE_ONLY)
def test_core_queries_stay_in_the_jvm(spark, name):
    text = plan(spark, name)
    assert not re.search(r"ArrowEvalPython|BatchEvalPython|MapInPandas|FlatMapGroupsInPandas", text)


@pytest.mark.parametrize("name", ["welch_report", "outcome_counts"])
def test_lineitem_scan_is_pruned(spark, name):
    text = plan(spark, name)
    schemas = re.findall(r"ReadSchema: (struct<[^\n]*>)", text)
    li = [s for s in schemas if "l_quantity" in s]
    assert li and all("l_shipdate" not in s and "l_linestatus" not in s and "l_suppkey" not in s for s in li)


@pytest.fixture()
def no_static_broadcast(spark):
    """Plans as with tables of unknown size."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@pytest.mark.parametrize("name", ["error_metrics", "comparison_metrics", "error_metrics_nullkey"])
def test_median_neither_sorts_nor_shuffles_raw_rows(spark, no_static_broadcast, name):
    text = plan(spark, name)
    assert "rangepartitioning" not in text and "ExistingRDD" not in text



@pytest.mark.parametrize("name", BATCH_QUERIES)
def test_no_cartesian_without_static_broadcast(spark, no_static_broadcast, name):
    if name.startswith("op") or name == "pipeline":
        pytest.skip("its jobs run while the plan is made; covered by its own tests")
    text = plan(spark, name)
    assert "CartesianProduct" not in text


def test_models_share_one_scan(spark):
    assert plan(spark, "prompt_text").count("ReadSchema") == 1
