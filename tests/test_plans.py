"""Plan guards: no registered query plans a cartesian product or a nested-loop join,
and per-key top-k windows become WindowGroupLimit (pre-shuffle limits)."""
import os

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
QUERIES = E._catalog().QUERIES
STREAMS = {n for n in QUERIES if n.startswith("stream_")}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


def _plan(spark, name):
    df = QUERIES[name](spark, SF)
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - STREAMS))
def test_no_cross_join(spark, name):
    plan = _plan(spark, name)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("name", ["recent_activities", "similar_items", "interest_overlap"])
def test_top_k_is_group_limited(spark, name):
    assert "WindowGroupLimit" in _plan(spark, name)


def test_keywords_shuffle_nothing(spark):
    """Neither texts nor terms: the texts are read where they are, and a row's terms are counted in the row."""
    assert "Exchange" not in _plan(spark, "keywords")
