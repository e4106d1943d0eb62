import re

import pytest

from tidemark.plans import catalog

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["w1_suffix_min", "w2_time_to_future_min", "w3_completion_override", "w5_lag_delta_pct", "p14_already_past"])
def test_one_shuffle_serves_all_windows(spark, name):
    assert len(re.findall(r"\bExchange hash", plan(catalog.QUERIES[name](spark, SF)))) == 1


@pytest.mark.parametrize("name", ["j2_flipped_match", "j3_cascade_backfill", "j5_fuzzy_match", "j6_nearest_meeting", "j9_as_of_rank", "j10_token_subset", "j24_schedule_lookup"])
def test_matching_has_no_cross_join(spark, name):
    assert not re.search("CartesianProduct|NestedLoopJoin (?!.*Cross)", plan(catalog.QUERIES[name](spark, SF)).replace("BroadcastNestedLoopJoin BuildRight, Cross", ""))


def test_python_only_where_greedy(spark):
    for name in sorted(catalog.QUERIES):
        if name[0] in "wdpf":
            assert not re.search("Python|Pandas|Arrow", plan(catalog.QUERIES[name](spark, SF))), name


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(catalog.QUERIES["p4_not_started"](spark, SF))
    assert "value" not in re.search(r"ReadSchema: struct<(.*?)>", text)[1]
