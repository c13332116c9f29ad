"""Shapes of physical plans that matter at scale."""

import re

import pytest

from vacantia.catalog.registry import QUERIES, load_all
from vacantia.operators.matching import resolve_keys

load_all()
STREAMS = [n for n in QUERIES if n.startswith("stream_")]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in STREAMS])
def test_no_cross_or_nested_loop_join(spark, sf, name):
    plan = plan_of(QUERIES[name](spark, sf))
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan


def test_flagship_reads_only_what_it_needs(spark, sf):
    plan = plan_of(QUERIES["ranked_parts"](spark, sf))
    assert "ReadSchema: struct<l_partkey:bigint,l_quantity:double>" in plan
    assert "TakeOrderedAndProject" in plan and "partial_sum" in plan
    # The keyword rule stays inside generated code.
    assert "lambdafunction" not in plan


def test_detail_filter_reaches_the_scan(spark, sf):
    plan = plan_of(QUERIES["open_per_group"](spark, sf))
    assert "ReadSchema" in plan and "props" not in plan


def test_watchlist_filters_are_pushed(spark, sf):
    assert "EqualTo(o_orderstatus,O)" in plan_of(QUERIES["watchlist"](spark, sf))


def test_excerpts_are_cut_above_the_join(spark, sf):
    """No expression on the bodies below the join with the queue."""
    plan = QUERIES["triage_queue_excerpts"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.split("\n")
    cut = next(i for i, x in enumerate(lines) if "regexp_replace" in x)
    join = next(i for i, x in enumerate(lines) if "Join LeftSemi" in x)
    assert cut < join and not any("regexp_replace" in x for x in lines[join:])


@pytest.mark.parametrize("name", ["canonical_url", "canonical_url_steps", "lifecycle_join", "priority_match"])
def test_url_rules_stay_in_generated_code(spark, sf, name):
    assert "lambdafunction" not in plan_of(QUERIES[name](spark, sf))


def test_questions_are_classified_once_each(spark, sf):
    """The rule chain stands once, in the aggregation to distinct questions."""
    plan = QUERIES["field_classify"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    before, *after = plan.split("legally\\ authorized")
    assert len(after) == 1
    assert re.findall(r"(Project|Aggregate|Filter|Join|Generate) ", before)[-1] == "Aggregate"


def test_keywords_of_a_table_meet_titles_by_a_join(spark, sf):
    plan = plan_of(QUERIES["keyword_table_filter"](spark, sf))
    assert "gram" in plan and "NestedLoopJoin" not in plan


def test_stretches_of_texts_are_not_broadcast(spark, tmp_path):
    """Small files may hold many rows, and each text has many stretches: no size is known before these joins run."""
    spark.range(2000).selectExpr("concat('Customer ', id) AS company", "'' AS title", "concat('p', id) AS key", "id AS ord").write.parquet(f"{tmp_path}/named")
    spark.range(300).selectExpr("concat('MER ', id * 7) AS text").write.parquet(f"{tmp_path}/typed")
    named, typed = spark.read.parquet(f"{tmp_path}/named"), spark.read.parquet(f"{tmp_path}/typed")
    found = resolve_keys(typed, named, named, "ord")
    assert "Broadcast" not in plan_of(found)
    # Of the numbers that begin with these digits, the first in order is the number itself where it exists.
    want = {f"MER {7 * i}": f"p{7 * i}" if 7 * i < 2000 else "" for i in range(300)}
    assert {r.text: r.key for r in found.collect()} == want


def test_boards_of_workday_are_read_once_a_payload(spark, sf):
    """The rules of the board's address stand below the generator that makes rows of jobs."""
    lines = QUERIES["provider_workday"](spark, sf)._jdf.queryExecution().optimizedPlan().toString().split("\n")
    generate = next(i for i, x in enumerate(lines) if "Generate posexplode" in x)
    assert not any("RLIKE" in x or "regexp" in x for x in lines[:generate]) and any("RLIKE" in x for x in lines[generate:])


@pytest.mark.parametrize("name", ["lifecycle_join_bucketed", "snapshot_merge_bucketed"])
def test_a_bucketed_registry_is_not_moved(spark, sf, name):
    """No exchange between the scan of the bucketed table and the join on its key."""
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lines = plan_of(QUERIES[name](spark, sf)).split("\n")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    depth = lambda x: len(x) - len(x.lstrip(" :+-"))
    scans = [i for i, x in enumerate(lines) if "Bucketed: true" in x]
    assert scans
    for i in scans:
        above, at = [], depth(lines[i])
        for x in reversed(lines[:i]):
            if depth(x) < at:
                at = depth(x)
                above.append(x)
                if "Join" in x:
                    break
        assert "Join" in above[-1] and not any("Exchange" in x for x in above)


def test_a_mixed_payload_table_is_read_once(spark, sf):
    plan = plan_of(QUERIES["provider_normalize"](spark, sf))
    assert plan.count("FileScan") == 1
