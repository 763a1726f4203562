"""What the physical plans must (not) contain."""

import os

import pytest

from hexrisk.catalog.queries import QUERIES
from hexrisk.catalog.store import fresh_features
from hexrisk.operators.aggregate import agg_conflict_day
from hexrisk.operators.panel import NEIGHBOR_FEATURES, date_bounds, distinct_cells, fill_days, merge_cell_days, time_line
from hexrisk.plans.features import conflict_rows
from hexrisk.session import cut_lineage
from hexrisk.sources import derived

ROOT = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(ROOT), reason="benchmark tables are absent")
CHECKED = ("q0_panel_label", "q1_build_features", "q4_backtest_days", "q7_cells_near", "q8_area_report", "w11_latest_k", "j3_spatial_lag", "a1_agg_conflict_day")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", CHECKED)
def test_no_python_rows_and_no_product_of_tables(spark, name):
    plan = plan_of(QUERIES[name](spark, ROOT))
    for bad in ("Python", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in plan, f"{bad} in {name}"


def test_dense_panel_is_made_after_the_last_shuffle(spark):
    daily = cut_lineage(agg_conflict_day(conflict_rows(derived.conflict(spark, ROOT))))
    bounds = date_bounds(daily)
    features = {k: NEIGHBOR_FEATURES[k] for k in ("neighbor_danger_avg", "neighbor_fatal_sum")}
    plan = plan_of(time_line(fill_days(merge_cell_days([daily], distinct_cells(daily), features), bounds)))
    # The main chain of the plan; subqueries and their branches are drawn with colons.
    chain = [line.split("+- ", 1)[1] for line in plan.splitlines() if "+- " in line and ":" not in line.split("+- ", 1)[0]]
    above = chain[: next(i for i, line in enumerate(chain) if line.startswith("Exchange"))]
    assert any(line.startswith("Generate explode(") for line in above)
    assert sum(line.startswith("Window") for line in above) == 2


def test_no_feed_moves_the_dense_panel(spark):
    """All four feeds, and no table small enough for a broadcast: every shuffle lies below the fill."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(fresh_features(spark, ROOT, keep_tail=True))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    chain = [line.split("+- ", 1)[1] for line in plan.splitlines() if "+- " in line and ":" not in line.split("+- ", 1)[0]]
    above = chain[: next(i for i, line in enumerate(chain) if line.startswith("Exchange"))]
    assert any(line.startswith("Generate explode(") for line in above)
    assert not any("Join" in line for line in above)


def test_event_scan_reads_only_what_it_needs(spark):
    plan = plan_of(QUERIES["a7_date_range"](spark, ROOT))
    assert "ReadSchema: struct<ts:timestamp" in plan and "value" not in plan.split("ReadSchema")[1]
    news = plan_of(QUERIES["a2_agg_news_day"](spark, ROOT))
    assert "l_comment" not in news and "ReadSchema: struct<l_orderkey:bigint" in news


def test_latest_rows_are_cut_before_the_shuffle(spark):
    assert plan_of(QUERIES["w11_latest_k"](spark, ROOT)).count("WindowGroupLimit") == 2
