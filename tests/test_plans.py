"""What Spark makes of the queries: no Python, no products, each source read once, scans narrowed."""

import re

import pytest

import __spark_entry__ as entry_point
from conftest import TESTDATA
from ledgerline.plans import facts, objectives, summaries


def executed(df):
    """The final plan, after adaptive execution; plans that were replaced on the way are left out."""
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def initial(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", entry_point.PLANS)
def test_no_python_and_no_products(spark, name):
    plan = initial(entry_point.queries()[name](spark, str(TESTDATA / "sf0.001")))
    assert not re.search("Python|Pandas|CartesianProduct|NestedLoop", plan)


def _final(plan):
    kept, skipping = [], None
    for line in plan.split("\n"):
        depth = len(line) - len(line.lstrip(" :+-"))
        if skipping is not None and depth > skipping:
            continue
        skipping = None
        if "== Initial Plan ==" in line:
            skipping = depth - 1
            continue
        kept.append(line)
    return kept


def test_revenue_is_read_once(spark):
    """The scans under the anchor's subquery and in the main plan end in one and the same shuffle."""
    plan = _final(executed(entry_point.queries()["revenue_summary"](spark, str(TESTDATA / "sf0.001"))))
    by_key = [line for line in plan if "Exchange" in line and re.search(r"Product_Category#\d+(, \d+)?\]?", line)]
    assert any("ReusedExchange" in line for line in by_key)


@pytest.mark.parametrize(("name", "scans"), [
    ("revenue_summary", {"l_orderkey": 1, "c_custkey": 2}), ("opportunity_summary", {"c_custkey": 2}),
    ("obj_wow_changes", {"o_orderkey": 3}), ("obj_wow_totals", {"o_orderkey": 3}),
])
def test_each_source_is_read_once(spark, name, scans):
    """Each lookup is derived from the customers; a week's snapshot from the orders, the week before from two parts of them."""
    plan = _final(executed(entry_point.queries()[name](spark, str(TESTDATA / "sf0.01"))))
    for column, times in scans.items():
        assert sum("FileScan" in line and column in line for line in plan) == times


def test_columns_reach_the_scan(tiny):
    plan = initial(facts.aligned_revenue(tiny))
    lineitem = next(line for line in plan.split("\n") if "FileScan" in line and "l_shipdate" in line)
    columns = re.search(r"FileScan parquet \[(.*?)\]", lineitem).group(1)
    assert {c.split("#")[0] for c in columns.split(",")} == {
        "l_orderkey", "l_partkey", "l_extendedprice", "l_returnflag", "l_shipdate",
    }


def test_shuffles_of_the_merged_facts(spark, tiny):
    """One per source, and one of the sums; the lookups then join without shuffling the facts again."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = initial(summaries.revenue_summary(tiny))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    main = [line for line in plan.split("\n") if "Subquery" not in line]
    assert sum("REPARTITION_BY_COL" in line for line in main) == 1
    account = next(line for line in main if "SortMergeJoin" in line)
    assert "LeftOuter" in account and "Account_No" in account
    left = main[main.index(account) + 1: next(i for i, line in enumerate(main) if "REPARTITION_BY_COL" in line)]
    assert not any(" Exchange " in line or "-Exchange" in line for line in left if "Broadcast" not in line)
    # The calendar is broadcast for its checked size, whatever the threshold.
    assert "BroadcastHashJoin" in plan


def test_forecast_window_runs_over_month_totals(tiny):
    plan = initial(objectives.forecast(tiny))
    window = plan.index("Window [")
    assert re.search(r"HashAggregate\(keys=\[Fiscal_Month#\d+\], functions=\[sum", plan[window:])
    assert not re.search(r"HashAggregate\(keys=\[Fiscal_Month#\d+\]", plan[:window])


@pytest.mark.parametrize("plan_of", [facts.all_facts, summaries.revenue_summary])
def test_merged_facts_are_summed_by_one_sort(tiny, plan_of):
    """After the shuffle by account no hash table holds the rows: they are sorted, once, for both sums and for the lookups."""
    plan = [line for line in initial(plan_of(tiny)).split("\n") if "Subquery" not in line]
    dealt = next(i for i, line in enumerate(plan) if "REPARTITION_BY_COL" in line)
    depth = [len(line) - len(line.lstrip(" :+-")) for line in plan]
    above, at = [], depth[dealt]
    for i in range(dealt - 1, -1, -1):
        if depth[i] < at:
            above.append(plan[i])
            at = depth[i]
    assert sum("SortAggregate" in line for line in above) == 2
    assert not any("HashAggregate" in line for line in above)
    assert sum(bool(re.search(r"\bSort \[", line)) for line in above) == 1


def test_the_summary_as_written_is_folded_before_its_attributes_are_joined(spark):
    plan = initial(entry_point.queries()["revenue_summary_as_written"](spark, str(TESTDATA / "sf0.001")))
    keys = re.findall(r"Aggregate\(keys=\[(.*?)\], functions", plan)
    assert any("Registration_Fee" in k for k in keys) and not any("Fiscal_Quarter" in k and "Revenue" in k for k in keys)
