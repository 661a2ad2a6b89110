import random
import re
from datetime import date
from decimal import Decimal

import pytest
from conftest import bag, goal, opp, sale
from pyspark.sql import functions as F

from ledgerline.operators.lattice import cube_by_lattice, smallest_parent
from ledgerline.plans import objectives
from ledgerline.sources import previous_week, weekly_snapshots

DEC, JAN = date(2018, 12, 1), date(2019, 1, 1)


def test_revenue_vs_target(make):
    t = make([sale(1, JAN, 5), sale(2, JAN, 1)], targets=[goal(1, JAN, 4), goal(1, DEC, 8, "Support")])
    report = objectives.revenue_vs_target(t)
    assert bag(report, "Fiscal_Month", "Product_Category", "Revenue", "Target", "Variance", "Attainment") == [
        ("December, 2018", "Support", 0, 8, -8, 0.0), ("January, 2019", "Services", 6, 4, 2, 1.5),
    ]


def test_revenue_without_a_target_has_no_attainment(make):
    assert bag(objectives.revenue_vs_target(make([sale(1, JAN, 5)])), "Attainment") == [(None,)]


def test_forecast_joins_actuals_to_expectations(make):
    t = make([sale(1, DEC, 10), sale(1, JAN, 4), sale(1, JAN, 1, "Partner Fee"), sale(1, JAN, 9, "Registration Fee")],
             [opp(1, date(2019, 5, 1), "3")])
    rows = objectives.forecast(t).orderBy("Month_ID").collect()
    assert [(r.Fiscal_Month.split(",")[0], r.Kind, int(r.Amount), int(r.Year_To_Date)) for r in rows] == [
        ("December", "Actual", 10, 10), ("January", "Actual", 5, 15), ("February", "Forecast", 5, 20),
        ("March", "Forecast", 5, 25), ("April", "Forecast", 5, 30), ("May", "Forecast", 8, 38),
        ("June", "Forecast", 8, 46),
    ]


def test_forecast_keeps_amounts_without_a_month(make):
    t = make([sale(1, DEC, 10), sale(1, JAN, 4), sale(1, None, 7), sale(1, None, 2, "Partner Fee"), sale(1, date(2001, 1, 1), 1)],
             targets=[goal(1, None, 3)])
    rows = objectives.forecast(t).collect()
    undated = [r for r in rows if r.Fiscal_Month is None]
    assert [(r.Kind, int(r.Amount), int(r.Year_To_Date), r.Month_ID) for r in undated] == [("Actual", 10, 10, None)]
    assert sum(r.Amount for r in rows if r.Kind == "Actual") == 24 and len(rows) == 8


def test_slices_tell_totals_from_missing_attributes(small):
    cube = objectives.slices(small, ["Segment"], ["Revenue"])
    by_segment = cube.filter("Grouping_ID = 0")
    assert by_segment.filter("Segment is null").count() == 1  # accounts without a store
    total = cube.filter("Grouping_ID = 1").first().Revenue
    assert total == by_segment.agg(F.sum("Revenue")).first()[0]
    assert round(float(total), 2) == 639_599_033.75


def test_slices_by_month_and_account(make):
    t = make([sale(1, DEC, 10), sale(1, JAN, 4), sale(2, JAN, 5)])
    cube = objectives.slices(t, ["Fiscal_Quarter", "Account_No"], ["Revenue"])
    assert bag(cube.filter("Grouping_ID = 1 and Revenue > 0"), "Fiscal_Quarter", "Revenue") == [("Q2", 10), ("Q3", 9)]


def _week(make, *rows):
    return make(opportunities=rows).opportunities


def test_every_kind_of_change(make):
    before = _week(make, opp(1, JAN, "5", number=1), opp(1, JAN, "5", number=2), opp(1, JAN, "5", number=3),
                   opp(1, JAN, "5", number=4), opp(1, JAN, "5", number=5))
    now = _week(make, opp(1, JAN, "5.00", number=1), opp(1, JAN, "8", number=2), opp(1, JAN, "5", number=3, stage="S2"),
                opp(1, JAN, "4", number=4, stage="S2"), opp(1, JAN, "1", number=6))
    weeks = weekly_snapshots({24: before, 25: now})
    assert bag(objectives.wow_changes(weeks), "Opportunity_ID", "Snapshot_Week", "Change_Type") == [
        (1, 25, "Same"), (2, 25, "Value changed"), (3, 25, "Stage changed"), (4, 25, "Stage and value changed"),
        (5, 25, "Closed"), (6, 25, "New"),
    ]
    assert bag(objectives.wow_measures(weeks), "Opportunity_ID", "Usage_Change", "Usage_Change_Share") == [
        (1, 0, 0.0), (2, 3, 0.6), (3, 0, 0.0), (4, -1, -0.2), (5, -5, -1.0), (6, 1, None),
    ]
    assert (25, "Services", "Closed", 1, -5) in bag(objectives.wow_totals(weeks))


def test_weeks_with_a_gap_are_compared_with_the_snapshot_before(make):
    weeks = weekly_snapshots({
        20: _week(make, opp(1, JAN, "1", number=1)),
        22: _week(make, opp(1, JAN, "2", number=1), opp(1, JAN, "9", number=2)),
        25: _week(make, opp(1, JAN, "9", number=2)),
    })
    assert bag(objectives.wow_changes(weeks), "Snapshot_Week", "Opportunity_ID", "Change_Type") == [
        (22, 1, "Value changed"), (22, 2, "New"), (25, 1, "Closed"), (25, 2, "Same"),
    ]


def test_a_repeated_opportunity_shows_one_of_its_rows_and_a_nameless_one_fails(make):
    twice = _week(make, opp(1, JAN, "1", number=1, stage="S9"), opp(1, JAN, "1", number=1, stage="S1"))
    weeks = weekly_snapshots({24: twice, 25: _week(make, opp(1, JAN, "3", number=1, stage="S9"))})
    assert bag(objectives.wow_changes(weeks), "Opportunity_Usage", "Previous_Opportunity_Usage", "Change_Type") == [
        (3, 2, "Value changed")]
    nameless = _week(make, opp(1, JAN, "1", number=None))
    with pytest.raises(Exception, match="without an Opportunity_ID"):
        objectives.wow_changes(weekly_snapshots({24: nameless, 25: nameless})).collect()


def test_one_week_has_no_changes(make):
    assert objectives.wow_changes(weekly_snapshots({25: _week(make, opp(1, JAN, "1"))})).count() == 0


def test_the_derived_week_has_every_kind_of_change(small):
    weeks = weekly_snapshots({24: previous_week(small.opportunities), 25: small.opportunities})
    kinds = {r.Change_Type for r in objectives.wow_changes(weeks).select("Change_Type").distinct().collect()}
    assert kinds == {"New", "Closed", "Same", "Stage changed", "Value changed", "Stage and value changed"}


def test_lattice_equals_a_cube(spark):
    rng = random.Random(4)
    rows = [(rng.choice("abc"), rng.choice([None, 1, 2, 3, 4]), rng.choice("xy"), Decimal(rng.randint(-9, 9))) for _ in range(300)]
    by, schema = ["p", "q", "r"], "p string, q int, r string, m decimal(28,6)"
    for part in (rows, rows[:1], []):
        df = spark.createDataFrame(part, schema)
        finest = df.groupBy(*by).agg(F.sum("m").alias("m"))
        want = df.cube(*by).agg(F.grouping_id().alias("Grouping_ID"), F.sum("m").alias("m"))
        for sizes in ({"p": 3, "q": 5, "r": 2}, {"p": 1, "q": 1, "r": 9}):
            assert bag(cube_by_lattice(finest, by, ["m"], sizes)) == bag(want)


def test_lattice_takes_the_smallest_parent():
    sizes = {"a": 3, "b": 25, "c": 10, "d": 4}
    assert smallest_parent(("b",), "abcd", sizes) == ("a", "b")
    assert smallest_parent(("a", "d"), "abcd", sizes) == ("a", "c", "d")
    assert smallest_parent((), "abcd", sizes) == ("a",)


def test_slices_expand_rows_twice_a_step_and_not_into_all_combinations(small):
    plan = objectives.slices(small, sizes=dict.fromkeys(objectives.SLICES, 2))._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan
    doubled = [line for line in plan.split("\n") if "Generate explode([false,true])" in line]
    assert len(doubled) == len(objectives.SLICES)


def test_slices_hold_accounts_that_have_targets_alone(make):
    t = make([sale(1, JAN, 5)], targets=[goal(2, JAN, 4)])
    cube = objectives.slices(t, ["Account_No"], ["Revenue"])
    assert bag(cube) == [(1, 0, 5.0), (2, 0, 0.0), (None, 1, 5.0)]


def test_forecast_is_summed_by_month_at_once(small):
    plan = objectives.forecast(small)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION" not in plan
    shuffles = {re.search(r"hashpartitioning\((.*), \d+\)", line).group(1).count("#") for line in plan.split("\n")
                if "hashpartitioning" in line and "Account_No" in line}
    assert shuffles == {4}  # accounts are shuffled for the pipeline's clamp alone, by its key and month number
