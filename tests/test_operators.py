import random
from datetime import date
from decimal import Decimal

import pytest
from conftest import bag, goal, opp, sale
from pyspark.sql import functions as F

from ledgerline import operators as ops
from ledgerline.plans import facts

JAN, FEB = date(2019, 1, 1), date(2019, 2, 1)
AFTER_JAN = ["April, 2019", "February, 2019", "June, 2019", "March, 2019", "May, 2019"]


def test_revenue_is_renamed_split_and_bucketed(make):
    t = make([sale(1, JAN, 5, "Partner Fee", "Support Desk"), sale(1, JAN, 7, "Other")])
    renamed = ops.rename_revenue(t.revenue)
    assert renamed.columns == [
        "Account_No", "Fiscal_Month", "Revenue_Type", "Revenue_Motion", "Product_Category", "Account_Motion", "Revenue",
    ]
    split = ops.split_measures(renamed)
    assert bag(split, "Revenue", "Partner_Fee", "Registration_Fee") == [(0, 0, 0), (0, 5, 0)]
    bucketed = ops.bucket_category(split, "Product_Category", "Product_Category_2")
    assert bag(bucketed, "Product_Category", "Product_Category_2") == [
        ("Service", "Services"), ("Support Desk", "Support"),
    ]


def test_revenue_monthly_sums_by_account_date_and_category(make):
    t = make([sale(1, JAN, 5), sale(1, JAN, 6), sale(1, JAN, 2, "Registration Fee"), sale(1, FEB, 1), sale(2, JAN, 1)])
    assert bag(ops.revenue_monthly(t.revenue)) == [
        (1, JAN, "Services", 11, 0, 2), (1, FEB, "Services", 1, 0, 0), (2, JAN, "Services", 1, 0, 0),
    ]


def test_opportunities_need_a_product(make):
    t = make(opportunities=[opp(1, JAN, "5", p) for p in (None, "Null", "null", "Support Desk")])
    assert bag(ops.clean_opportunities(t.opportunities), "Product", "Product_Category") == [
        ("Support Desk", "Support"), ("null", "Need Mapping"),
    ]


def test_usage_is_parsed_before_it_is_tested(make):
    usages = ["0", "0.00", "1,500", "-2", "", None]
    t = make(opportunities=[opp(i, JAN, u) for i, u in enumerate(usages)])
    assert bag(ops.live_opportunities(t.opportunities), "Opportunity_Usage") == [(-2,), (1500,)]


def test_amounts_that_are_none_are_an_error_unless_taken_out(make):
    t = make(opportunities=[opp(1, JAN, "$500"), opp(2, JAN, "7"), opp(3, JAN, "0.004")])
    with pytest.raises(Exception, match="not an amount"):
        ops.live_opportunities(t.opportunities).collect()
    assert bag(ops.rejected_amounts(t.opportunities), "Store_No") == [(1,)]
    assert bag(ops.live_opportunities(ops.accepted_amounts(t.opportunities)), "Account_No") == [(2,), (3,)]


def test_inactive_and_missing_status_are_left_out_unless_wanted(make):
    t = make(opportunities=[opp(1, JAN, "1", status=s) for s in ("Active", "Inactive", None)])
    assert ops.live_opportunities(t.opportunities).count() == 1
    assert ops.live_opportunities(t.opportunities, include_inactive=True).count() == 3


def test_negative_is_zeroed_after_the_sum(make):
    t = make(opportunities=[opp(1, JAN, "-10"), opp(1, JAN, "30"), opp(2, JAN, "-5"), opp(3, date(1990, 1, 1), "4")])
    extrapolated = ops.extrapolate(ops.opportunity_monthly(t.opportunities, t.calendar))
    assert bag(extrapolated, "Account_No", "Fiscal_Month", "Opportunity_Usage", "Opportunity_Extrap") == [
        (1, "January, 2019", 20, 100), (2, "January, 2019", -5, 0), (3, None, 4, None),
    ]


def test_detail_keeps_inactive_projects_and_counts_the_own_month(make):
    t = make(opportunities=[opp(1, JAN, "10", status="Inactive"), opp(1, JAN, "5", status=None)])
    detail = ops.opportunity_detail(t.opportunities, t.calendar)
    assert bag(detail, "Opportunity_Usage", "Extrap_Months_Left_For_FY", "Opportunity_Extrap") == [(15, 6, 90)]


def test_anchor_is_the_last_date_with_nonzero_revenue_of_any_type(make):
    t = make([sale(1, JAN, 5, "Unknown type"), sale(1, FEB, 0), sale(1, date(2018, 9, 1), 9)])
    anchor = ops.anchor_month(t.revenue, t.calendar)
    assert bag(anchor.drop("Future_Months")) == [(JAN, "January, 2019", 2019 * 12 + 1, 2019)]
    assert bag(ops.future_months(anchor), "Fiscal_Month") == [(m,) for m in AFTER_JAN]


@pytest.mark.parametrize("rows", [[], [sale(1, JAN, 0)], [sale(1, date(1990, 1, 1), 5)]])
def test_a_missing_anchor_fails_loudly(make, rows):
    t = make(rows)
    for result in (facts.anchor_of(t), facts.baseline_of(t), facts.all_facts(t)):
        with pytest.raises(Exception, match="missing from the calendar"):
            result.collect()


def test_two_names_for_the_anchor_day_fail_loudly(make):
    t = make([sale(1, JAN, 5)])
    twice = t.calendar.unionByName(t.calendar.withColumn("Fiscal_Month", F.lit("January, 2020")))
    with pytest.raises(Exception, match="(?i)scalar.?subquery.*(more than one row|too.?many)"):
        ops.baseline(facts.aligned_revenue(t), ops.anchor_month(t.revenue, twice)).collect()


def test_baseline_carries_revenue_and_partner_fee_but_not_registration_fee(make):
    t = make([sale(1, JAN, 5), sale(1, JAN, 2, "Partner Fee"), sale(1, JAN, 9, "Registration Fee"),
              sale(2, JAN, 9, "Registration Fee"), sale(3, date(2018, 12, 1), 8)])
    assert bag(facts.baseline_of(t), "Account_No", "Fiscal_Month", "Baseline") == [
        *[(1, m, 7) for m in AFTER_JAN], *[(2, m, 0) for m in AFTER_JAN],
    ]


def test_average_baseline_of_one_month_is_the_baseline(small):
    from ledgerline.plans.objectives import average_baseline
    columns = ("Account_No", "Fiscal_Month", "Product_Category", "Baseline")
    assert bag(average_baseline(small, 1), *columns) == bag(facts.baseline_of(small), *columns)


def test_average_baseline_counts_missing_months_as_zero(make):
    from ledgerline.plans.objectives import average_baseline
    t = make([sale(1, JAN, 6), sale(1, date(2018, 11, 1), 3), sale(1, date(2018, 10, 1), 100)])
    assert set(bag(average_baseline(t, 3), "Baseline")) == {(3.0,)}


def test_runrate_starts_at_the_estimates_own_month(make):
    t = make([sale(1, JAN, 5)], [opp(1, date(2019, 4, 10), "10"), opp(1, date(2019, 5, 3), "-4"),
                                  opp(2, date(2019, 7, 1), "9"), opp(3, JAN, "9"), opp(4, date(2019, 1, 20), "2")])
    rows = bag(facts.runrate_of(t), "Account_No", "Fiscal_Month", "Opportunity_Into_RR")
    # Next fiscal year (2) and the anchor day itself (3) do not count; later in the anchor month (4) does.
    assert rows == sorted([
        (1, "April, 2019", 10), (1, "May, 2019", 10), (1, "June, 2019", 10), *[(4, m, 2) for m in AFTER_JAN],
    ], key=repr)
    assert facts.runrate_of(t, "as_written").count() == 3 + 2 + 5


def test_targets_keep_their_group_and_get_a_month_name(make):
    t = make(targets=[goal(1, JAN, 5, "Whatever"), goal(1, date(1990, 1, 1), 6)])
    assert bag(ops.align_targets(t.targets, t.calendar)) == [
        (1, "Services", None, 6), (1, "Whatever", "January, 2019", 5),
    ]


def test_unknown_mode_is_refused(tiny):
    with pytest.raises(ValueError, match="mode"):
        facts.aligned_revenue(tiny, "fixed")


def test_lookups_keep_every_row_and_leave_unmatched_ones_empty(make):
    t = make([sale(1, JAN, 5), sale(2, JAN, 6), sale(None, JAN, 7)],
             stores=[{"AccountNo": 1, "Store": "One"}, *[{"AccountNo": None, "Store": s} for s in "xy"]],
             sellers=[{"Store_ID": 2, "General_Seller": "Two"}])
    done = ops.add_lookups(facts.aligned_revenue(t), t.calendar, t.stores, t.sellers)
    assert bag(done, "Account_No", "Fiscal_Quarter", "Account_Name", "General_Seller") == [
        (1, "Q3", "One", None), (2, "Q3", None, "Two"), (None, "Q3", None, None),
    ]


@pytest.mark.parametrize("lookup, key", [("stores", "AccountNo"), ("sellers", "Store_ID")])
def test_an_account_twice_in_a_lookup_fails_loudly(make, lookup, key):
    t = make([sale(1, JAN, 5)], **{lookup: [{key: 1}, {key: 1}]})
    with pytest.raises(Exception, match="more than once"):
        ops.add_lookups(facts.aligned_revenue(t), t.calendar, t.stores, t.sellers).collect()


def test_peek_and_distinct(tiny):
    assert ops.peek(tiny.stores, 3).count() == 3
    assert ops.distinct_values(tiny.targets, "Service_Comp_Group").count() == 3


def test_runrate_by_running_sums_equals_a_row_for_each_pair_of_months(spark, make):
    """Corrected mode against the as-written rows summed by key, on many random estimates, ids with gaps and NULL accounts."""
    rng = random.Random(9)
    t = make([sale(1, date(2018, 11, 1), 5)])
    anchor = facts.anchor_of(t)
    rows = [(rng.choice([None, 1, 2, 3]), rng.choice(["Services", "Support"]), None, rng.randint(24227, 24235),
             Decimal(rng.randint(-30, 30)) / 3) for _ in range(60)]
    estimates = spark.createDataFrame(
        rows, "Account_No long, Product_Category string, Fiscal_Month string, Month_ID int, Opportunity_Usage decimal(38,6)")
    one_each = estimates.groupBy("Account_No", "Product_Category", "Month_ID").agg(F.sum("Opportunity_Usage").alias("Opportunity_Usage"))
    pairs = ops.spread_runrate(one_each, anchor, "as_written").groupBy("Account_No", "Fiscal_Month", "Product_Category").agg(
        F.sum("Opportunity_Into_RR").alias("Opportunity_Into_RR"))
    assert bag(ops.spread_runrate(one_each, anchor)) == bag(pairs) and pairs.count() > 30
    assert ops.spread_runrate(one_each.filter("false"), anchor).count() == 0
