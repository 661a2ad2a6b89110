from datetime import date

import pytest
from conftest import bag, goal, opp, sale
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerline.operators import expand_copies
from ledgerline.operators.keys import AS_WRITTEN, KEYS
from ledgerline.plans import facts, summaries

# Rows at each stage: as written, corrected; at sf0.001 and sf0.01.
COUNTS = {
    "tiny": {
        "aligned_revenue": (168_318, 5_564),
        "revenue_with_opportunities": (168_808, 6_054),
        "baseline_of": (10_695, 345),
        "baseline_with_targets": (12_156, 1_806),
        "runrate_of": (115, 113),
        "expectations": (12_252, 1_900),
        "all_facts_joined": (217_027, 7_531),
    },
    "small": {
        "aligned_revenue": (1_683_152, 55_603),
        "revenue_with_opportunities": (1_688_143, 60_594),
        "baseline_of": (99_355, 3_205),
        "baseline_with_targets": (113_901, 17_750),
        "runrate_of": (1_367, 1_321),
        "expectations": (115_148, 18_801),
        "all_facts_joined": (2_134_573, 75_011),
    },
}


@pytest.mark.parametrize("size", COUNTS)
def test_row_counts(request, size):
    tables = request.getfixturevalue(size)
    for name, (as_written, corrected) in COUNTS[size].items():
        stage = getattr(facts, name)
        assert stage(tables).count() == corrected, name
        written = stage(tables, AS_WRITTEN)
        assert (expand_copies(written) if "Copies" in written.columns else written).count() == as_written, name


def test_totals_are_those_of_the_inputs(small):
    total = facts.all_facts(small).agg(*[F.sum(m).cast("double").alias(m) for m in facts.MEASURES]).first()
    assert round(total.Revenue, 2) == 639_599_033.75
    assert round(total.Target, 2) == 3_758_439_620.06
    assert round(total.Baseline, 2) == 121_038_004.2
    assert round(total.Opportunity_Into_RR, 2) == 253_780_438.33
    written = facts.all_facts_as_written(small).agg(F.sum(F.col("Revenue") * F.col("Copies")).cast("double")).first()
    assert round(written[0], 2) == 19_317_379_156.41


def test_corrected_keys_are_unique_and_lookups_keep_the_rows(small):
    merged = facts.all_facts(small)
    whole = merged.filter(F.col("Fiscal_Month").isNotNull())
    assert whole.count() == whole.select(*KEYS).distinct().count()
    assert summaries.revenue_summary(small).count() == merged.count() == 75_011
    assert len(summaries.revenue_summary(small).columns) == 24


def test_opportunity_summary(small):
    summary = summaries.opportunity_summary(small)
    assert summary.count() == 8_661 and len(summary.columns) == 24
    nowhere = summary.filter(F.col("Fiscal_Month").isNull())
    assert nowhere.count() > 0
    missing = nowhere.filter("Opportunity_Usage > 0").select("Opportunity_Extrap_Range").distinct()
    assert bag(missing) == [("200,000 +",)]


def test_as_written_summary_has_the_repeated_rows(tiny):
    assert summaries.revenue_summary(tiny, AS_WRITTEN).count() == 217_027
    assert len(summaries.revenue_summary(tiny, AS_WRITTEN).columns) == 24


def test_as_written_revenue_off_the_first_of_the_month_finds_no_month(make):
    t = make([sale(1, date(2019, 1, 15), 5), sale(1, date(2019, 2, 1), 6)])
    assert bag(facts.aligned_revenue(t, AS_WRITTEN), "Fiscal_Month", "Revenue", "Copies") == [
        ("February, 2019", 6, 28), (None, 5, 1),
    ]


def test_dates_in_one_month_become_one_row(make):
    t = make([sale(1, date(2019, 1, 15), 5), sale(1, date(2019, 1, 2), 6)], targets=[
        goal(1, date(2019, 1, 1), 1), goal(1, date(2019, 1, 9), 2)])
    assert bag(facts.all_facts(t).filter("Fiscal_Month = 'January, 2019'"), "Revenue", "Target") == [(11, 3)]


DAYS = st.sampled_from([date(2018, 12, 1), date(2019, 1, 1), date(2019, 1, 20), date(2019, 3, 1), date(2019, 5, 9),
                        date(2019, 8, 1), date(1990, 1, 1), None])
STORES = st.sampled_from([1, 2, None])
KINDS = st.sampled_from(["Service", "Support", "Other", None])
SALES = st.lists(st.builds(sale, STORES, DAYS, st.integers(-2, 3),
                           st.sampled_from(["Actuals", "Partner Fee", "Registration Fee", "?"]), KINDS), max_size=8)
OPPS = st.lists(st.builds(opp, STORES, DAYS, st.sampled_from(["-5", "0", "7", "1,000", ""]), KINDS,
                          st.sampled_from(["Active", "Inactive", None])), max_size=8)
GOALS = st.lists(st.builds(goal, STORES, DAYS, st.integers(0, 9), st.sampled_from(["Services", "Support", None])),
                 max_size=6)


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(sales=SALES, opps=OPPS, goals=GOALS)
def test_one_pass_plans_equal_the_chains_of_full_joins(make, sales, opps, goals):
    # January 2019 is the anchor: other dates have to be earlier, or without revenue.
    fixed = [s | {"Revenue": 0} if s["Month"] is None or s["Month"] > date(2019, 1, 31) else s for s in sales]
    t = make([*fixed, sale(9, date(2019, 1, 20), 1)], opps, goals)
    assert bag(facts.all_facts(t)) == bag(facts.all_facts_joined(t))

    def repeated(df):
        return bag(expand_copies(df).select(*KEYS, *facts.MEASURES))

    assert repeated(facts.all_facts_as_written(t)) == repeated(facts.all_facts_joined(t, AS_WRITTEN))
