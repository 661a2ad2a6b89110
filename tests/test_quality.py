"""Counts of what is wrong with the inputs, taken by themselves and in the jobs that read them anyway."""

from datetime import date

from conftest import bag, goal, opp, sale

from ledgerline.plans import objectives, quality, summaries

JAN = date(2019, 1, 1)


def test_each_check_counts_its_rows(make):
    t = make([sale(1, JAN, 5), sale(1, None, 5), sale(1, date(1990, 1, 1), 5, "Rebate"), sale(1, JAN, 5, None)],
             [opp(1, JAN, "n/a"), opp(1, None, "1", product="Null"), opp(1, JAN, None, product=None), opp(1, JAN, " ")],
             [goal(1, JAN, 5), goal(1, None, 5)], stores=[{"AccountNo": 1}, {"AccountNo": None}])
    assert bag(quality.data_quality(t), "Table", "Check", "Rows") == sorted([
        ("revenue", "Rows", 4), ("revenue", "Undated", 1), ("revenue", "Outside_Calendar", 1), ("revenue", "Unknown_Type", 2),
        ("opportunities", "Rows", 4), ("opportunities", "Undated", 1), ("opportunities", "Outside_Calendar", 0),
        ("opportunities", "No_Product", 2), ("opportunities", "Unreadable_Usage", 1),
        ("targets", "Rows", 2), ("targets", "Undated", 1), ("targets", "Outside_Calendar", 0),
        ("stores", "Rows", 2), ("stores", "No_Account", 1), ("sellers", "Rows", 0), ("sellers", "No_Account", 0)], key=repr)


def test_watched_counts_equal_the_query_and_leave_the_result_as_it_is(small):
    wanted = {}
    for row in quality.data_quality(small).collect():
        wanted.setdefault(row.Table, {})[row.Check] = row.Rows
    watched, observations = quality.watched(small)
    assert bag(objectives.revenue_vs_target(watched)) == bag(objectives.revenue_vs_target(small))
    assert {table: observations[table].get for table in ("revenue", "targets")} == {t: wanted[t] for t in ("revenue", "targets")}
    again, observations = quality.watched(small)
    assert summaries.opportunity_summary(again).count() == 8_661
    assert observations["opportunities"].get == wanted["opportunities"]


def test_summary_tells_of_rows_that_no_lookup_knows(small):
    summary = summaries.opportunity_summary(small)
    rows, observation = quality.watched_summary(summary)
    rows.write.format("noop").mode("overwrite").save()
    assert observation.get == {
        "Rows": 8_661, "Without_Month": summary.filter("Month_ID is null").count(),
        "Without_Store": summary.filter("Account_Name is null").count(),
        "Without_Seller": summary.filter("General_Seller is null").count()}
    assert observation.get["Without_Store"] > 0 and observation.get["Without_Month"] > 0
