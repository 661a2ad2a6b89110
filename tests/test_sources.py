from datetime import date

import pytest
from conftest import bag, goal, opp, sale
from pyspark.sql import functions as F

from ledgerline.plans import facts, objectives, summaries
from ledgerline.schemas import SCHEMAS, Tables
from ledgerline.sources import (
    fiscal_calendar,
    ignoring_case,
    read_snapshots,
    read_tables,
    save_summary,
    snapshots_from_catalog,
    tables_from_catalog,
    weekly_snapshots,
    write_summary,
)
from ledgerline.sources.catalog import table_names

JAN = date(2019, 1, 1)


@pytest.fixture
def some(make):
    return make(
        [sale(1, JAN, 5), sale(2, JAN, 3, "Partner Fee", "Product")], [opp(1, date(2019, 3, 3), "1,000")],
        [goal(1, JAN, 9)], [{"AccountNo": 1, "Store": "One"}], [{"Store_ID": 1, "General_Seller": "s"}],
    )


def test_fiscal_calendar(spark):
    calendar = fiscal_calendar(spark, date(2018, 6, 30), date(2019, 7, 1))
    rows = {r.Date_Value: r for r in calendar.collect()}
    assert len(rows) == 367
    assert tuple(rows[date(2018, 6, 30)])[1:] == ("June, 2018", "Q4", 2018, 2018 * 12 + 6)
    assert tuple(rows[date(2018, 7, 1)])[1:] == ("July, 2018", "Q1", 2019, 2018 * 12 + 7)
    assert tuple(rows[date(2019, 1, 31)])[1:] == ("January, 2019", "Q3", 2019, 2019 * 12 + 1)


def test_derived_tables_have_the_declared_columns_and_types(tiny):
    for table, schema in SCHEMAS.items():
        df = getattr(tiny, table)
        assert df.columns == schema.names
        for field in schema:
            if field.name != "Target":  # a sum, and so a wider decimal
                assert df.schema[field.name].dataType == field.dataType, field.name


@pytest.mark.parametrize("format", ["parquet", "orc", "json", "csv"])
def test_tables_can_be_read_back(spark, some, tmp_path, format):
    for table, name in table_names(25).items():
        writer = getattr(some, table).write.format(format)
        (writer.option("header", True) if format == "csv" else writer).save(str(tmp_path / name))
    back = read_tables(spark, str(tmp_path), week=25, format=format)
    assert bag(summaries.revenue_summary(back)) == bag(summaries.revenue_summary(some))


def test_tables_from_a_database_and_views(spark, some):
    spark.sql("create database if not exists sales")
    for table, name in table_names(25).items():
        getattr(some, table).write.mode("overwrite").saveAsTable(f"sales.{name}")
    stored = tables_from_catalog(spark, week=25, database="sales")
    names = summaries.create_views(spark, stored, prefix="report_")
    assert names == ["report_Revenue_Summary", "report_Opportunity_Summary"]
    assert bag(spark.sql("select * from report_Revenue_Summary")) == bag(summaries.revenue_summary(some))
    assert bag(spark.table("report_Opportunity_Summary")) == bag(summaries.opportunity_summary(some))

    spark.sql("use sales")
    try:
        current = tables_from_catalog(spark, week=25)
        assert bag(facts.all_facts(current)) == bag(facts.all_facts(some))
    finally:
        spark.sql("use default")


def test_summary_is_written_by_fiscal_year(spark, small, tmp_path):
    path = str(tmp_path / "out")
    summary = summaries.opportunity_summary(small)
    write_summary(summary, path)
    back = spark.read.parquet(path).select(*summary.columns)
    assert bag(back) == bag(summary)
    one_year = spark.read.parquet(path).filter("Fiscal_Year = 1999")
    assert "PartitionFilters: [isnotnull(Fiscal_Year" in one_year._jdf.queryExecution().executedPlan().toString()
    assert one_year.count() == summary.filter("Fiscal_Year = 1999").count()


def test_a_summary_and_weeks_outlive_the_session(spark, some, make):
    spark.sql("create database if not exists kept")
    summary = summaries.revenue_summary(some)
    for _ in range(2):
        save_summary(summary, "kept.Revenue_Report")
    other = spark.newSession()
    assert bag(other.table("kept.Revenue_Report").select(*summary.columns)) == bag(summary)
    assert other.sql("show partitions kept.Revenue_Report").count() > 0

    for week, usage in ((24, "1,000"), (25, "2,000")):
        week_before = make(opportunities=[opp(1, date(2019, 3, 3), usage)])
        for table, name in table_names(week).items():
            getattr(week_before, table).write.mode("overwrite").saveAsTable(f"kept.{name}")
    weeks = snapshots_from_catalog(spark, (24, 25), database="kept")
    want = [(25, "Value changed")]
    assert bag(objectives.wow_changes(weeks), "Snapshot_Week", "Change_Type") == want
    assert bag(objectives.wow_changes(weeks, (25, 24)), "Snapshot_Week", "Change_Type") == want


def test_snapshots_by_week(spark, some, tmp_path):
    weeks = weekly_snapshots({25: some.opportunities, 24: some.opportunities.filter("false")})
    assert bag(weeks, "Snapshot_Week") == [(25,)]
    weeks.write.partitionBy("Snapshot_Week").parquet(str(tmp_path / "weeks"))
    assert bag(read_snapshots(spark, str(tmp_path / "weeks"))) == bag(weeks)


def test_case_counts_unless_told_otherwise(make):
    t = make([sale(1, JAN, 5, "ACTUALS", "service desk"), sale(1, JAN, 6, "Actuals", "Service")],
             [opp(1, date(2019, 3, 3), "7", "SUPPORT", "inactive"), opp(1, date(2019, 3, 3), "8", "null")],
             [goal(1, JAN, 3, "SERVICES"), goal(1, JAN, 4, "Other")])
    columns = ("Product_Category", "Revenue", "Target")
    january = F.col("Fiscal_Month") == "January, 2019"
    assert bag(facts.all_facts(t).filter(january), *columns) == [
        ("Need Mapping", 0, 0), ("Other", 0, 4), ("SERVICES", 0, 3), ("Services", 6, 0),
    ]
    folded = ignoring_case(t)
    for plan in (facts.all_facts, facts.all_facts_joined):
        assert bag(plan(folded).filter(january), *columns) == [("Other", 0, 4), ("Services", 11, 3)]
        assert bag(plan(folded).filter("Opportunity_Usage <> 0")) == []
    assert summaries.opportunity_summary(t).count() == 2
    assert summaries.opportunity_summary(folded).count() == 1


def test_tables_open_at_first_use(make):
    opened = []
    parts = {name: (lambda name=name: opened.append(name) or getattr(make(), name)) for name in SCHEMAS}
    tables = Tables(**parts)
    assert opened == []
    assert tables.stores is tables.stores and opened == ["stores"]
    with pytest.raises(TypeError):
        Tables(revenue=tables.stores)
    with pytest.raises(AttributeError):
        tables.nothing


def test_a_calendar_is_broadcast_up_to_its_limit_only(spark, make, monkeypatch):
    from ledgerline.sources import calendars

    stored = make().calendar.select("*")
    plain = spark.createDataFrame(stored.collect(), stored.schema)
    days = plain.count()
    seen = {}
    for limit in (days, days - 1):
        monkeypatch.setattr(calendars, "BROADCAST_DAYS", limit)
        made = fiscal_calendar(spark, date(2018, 7, 1), date(2020, 6, 30))
        hinted = ["ResolvedHint" in df._jdf.queryExecution().analyzed().toString() for df in (made, calendars.small_calendar(plain))]
        seen[limit] = (hinted, made.count())
    assert seen == {days: ([True, True], days), days - 1: ([False, False], days)}
