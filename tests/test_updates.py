"""Saved summaries brought up to date, against a full rebuild."""

import random
from datetime import date
from decimal import Decimal
from pathlib import Path

import pytest
from conftest import bag, goal, opp, sale

from ledgerline.plans import summaries
from ledgerline.sources import save_summary, update_summary

TABLE = "updated_report"


@pytest.fixture
def files(spark):
    def of():
        home = Path(spark.conf.get("spark.sql.warehouse.dir").removeprefix("file:")) / TABLE
        return {(f.parent.name, f.name) for f in home.rglob("*.parquet")}

    yield of
    spark.sql(f"drop table if exists {TABLE}")


def test_only_changed_partitions_are_written(spark, files):
    schema = "Account_No long, Revenue decimal(28,6), Fiscal_Year int"
    rows = [(1, 5, 2019), (1, 5, 2019), (2, 6, 2020), (3, 7, 2021), (4, 8, None), (5, None, 2022)]

    def build(rows):
        return spark.createDataFrame([(a, None if r is None else Decimal(r), y) for a, r, y in rows], schema)

    save_summary(build(rows), TABLE)
    before = files()
    assert update_summary(build(rows), TABLE) == [] and files() == before
    # A repeat less, a year gone, a new year, and a NULL year with another amount; 2020 and 2022 stay as they are.
    later = [(1, 5, 2019), (2, 6, 2020), (4, 9, None), (5, None, 2022), (6, 1, 2023)]
    assert update_summary(build(later), TABLE) == [2019, 2021, 2023, None]
    assert bag(spark.table(TABLE).select("Account_No", "Revenue", "Fiscal_Year")) == bag(build(later))
    same = {"Fiscal_Year=2020", "Fiscal_Year=2022"}
    assert {f for f in files() if f[0] in same} == {f for f in before if f[0] in same}
    later[2] = (4, 10, None)
    assert update_summary(build(later), TABLE) == [None]
    assert bag(spark.table(TABLE).select("Account_No", "Revenue", "Fiscal_Year")) == bag(build(later))
    assert update_summary(build([r for r in later if r[2]]), TABLE) == [None]
    assert bag(spark.table(TABLE).select("Account_No", "Revenue", "Fiscal_Year")) == bag(build([r for r in later if r[2]]))
    assert update_summary(build([]), TABLE) == [2019, 2020, 2022, 2023] and spark.table(TABLE).isEmpty()
    with pytest.raises(ValueError, match="other columns"):
        update_summary(build(rows).drop("Revenue"), TABLE)


def test_random_changes_equal_a_full_rebuild(spark, make, files):
    choose = random.Random(5)
    sales = [sale(choose.randint(1, 4), date(choose.choice((2018, 2019)), choose.randint(1, 12), 1), choose.randint(-5, 50)) for _ in range(40)]
    opps = [opp(choose.randint(1, 4), date(2019, choose.randint(1, 12), 3), str(choose.randint(0, 900)), number=i) for i in range(20)]
    goals = [goal(choose.randint(1, 4), date(2020, choose.randint(1, 6), 1), 7) for _ in range(6)]
    stores = [{"AccountNo": i, "Store": f"s{i}"} for i in range(1, 5)]

    def summary():
        return summaries.revenue_summary(make(sales, opps, goals, stores, [{"Store_ID": 1, "General_Seller": "s"}]))

    save_summary(summary(), TABLE)
    for step in range(3):
        if step == 0:  # an amount of an early year only; the anchor stays
            at = next(i for i, r in enumerate(sales) if r["Month"] < date(2018, 7, 1) or r["Month"].year == 2018)
            sales[at] = sale(sales[at]["StoreNo"], sales[at]["Month"], 77)
        elif step == 1:
            opps.pop()
            goals.append(goal(2, date(2020, 6, 1), 70))
        else:
            sales.append(sale(3, date(2020, 2, 1), 11))  # moves the anchor
        update_summary(summary(), TABLE)
        want = summary()
        assert bag(spark.table(TABLE).select(*want.columns)) == bag(want)
