from __future__ import annotations

import sys
from datetime import date
from decimal import Decimal
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pyspark.sql import SparkSession  # noqa: E402

from ledgerline import schemas  # noqa: E402
from ledgerline.schemas import Tables  # noqa: E402
from ledgerline.sources import fiscal_calendar  # noqa: E402

import __spark_entry__ as entry_point  # noqa: E402

TESTDATA = Path("/root/testdata")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    home = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", str(home / "warehouse"))
        .config("spark.sql.catalogImplementation", "in-memory")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tiny(spark):
    return entry_point._tables(spark, str(TESTDATA / "sf0.001"))


@pytest.fixture(scope="session")
def small(spark):
    return entry_point._tables(spark, str(TESTDATA / "sf0.01"))


def _rows(spark, schema, rows):
    """Rows given as dicts; columns left out are NULL, amounts may be ints or text."""
    def value(field, row):
        got = row.get(field.name)
        return Decimal(str(got)) if got is not None and field.dataType == schemas.MONEY else got

    return spark.createDataFrame([tuple(value(f, r) for f in schema) for r in rows], schema)


@pytest.fixture(scope="session")
def make(spark):
    """Six tables from a few literal rows. The calendar runs from July 2018 to June 2020."""
    def build(revenue=(), opportunities=(), targets=(), stores=(), sellers=()):
        return Tables(
            revenue=_rows(spark, schemas.REVENUE, revenue),
            opportunities=_rows(spark, schemas.OPPORTUNITIES, opportunities),
            targets=_rows(spark, schemas.TARGETS, targets),
            calendar=fiscal_calendar(spark, date(2018, 7, 1), date(2020, 6, 30)),
            stores=_rows(spark, schemas.STORES, stores),
            sellers=_rows(spark, schemas.SELLERS, sellers),
        )
    return build


def sale(store, month, amount, kind="Actuals", category="Service"):
    return {"StoreNo": store, "Month": month, "Revenue_Type": kind, "Product_Category": category, "Revenue": amount}


def opp(store, day, usage, product="Service", status="Active", number=1, stage="Stage 1"):
    return {
        "Store_No": store, "Opportunity_Est_Date": day, "Product": product, "Opportunity_ID": number,
        "Project_Status": status, "Opportunity_Status": "O", "Opportunity_Stage": stage, "Opportunity_Usage": usage,
    }


def goal(store, day, amount, group="Services"):
    return {"Store_Number": store, "Fiscal_Month": day, "Service_Comp_Group": group, "Target": amount}


def bag(df, *columns):
    """The rows as a sorted list, amounts as floats."""
    def plain(value):
        return float(value) if isinstance(value, Decimal) else value

    rows = df.select(*columns).collect() if columns else df.collect()
    return sorted((tuple(plain(v) for v in row) for row in rows), key=repr)
