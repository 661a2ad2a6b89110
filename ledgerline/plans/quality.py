"""What is wrong with the inputs: counted by itself, or watched in the job that reads them anyway.

The plans fail where a result would be wrong without a word (no anchor, an account twice in a lookup, an amount that can't be
read), and keep the rest: rows without a date, of a type nobody asks for, of accounts that no lookup knows. These are counted here.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ledgerline.functions.amounts import is_amount
from ledgerline.operators.fiscal import on_day
from ledgerline.operators.opportunities import NO_PRODUCT
from ledgerline.operators.revenue import REVENUE_MEASURES
from ledgerline.schemas import SCHEMAS, Tables

# The day of a fact, by table.
DAYS = {"revenue": "Month", "opportunities": "Opportunity_Est_Date", "targets": "Fiscal_Month"}
_MONTH = "_month_id"


def _checks(table: str) -> dict[str, Column]:
    """The counts that are taken of a table's rows; those with a day have the calendar's month in ``_MONTH``."""
    def rows_with(condition: Column) -> Column:
        return F.count_if(F.coalesce(condition, F.lit(False)))

    checks = {"Rows": F.count(F.lit(1))}
    if table in DAYS:
        day = F.col(DAYS[table])
        checks |= {"Undated": rows_with(day.isNull()), "Outside_Calendar": rows_with(day.isNotNull() & F.col(_MONTH).isNull())}
    if table == "revenue":
        kind = F.col("Revenue_Type")
        checks["Unknown_Type"] = rows_with(kind.isNull() | ~kind.isin(*REVENUE_MEASURES.values()))
    if table == "opportunities":
        product = F.col("Product")
        checks |= {"No_Product": rows_with(product.isNull() | (product == NO_PRODUCT)),
                   "Unreadable_Usage": rows_with(~is_amount("Opportunity_Usage"))}
    if table in ("stores", "sellers"):
        checks["No_Account"] = rows_with(F.col({"stores": "AccountNo", "sellers": "Store_ID"}[table]).isNull())
    return checks


CHECKED = ("revenue", "opportunities", "targets", "stores", "sellers")


def _dated(tables: Tables, table: str) -> DataFrame:
    df = getattr(tables, table)
    if table not in DAYS:
        return df
    calendar = tables.calendar.select("Date_Value", F.col("Month_ID").alias(_MONTH))
    return on_day(df, DAYS[table], calendar, _MONTH)


def data_quality(tables: Tables) -> DataFrame:
    """``Table``, ``Check``, ``Rows``: a row for each check, also where no row fails it. One pass over each table."""
    def told(table: str) -> DataFrame:
        checks = _checks(table)
        counts = F.array(*[F.struct(F.lit(name).alias("Check"), count.alias("Rows")) for name, count in checks.items()])
        return _dated(tables, table).agg(counts.alias("_told")).select(F.lit(table).alias("Table"), F.inline("_told"))

    return reduce(DataFrame.unionByName, map(told, CHECKED))


def watched(tables: Tables) -> tuple[Tables, dict[str, Observation]]:
    """The tables, and the counts of ``data_quality`` for each, taken while an action on a plan over them reads the rows.

    ``observations[table].get`` has them once the action is done, without a further pass. A plan must read a table whole for
    counts of the whole; one that reads it twice, or not at all, has no counts of it.
    """
    observations = {table: Observation(table) for table in CHECKED}

    def observed(table: str):
        def open_table() -> DataFrame:
            counts = [count.alias(name) for name, count in _checks(table).items()]
            return _dated(tables, table).observe(observations[table], *counts).drop(_MONTH)
        return open_table

    sources = {table: observed(table) if table in CHECKED else getattr(tables, table) for table in SCHEMAS}
    return Tables(**sources), observations


def watched_summary(summary: DataFrame) -> tuple[DataFrame, Observation]:
    """A summary, and the counts of its rows that no lookup knows, taken while it is written or read."""
    observation = Observation("summary")
    return summary.observe(
        observation, F.count(F.lit(1)).alias("Rows"), F.count_if(F.col("Month_ID").isNull()).alias("Without_Month"),
        F.count_if(F.col("Account_Name").isNull()).alias("Without_Store"),
        F.count_if(F.col("General_Seller").isNull()).alias("Without_Seller")), observation
