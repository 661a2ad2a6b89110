"""The fiscal calendar: spines, the last month with revenue (the anchor), the months after it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def days(calendar: DataFrame, *columns: str) -> DataFrame:
    """The distinct days, with the given columns. A broadcast hint on the calendar (see ``sources``) carries over."""
    return calendar.select("Date_Value", *columns).distinct()


def on_day(facts: DataFrame, day: str, calendar: DataFrame, *columns: str) -> DataFrame:
    """``facts`` with calendar columns looked up by the date in ``day``; NULL where the calendar lacks the date."""
    spine = days(calendar, *columns)
    return facts.join(spine, facts[day] == spine["Date_Value"], "left").drop("Date_Value")


def month_attributes(calendar: DataFrame) -> DataFrame:
    """One row per month; reading it fails if the days of a month disagree on an attribute, which would multiply facts."""
    own = F.struct("Fiscal_Quarter", "Fiscal_Year", "Month_ID")
    months = calendar.groupBy("Fiscal_Month").agg(F.min(own).alias("own"), F.max(own).alias("other"))
    differ = F.raise_error(F.concat(F.lit("more than one set of attributes for the month "), F.col("Fiscal_Month")))
    one = F.when(F.col("own").eqNullSafe(F.col("other")), F.col("own")).otherwise(differ)
    return months.select("Fiscal_Month", one.alias("own")).select("Fiscal_Month", "own.*")


def name_anchor(last: DataFrame, calendar: DataFrame) -> DataFrame:
    """The one row of ``last`` with the month, Month_ID and fiscal year of its ``Anchor_Date``, and ``Future_Months``:
    the later months of that year, at most eleven, as an array.

    Everything after depends on this row, so reading it fails if the date is NULL or not in the calendar rather than
    leave the results silently empty.
    """
    months = calendar.groupBy("Fiscal_Year", "Fiscal_Month", "Month_ID").agg(F.max("Date_Value").alias("Last_Day"))
    years = months.groupBy("Fiscal_Year").agg(
        F.sort_array(F.collect_list(F.struct("Month_ID", "Fiscal_Month", "Last_Day"))).alias("Months")
    )
    found = on_day(last, "Anchor_Date", calendar, "Fiscal_Month", "Month_ID", "Fiscal_Year").join(
        years, "Fiscal_Year", "left"
    )
    no_anchor = F.raise_error(F.lit("the last date with revenue is missing from the calendar"))
    later = F.filter("Months", lambda m: (
        (m["Last_Day"] > F.col("Anchor_Date")) & (m["Fiscal_Month"] != F.col("Fiscal_Month"))
    ))
    return found.select(
        *last.columns,
        *[F.coalesce(name, no_anchor).alias(name) for name in ("Fiscal_Month", "Month_ID", "Fiscal_Year")],
        F.transform(later, lambda m: F.struct(m["Month_ID"].alias("Month_ID"), m["Fiscal_Month"].alias("Fiscal_Month")))
         .alias("Future_Months"),
    )


def anchor_month(revenue: DataFrame, calendar: DataFrame) -> DataFrame:
    """One row: the last date with non-zero revenue of any type; see ``name_anchor`` for the other columns."""
    return name_anchor(revenue.filter(F.col("Revenue") != 0).agg(F.max("Month").alias("Anchor_Date")), calendar)


def future_months(anchor: DataFrame) -> DataFrame:
    """The months of the anchor's fiscal year that come after the anchor month."""
    return anchor.select(F.inline("Future_Months"))


def with_anchor(df: DataFrame, anchor: DataFrame) -> DataFrame:
    """``df`` with the anchor's columns in the struct ``_anchor``.

    A scalar subquery: Spark runs it once per query however often it is used, and raises if the anchor has two rows,
    as when the calendar has two names for its day. Always the whole struct, so that all uses are the same subquery.
    """
    return df.withColumn("_anchor", anchor.select(F.struct("*")).scalar())
