from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions.months import FISCAL_MONTHS

# A daily calendar of 270 years, a few MB. Within it a calendar is broadcast whatever the planner's estimate is;
# beyond it the planner chooses.
BROADCAST_DAYS = 100_000

_CALENDAR_MONTHS = 12
_FIRST_MONTH = 7  # July, the first of FISCAL_MONTHS


def fiscal_calendar(spark: SparkSession, first: date, last: date) -> DataFrame:
    """One row per day from ``first`` to ``last``, both included.

    One partition, so that the distinct spines taken from it need no shuffle.
    """
    days = (last - first).days + 1
    day = F.date_add(F.lit(first), F.col("id").cast("int"))
    spine = spark.range(0, days, 1, 1).select(day.alias("Date_Value"))
    month = F.month("Date_Value")
    into_year = F.pmod(month - _FIRST_MONTH, F.lit(len(FISCAL_MONTHS)))
    calendar = spine.select(
        "Date_Value",
        F.date_format("Date_Value", "MMMM, yyyy").alias("Fiscal_Month"),
        F.concat(F.lit("Q"), (F.floor(into_year / 3) + 1).cast("string")).alias("Fiscal_Quarter"),
        (F.year("Date_Value") + F.when(month >= _FIRST_MONTH, 1).otherwise(0)).alias("Fiscal_Year"),
        (F.year("Date_Value") * _CALENDAR_MONTHS + month).alias("Month_ID"),
    )
    return F.broadcast(calendar) if days <= BROADCAST_DAYS else calendar


def small_calendar(calendar: DataFrame) -> DataFrame:
    """A stored calendar, marked for broadcast if it is small enough.

    The facts are joined with it row by row, before anything is summed; a shuffle of them by date would be the largest
    of the whole plan. So the size is counted, up to the limit, rather than left to an estimate that a table without
    statistics does not have.
    """
    return F.broadcast(calendar) if calendar.limit(BROADCAST_DAYS + 1).count() <= BROADCAST_DAYS else calendar
