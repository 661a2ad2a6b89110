from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.categories import CATEGORY_RULES, UNMAPPED, category_of
from ledgerline.operators.fiscal import on_day
from ledgerline.operators.keys import COPIES, CORRECTED, KEYS, check_mode
from ledgerline.operators.merge import one_row_per_key

# Measure, and the revenue type that feeds it.
REVENUE_MEASURES = {
    "Revenue": "Actuals",
    "Partner_Fee": "Partner Fee",
    "Registration_Fee": "Registration Fee",
}


def rename_revenue(revenue: DataFrame) -> DataFrame:
    return revenue.withColumnsRenamed({"StoreNo": "Account_No", "Month": "Fiscal_Month", "Motion": "Account_Motion"})


def split_measures(
    df: DataFrame,
    type_col: str = "Revenue_Type",
    value_col: str = "Revenue",
    mapping: Mapping[str, str] = REVENUE_MEASURES,
) -> DataFrame:
    """One column per measure in place of ``value_col``: the value where the row is of the measure's type, else 0."""
    kept = [name for name in df.columns if name != value_col]
    zero = F.lit(0).cast(df.schema[value_col].dataType)
    return df.select(*kept, *[
        F.when(F.col(type_col) == kind, F.col(value_col)).otherwise(zero).alias(measure)
        for measure, kind in mapping.items()
    ])


def bucket_category(
    df: DataFrame,
    col: str,
    into: str,
    rules: Sequence[tuple[str, str]] = CATEGORY_RULES,
    default: str = UNMAPPED,
) -> DataFrame:
    return df.withColumn(into, category_of(col, rules, default))


def revenue_lines(revenue: DataFrame, *more: str) -> DataFrame:
    """Revenue rows in the common vocabulary, with their category and the three measures; nothing summed yet."""
    lines = bucket_category(rename_revenue(revenue), "Product_Category", "Product_Category")
    return split_measures(lines).select(*KEYS, *REVENUE_MEASURES, *more)


def revenue_monthly(revenue: DataFrame) -> DataFrame:
    """The measures by account, date and category. One shuffle, after Spark's map-side partial sums."""
    return revenue_lines(revenue).groupBy(*KEYS).agg(*[F.sum(m).alias(m) for m in REVENUE_MEASURES])


def align_revenue(revenue: DataFrame, calendar: DataFrame, mode: str = CORRECTED) -> DataFrame:
    """Revenue with the calendar's name of the month in place of the date.

    ``revenue`` has a date in ``Fiscal_Month``: the lines, or the same already summed. Corrected mode names the month
    by the date and sums once, straight to one row per key; giving it lines saves the shuffle of a sum by date.

    As written, the month's name is read as the date of its first day and compared with the revenue date, and as the
    calendar is daily each match repeats the row once per day of the month. Here that number is put in ``Copies``
    instead, to be shuffled as one row; ``expand_copies`` gives the rows themselves.
    """
    if not check_mode(mode):
        dated = revenue.withColumnRenamed("Fiscal_Month", "Revenue_Date")
        return one_row_per_key(on_day(dated, "Revenue_Date", calendar, "Fiscal_Month").drop("Revenue_Date"))

    months = (
        calendar.select("Date_Value", "Fiscal_Month").distinct()
        .groupBy("Fiscal_Month").agg(F.count("*").alias(COPIES))
        .withColumn("First_Day", F.to_date("Fiscal_Month", "MMMM, yyyy"))
    )
    measures = [name for name in revenue.columns if name not in KEYS]
    return (
        revenue.alias("r")
        .join(months.alias("m"), F.col("r.Fiscal_Month") == F.col("m.First_Day"), "left")
        .select(
            "r.Account_No", "m.Fiscal_Month", "r.Product_Category", *measures,
            F.coalesce(f"m.{COPIES}", F.lit(1)).alias(COPIES),
        )
    )
