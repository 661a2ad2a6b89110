from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.functions.amounts import is_amount, parse_amount
from ledgerline.functions.categories import category_of
from ledgerline.functions.months import months_left
from ledgerline.operators.fiscal import on_day, with_anchor
from ledgerline.operators.keys import KEYS
from ledgerline.schemas import MONEY

# The text that stands for a missing product, the status of a dead project.
NO_PRODUCT = "Null"
INACTIVE = "Inactive"

DETAIL = ("Account_No", "Product_Category", "Fiscal_Month", "Product", "Opportunity_Status", "Opportunity_Stage")


def clean_opportunities(opportunities: DataFrame) -> DataFrame:
    """Opportunities that name a product, with the product's category; other columns are kept as they are."""
    product = F.col("Product")
    first = ("Store_No", "Opportunity_Est_Date", "Product")
    return opportunities.filter(product.isNotNull() & (product != NO_PRODUCT)).select(
        F.col("Store_No").alias("Account_No"),
        *first[1:],
        category_of(product).alias("Product_Category"),
        *[name for name in opportunities.columns if name not in first],
    )


def rejected_amounts(opportunities: DataFrame) -> DataFrame:
    """The opportunities whose usage is text that is no number, as they are."""
    return opportunities.filter(~is_amount("Opportunity_Usage"))


def accepted_amounts(opportunities: DataFrame) -> DataFrame:
    """The opportunities without those of ``rejected_amounts``."""
    return opportunities.filter(is_amount("Opportunity_Usage"))


def live_opportunities(
    opportunities: DataFrame, include_inactive: bool = False, amount: T.DataType = MONEY
) -> DataFrame:
    """Clean opportunities with a non-zero usage, as a number; text that is not a number is an error.

    To go on without such rows, take them out with ``accepted_amounts`` and look at ``rejected_amounts``.

    Unless ``include_inactive``, inactive projects are left out, and with them those without a status.
    """
    clean = clean_opportunities(opportunities)
    if not include_inactive:
        clean = clean.filter(F.col("Project_Status") != INACTIVE)
    return clean.withColumn("Opportunity_Usage", parse_amount("Opportunity_Usage", amount)).filter(
        F.col("Opportunity_Usage") != 0
    )


def _usage():
    return F.sum("Opportunity_Usage").alias("Opportunity_Usage")


def opportunity_monthly(opportunities: DataFrame, calendar: DataFrame) -> DataFrame:
    """Usage by account, category and the month of the estimate; one row per key, NULL month included."""
    live = live_opportunities(opportunities)
    return on_day(live, "Opportunity_Est_Date", calendar, "Fiscal_Month").groupBy(*KEYS).agg(_usage())


def months_times_usage(left, usage):
    """Usage over the months left, 0 if the usage is negative. Taken of a sum, not of its rows."""
    return F.when(usage < 0, F.lit(0)).otherwise(left.cast(T.DecimalType(2, 0)) * usage)


def extrapolate(df: DataFrame, inclusive: bool = False) -> DataFrame:
    """Adds the months left in the fiscal year and the usage extrapolated over them."""
    return df.withColumn("Extrap_Months_Left_For_FY", months_left("Fiscal_Month", inclusive)).withColumn(
        "Opportunity_Extrap", months_times_usage(F.col("Extrap_Months_Left_For_FY"), F.col("Opportunity_Usage"))
    )


def future_opportunities(opportunities: DataFrame, calendar: DataFrame, anchor: DataFrame) -> DataFrame:
    """Usage by account, category and month, of estimates after the anchor date and in its fiscal year.

    The anchor date is a day: estimates later in the anchor month count.
    """
    anchored = with_anchor(live_opportunities(opportunities), anchor)
    after = anchored.filter(F.col("Opportunity_Est_Date") > F.col("_anchor.Anchor_Date"))
    dated = on_day(after, "Opportunity_Est_Date", calendar, "Fiscal_Month", "Fiscal_Year", "Month_ID")
    in_year = dated.filter(F.col("Fiscal_Year") == F.col("_anchor.Fiscal_Year"))
    return in_year.groupBy(*KEYS, "Month_ID").agg(_usage())


def opportunity_detail(opportunities: DataFrame, calendar: DataFrame) -> DataFrame:
    """Usage by account, category, month, product, status and stage, inactive projects included; extrapolated with
    the estimate's own month counted in."""
    live = live_opportunities(opportunities, include_inactive=True)
    dated = on_day(live, "Opportunity_Est_Date", calendar, "Fiscal_Month")
    return extrapolate(dated.groupBy(*DETAIL).agg(_usage()), inclusive=True)

