"""What the remaining months of the fiscal year are expected to bring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.functions.amounts import zero_if_negative
from ledgerline.operators.fiscal import on_day, with_anchor
from ledgerline.operators.keys import COPIES, CORRECTED, check_mode

# The type of a sum of amounts.
RUNNING = T.DecimalType(38, 6)


def _on_months(df: DataFrame, months: Column, *columns) -> DataFrame:
    """Each row once per month of the array ``months``: row by row, with neither a join nor a shuffle."""
    return df.withColumn("_month", F.explode(months)).select(
        "Account_No", F.col("_month.Fiscal_Month").alias("Fiscal_Month"), "Product_Category", *columns
    )


def baseline(aligned: DataFrame, anchor: DataFrame) -> DataFrame:
    """The anchor month's Revenue + Partner_Fee of each account and category, on every future month.

    ``aligned`` comes from ``align_revenue``, in either mode.
    """
    last = with_anchor(aligned, anchor).filter(F.col("Fiscal_Month") == F.col("_anchor.Fiscal_Month"))
    amount = (F.col("Partner_Fee") + F.col("Revenue")).alias("Baseline")
    copies = [COPIES] if COPIES in aligned.columns else []
    return _on_months(last, F.col("_anchor.Future_Months"), amount, *copies)


def baseline_average(lines: DataFrame, calendar: DataFrame, anchor: DataFrame, months: int = 3) -> DataFrame:
    """The mean of Revenue + Partner_Fee over the last ``months`` months up to the anchor, on every future month.

    A definition of our own: a month without revenue counts as 0, so the divisor is always ``months``. The mean is a
    double. With one month it equals ``baseline``. ``lines`` comes from ``revenue_lines``.
    """
    dated = on_day(lines.withColumnRenamed("Fiscal_Month", "Revenue_Date"), "Revenue_Date", calendar, "Month_ID")
    # By the order of the calendar's months: their numbers need not follow each other without a gap.
    ids = calendar.agg(F.sort_array(F.collect_set("Month_ID"), asc=False)).scalar()
    up_to_anchor = F.filter("_ids", lambda number: number <= F.col("_anchor.Month_ID"))
    window = with_anchor(dated, anchor).withColumn("_ids", ids).filter(
        F.array_contains(F.slice(up_to_anchor, 1, months), F.col("Month_ID")))
    total = window.groupBy("Account_No", "Product_Category").agg(
        F.sum(F.col("Partner_Fee") + F.col("Revenue")).alias("Total")
    )
    mean = (F.col("Total").cast("double") / months).alias("Baseline")
    return _on_months(with_anchor(total, anchor), F.col("_anchor.Future_Months"), mean)


def spread_runrate(future_opportunities: DataFrame, anchor: DataFrame, mode: str = CORRECTED) -> DataFrame:
    """The usage of each account, category and estimate month, on every future month from its own on; 0 if negative.

    As written, one row per estimate month remains, so that a key can repeat. Corrected mode sums them: the estimate months
    of an account and category, at most twelve, are shuffled as they are and gathered in an array, and one running sum over
    the future months gives each its amount. So there is no row for each pair of months, and none is shuffled.
    """
    clamped = zero_if_negative(F.col("Opportunity_Usage"))
    if check_mode(mode):
        own = F.col("Month_ID")
        return _on_months(
            with_anchor(future_opportunities, anchor),
            F.filter("_anchor.Future_Months", lambda month: month["Month_ID"] >= own),
            clamped.alias("Opportunity_Into_RR"),
        )
    amounts = future_opportunities.groupBy("Account_No", "Product_Category").agg(
        F.collect_list(F.struct(F.col("Month_ID"), clamped.alias("Amount"))).alias("_amounts"))
    return _on_months(
        with_anchor(amounts, anchor), running_sums(F.col("_anchor.Future_Months"), F.col("_amounts")),
        F.col("_month.Total").alias("Opportunity_Into_RR"))


def running_sums(months: Column, amounts: Column) -> Column:
    """Of ``months`` in order of their Month_ID, those from the first of ``amounts`` (Month_ID, Amount) on, each with ``Total``:
    the sum of the amounts up to it. An amount counts once, in the step from the month before."""
    total = F.lit(0).cast(RUNNING)
    out = "array<struct<Month_ID:int,Fiscal_Month:string,Total:decimal(38,6)>>"
    start = F.struct(total.alias("Total"), F.lit(None).cast("int").alias("Upto"), F.array().cast(out).alias("Months"))

    def step(state: Column, month: Column) -> Column:
        new = F.filter(amounts, lambda a: (a["Month_ID"] <= month["Month_ID"])
                       & (F.isnull(state["Upto"]) | (a["Month_ID"] > state["Upto"])))
        now = F.aggregate(new, state["Total"], lambda sum_, a: (sum_ + a["Amount"]).cast(RUNNING))
        row = F.struct(month["Month_ID"].cast("int").alias("Month_ID"), month["Fiscal_Month"].alias("Fiscal_Month"),
                       now.alias("Total"))
        return F.struct(now.alias("Total"), month["Month_ID"].cast("int").alias("Upto"),
                        F.concat(state["Months"], F.array(row)).alias("Months"))

    first = F.array_min(F.transform(amounts, lambda a: a["Month_ID"]))
    return F.filter(F.aggregate(months, start, step, lambda state: state["Months"]), lambda m: m["Month_ID"] >= first)
