"""The six tables, derived from the order-processing test tables.

All years are read. Revenue is zero from February 1999, so January 1999 is the last month with revenue, and five months of
fiscal year 1999 remain; opportunities and targets go on beyond it. The expressions plant the cases that the operators must get right:
missing and unmapped products, inactive and missing statuses, zero and negative amounts, parts of a cent, text that is no
amount, dates that are missing or outside the calendar (of opportunities, revenue and targets), accounts without a store or a
seller.
"""

from __future__ import annotations

from datetime import date
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.schemas import MONEY, Tables
from ledgerline.sources.calendars import fiscal_calendar

REVENUE_ENDS = date(1999, 2, 1)
CALENDAR_START, CALENDAR_END = date(1995, 1, 1), date(2002, 6, 30)
OUTSIDE_CALENDAR = date(1990, 1, 1)
NO_AMOUNT = "n/a"


def _choose(col: str, mapping: dict[str, str], default: str | None = None):
    cases = F
    for value, result in mapping.items():
        cases = cases.when(F.col(col) == value, F.lit(result))
    return cases.otherwise(F.lit(default))


def _month_start(day: str):
    return F.trunc(F.col(day).cast("date"), "month")


def revenue(lineitem: DataFrame, orders: DataFrame, part: DataFrame) -> DataFrame:
    return (
        lineitem
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .select(
            F.col("o_custkey").alias("StoreNo"),
            F.when(F.col("l_orderkey") % 211 == 5, F.lit(None)).when(F.col("l_orderkey") % 223 == 7, F.lit(OUTSIDE_CALENDAR))
             .otherwise(_month_start("l_shipdate")).alias("Month"),
            _choose("l_returnflag", {"A": "Actuals", "N": "Partner Fee"}, "Registration Fee").alias("Revenue_Type"),
            _choose("l_linestatus", {"F": "Renewal"}, "New").alias("Revenue_Motion"),
            _choose("p_type", {
                "ECONOMY": "Service Basic", "LARGE": "Service Support Plus", "MEDIUM": "Support Desk",
                "PROMO": "Product Promo", "SMALL": "Product Support",
            }, "Standard").alias("Product_Category"),
            F.col("o_orderstatus").alias("Motion"),
            F.when(F.col("l_shipdate") >= F.lit(REVENUE_ENDS), F.lit(0))
             .otherwise(F.col("l_extendedprice")).cast(MONEY).alias("Revenue"),
        )
    )


def opportunities(orders: DataFrame) -> DataFrame:
    number, priority, status = F.col("o_orderkey"), F.col("o_orderpriority"), F.col("o_orderstatus")
    return orders.select(
        F.col("o_custkey").alias("Store_No"),
        F.when(number % 97 == 0, F.lit(OUTSIDE_CALENDAR)).otherwise(F.col("o_orderdate").cast("date"))
         .alias("Opportunity_Est_Date"),
        F.when((priority == "2-HIGH") & (number % 10 == 0), F.lit("Consulting")).otherwise(
            _choose("o_orderpriority", {
                "1-URGENT": "Service Plan", "2-HIGH": "Support Desk", "3-MEDIUM": "Product Bundle",
                "4-NOT SPECIFIED": "Null",
            })).alias("Product"),
        number.alias("Opportunity_ID"),
        F.concat(F.lit("Opp "), number.cast("string")).alias("Opportunity_Name"),
        F.when(status == "F", "Inactive").when(status == "O", "Active")
         .when(number % 50 == 0, F.lit(None)).otherwise("Pending").alias("Project_Status"),
        status.alias("Opportunity_Status"),
        F.concat(F.lit("Stage "), (number % 4).cast("string")).alias("Opportunity_Stage"),
        F.when(number % 41 == 0, "0").when(number % 43 == 2, "0.004").when(number % 89 == 3, NO_AMOUNT)
         .otherwise(F.format_number((F.col("o_totalprice") - 50000).cast("decimal(18,2)"), 2)).alias("Opportunity_Usage"),
    )


def targets(orders: DataFrame) -> DataFrame:
    number = F.col("o_orderkey")
    third = number % 3
    return (
        orders.groupBy(
            F.col("o_custkey").alias("Store_Number"),
            F.when(third == 0, "Services").when(third == 1, "Support").otherwise("Products")
             .alias("Service_Comp_Group"),
            F.when(number % 227 == 3, F.lit(None)).when(number % 229 == 4, F.lit(OUTSIDE_CALENDAR))
             .otherwise(_month_start("o_orderdate")).alias("Fiscal_Month"),
        )
        .agg(F.sum(F.col("o_totalprice").cast(MONEY)).alias("Target"))
    )


def stores(customer: DataFrame, nation: DataFrame, region: DataFrame) -> DataFrame:
    number, balance = F.col("c_custkey"), F.col("c_acctbal")
    return (
        customer.filter(number % 53 != 0)
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            number.alias("AccountNo"),
            F.col("c_name").alias("Store"),
            F.col("c_mktsegment").alias("Industry"),
            F.col("n_name").alias("Vertical"),
            F.when(balance < 0, "SMB").when(balance < 5000, "Corporate").otherwise("Enterprise").alias("Segment"),
            F.concat(F.lit("mgr"), (number % 17).cast("string")).alias("Store_Manager_Alias"),
            F.when(number % 4 == 0, "Yes").otherwise("No").alias("Potential_Account"),
            F.col("r_name").alias("Vertical_Manager_Alias"),
        )
    )


def sellers(customer: DataFrame) -> DataFrame:
    number = F.col("c_custkey")

    def seller(of: int):
        return F.concat(F.lit("seller"), (number % of).cast("string"))

    return customer.filter(number % 59 != 0).select(
        number.alias("Store_ID"),
        seller(10).alias("General_Seller"),
        seller(7).alias("Services_Seller"),
        seller(5).alias("Product_Seller"),
    )


def tables_from_tpch(spark: SparkSession, path: str) -> Tables:
    @cache
    def read(name: str) -> DataFrame:
        return spark.read.parquet(f"{path}/{name}.parquet")

    return Tables(
        revenue=lambda: revenue(read("lineitem"), read("orders"), read("part")),
        opportunities=lambda: opportunities(read("orders")),
        targets=lambda: targets(read("orders")),
        calendar=lambda: fiscal_calendar(spark, CALENDAR_START, CALENDAR_END),
        stores=lambda: stores(read("customer"), read("nation"), read("region")),
        sellers=lambda: sellers(read("customer")),
    )
