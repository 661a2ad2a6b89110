from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.operators.fiscal import month_attributes

STORE_COLUMNS = (
    "Account_Name", "Industry", "Vertical", "Segment", "Store_Manager_Alias", "Potential_Account",
    "Vertical_Manager_Alias",
)
SELLER_COLUMNS = ("General_Seller", "Services_Seller", "Product_Seller")
MONTH_COLUMNS = ("Fiscal_Quarter", "Fiscal_Year", "Month_ID")


def _one_per_account(lookup: DataFrame, attributes: Sequence[str]) -> DataFrame:
    """The attributes of every account; rows without an account are left out, and an account that is there twice fails.

    The lookup is read once: rows are counted in the grouping that brings an account's rows together, whose shuffle the
    join of the two lookups uses again.
    """
    one = lookup.filter(F.col("Account").isNotNull()).groupBy("Account").agg(
        F.count("*").alias("_rows"), *[F.first(name).alias(name) for name in attributes])
    twice = F.raise_error(F.concat(F.lit("account more than once in a lookup: "), F.col("Account").cast("string")))
    is_one = F.when(F.col("_rows") == 1, F.lit(True)).otherwise(twice.cast("boolean"))
    return one.filter(is_one).select("Account", *attributes)


def account_attributes(stores: DataFrame, sellers: DataFrame) -> DataFrame:
    """Store and seller attributes, one row per account.

    Put together first, so that the facts need one join instead of two: the larger side is sorted once, and with a
    plain shuffle on either side of that join Spark can split an account that holds a large share of the facts.
    """
    store = stores.withColumnsRenamed({"AccountNo": "Account", "Store": "Account_Name"})
    seller = sellers.withColumnRenamed("Store_ID", "Account")
    both = _one_per_account(store, STORE_COLUMNS).join(_one_per_account(seller, SELLER_COLUMNS), "Account", "full")
    return both.select("Account", *STORE_COLUMNS, *SELLER_COLUMNS)


def add_lookups(df: DataFrame, calendar: DataFrame, stores: DataFrame, sellers: DataFrame) -> DataFrame:
    """``df`` with the 13 attributes of its month and account; rows without a match keep NULLs.

    The accounts grow with the data and so carry no broadcast hint: Spark broadcasts them if their measured size
    allows, and otherwise joins them by shuffle, splitting an account that holds a large share of the rows.
    """
    months, accounts = month_attributes(calendar), account_attributes(stores, sellers)
    return (
        df.join(months, "Fiscal_Month", "left")
        .join(accounts, F.col("Account_No") == F.col("Account"), "left")
        .select(*df.columns, *MONTH_COLUMNS, *STORE_COLUMNS, *SELLER_COLUMNS)
    )
