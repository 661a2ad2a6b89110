"""One account, or one key, that holds a large share of the rows."""

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import add_lookups, merge_facts
from ledgerline.operators.keys import KEYS
from ledgerline.plans import summaries
from ledgerline.schemas import Tables

TINY_PARTITIONS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
}


@pytest.fixture
def tiny_partitions(spark):
    for name, value in TINY_PARTITIONS.items():
        spark.conf.set(name, value)
    yield
    for name in TINY_PARTITIONS:
        spark.conf.unset(name)


def _executed(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_a_crowded_key_is_split_and_merged_whole(spark, tiny_partitions):
    n = 60_000
    crowd = spark.range(0, n, 1, 8).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 5_000).cast("int").alias("Account_No"),
        F.lit("a").alias("Fiscal_Month"), F.lit("x").alias("Product_Category"), F.col("id").alias("Target"),
    )
    single = spark.range(4_990, 5_010).select(
        F.col("id").cast("int").alias("Account_No"), F.lit("a").alias("Fiscal_Month"),
        F.lit("x").alias("Product_Category"), F.col("id").alias("Baseline"),
    )
    merged = merge_facts(single, crowd, crowded="right")
    assert "skew=true" in _executed(merged)
    plain = single.join(crowd, list(KEYS), "full").select(
        *KEYS, F.coalesce("Baseline", F.lit(0)).alias("Baseline"), F.coalesce("Target", F.lit(0)).alias("Target")
    )
    assert merged.exceptAll(plain).count() == plain.exceptAll(merged).count() == 0


def test_a_large_account_is_split_when_attributes_are_joined(spark, make, tiny_partitions):
    lookups = make(stores=[{"AccountNo": i, "Store": f"Store {i}"} for i in range(200)])
    rows = spark.range(0, 60_000, 1, 8).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 300).alias("Account_No"),
        F.lit("January, 2019").alias("Fiscal_Month"), F.concat(F.lit("Product "), "id").alias("Product"),
    )
    joined = add_lookups(rows, lookups.calendar, lookups.stores, lookups.sellers)
    assert "skew=true" in _executed(joined)
    assert joined.count() == 60_000
    assert joined.filter("Account_No = 7 and Account_Name = 'Store 7'").count() == rows.filter("Account_No = 7").count()


def test_summaries_hold_with_a_third_of_all_rows_on_one_account(small, tiny):
    """The sums of the large account are those of the accounts it was made of."""
    def crowded(t):
        def onto_one(df, key):
            third = F.pmod(F.hash(key), F.lit(3)) == 0
            return df.withColumn(key, F.when(third, F.lit(1).cast("long")).otherwise(F.col(key)))
        return Tables(
            revenue=onto_one(t.revenue, "StoreNo"), opportunities=onto_one(t.opportunities, "Store_No"),
            targets=onto_one(t.targets, "Store_Number"), calendar=t.calendar, stores=t.stores, sellers=t.sellers,
        )

    def totals(t):
        measures = ("Revenue", "Partner_Fee", "Registration_Fee", "Target", "Baseline")
        return summaries.revenue_summary(t).agg(*[F.sum(m) for m in measures]).first()

    assert totals(crowded(small)) == totals(small)
    busiest = summaries.revenue_summary(crowded(small)).groupBy("Account_No").count().agg(F.max("count")).first()[0]
    # Months, times categories: bounded however many rows the account has.
    assert busiest <= small.calendar.select("Fiscal_Month").distinct().count() * 4
