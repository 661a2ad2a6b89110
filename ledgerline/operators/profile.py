"""A look at a table: some of its rows, the values of a column, and a profile of all columns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Twelve bits: a distinct count within 1.6% of the true one, two times out of three; about 2 kB a column.
SKETCH_BITS = 12
# Values and counts that are kept while the most frequent are sought.
TRACKED = 1024


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    return df.select(col).distinct()


def peek(df: DataFrame, n: int = 10) -> DataFrame:
    """Any ``n`` rows, to look at. Not ordered, so not the same rows each time."""
    return df.limit(n)


def row_digest(df: DataFrame) -> Column:
    """MD5 of a row: its columns as text, each with its length before it, so that no two rows read the same."""
    def told(name: str) -> Column:
        text = F.col(name).cast("string")
        return F.coalesce(F.concat(F.char_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.md5(F.concat(*map(told, df.columns)).cast("binary"))


def sample_rows(df: DataFrame, n: int = 10) -> DataFrame:
    """``n`` rows that are the same on every run, whatever the partitions: those with the smallest digests.

    Equal rows have equal digests, and count as often as they are there. Every task keeps its ``n`` smallest rows; the table
    is neither sorted nor shuffled.
    """
    return df.withColumn("_digest", row_digest(df)).orderBy("_digest").limit(n).drop("_digest")


def profile_sketches(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """A row for each column: ``Column``, ``Rows``, ``Nulls``, ``Lowest`` and ``Highest`` (as text), and mergeable sketches of its
    distinct values (``Distinct_Sketch``) and frequent values (``Frequent_Sketch``). One pass over the table."""
    names = list(columns or df.columns)

    def told(name: str) -> Column:
        text = F.col(name).cast("string")
        return F.struct(
            F.lit(name).alias("Column"), F.count(F.lit(1)).alias("Rows"), F.count_if(F.col(name).isNull()).alias("Nulls"),
            F.min(name).cast("string").alias("Lowest"), F.max(name).cast("string").alias("Highest"),
            F.hll_sketch_agg(text, SKETCH_BITS).alias("Distinct_Sketch"),
            F.call_function("approx_top_k_accumulate", text, F.lit(TRACKED)).alias("Frequent_Sketch"),
        )

    return df.agg(F.array(*map(told, names)).alias("_told")).select(F.inline("_told"))


def merge_profiles(*profiles: DataFrame) -> DataFrame:
    """The profile of tables put one below the other, from their profiles, as from week to week. ``Lowest`` and ``Highest`` are
    compared as text, which orders ISO dates and equally long numbers."""
    return reduce(DataFrame.unionByName, profiles).groupBy("Column").agg(
        F.sum("Rows").alias("Rows"), F.sum("Nulls").alias("Nulls"), F.min("Lowest").alias("Lowest"),
        F.max("Highest").alias("Highest"), F.hll_union_agg("Distinct_Sketch").alias("Distinct_Sketch"),
        F.call_function("approx_top_k_combine", F.col("Frequent_Sketch"), F.lit(TRACKED)).alias("Frequent_Sketch"))


def read_profile(profiles: DataFrame, frequent: int = 5) -> DataFrame:
    """A profile with ``Distinct_Values``, about, and the most ``Frequent_Values`` with their counts in place of the sketches."""
    return profiles.select(
        "Column", "Rows", "Nulls", "Lowest", "Highest", F.hll_sketch_estimate("Distinct_Sketch").alias("Distinct_Values"),
        F.call_function("approx_top_k_estimate", F.col("Frequent_Sketch"), F.lit(frequent)).alias("Frequent_Values"))
