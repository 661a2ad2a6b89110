from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Partitions that an update may compare: one short row each comes to the driver.
MOST_PARTITIONS = 100_000
OVERWRITE_MODE = "spark.sql.sources.partitionOverwriteMode"


def write_summary(
    df: DataFrame, path: str, partition_by: str = "Fiscal_Year", format: str = "parquet", replace_all: bool = False
) -> None:
    """Write a summary partitioned by fiscal year, so that a report on one year reads that year's files only.

    Years that ``df`` does not have stay as they are, unless ``replace_all``.
    The rebalance hint gathers a year's rows into files of a sensible size and, because it lets Spark split a large
    partition, a year that holds most of the rows is still written by many tasks.
    """
    writer = df.hint("rebalance", partition_by).write.format(format).mode("overwrite").partitionBy(partition_by)
    writer.option("partitionOverwriteMode", "static" if replace_all else "dynamic").save(path)


def save_summary(df: DataFrame, table: str, partition_by: str = "Fiscal_Year", format: str = "parquet") -> None:
    """Save a summary as a table of the catalog, partitioned by fiscal year, where other sessions find it.

    The views of ``create_views`` end with their session; this stays. An existing table is replaced.
    """
    df.hint("rebalance", partition_by).write.format(format).mode("overwrite").partitionBy(partition_by).saveAsTable(table)


def _digests(df: DataFrame, columns: list[str], key: str) -> DataFrame:
    """``key``, number of rows, and two order-free sums of row hashes, of each partition."""
    whole = "decimal(38,0)"
    sums = [F.sum(F.xxhash64(F.lit(seed), *columns).cast(whole)).alias(f"h{seed}") for seed in (1, 2)]
    return df.groupBy(F.col(key).alias("key")).agg(F.struct(F.count("*").alias("n"), *sums).alias("digest"))


def update_summary(df: DataFrame, table: str, partition_by: str = "Fiscal_Year") -> list:
    """Bring a table of ``save_summary`` up to ``df``: only partitions whose rows differ are rewritten. Tells which they are.

    Each partition of both is told by the number of its rows and sums of their hashes, which one pass over each side gives,
    with a row for each partition and task in the shuffle. Differing partitions are replaced, those that ``df`` no longer
    has are dropped, and what did not change keeps its files. ``df`` is made twice, the second time for the differing
    partitions only, so its sources must not change meanwhile. More than ``MOST_PARTITIONS`` partitions are an error;
    another set of columns or types is one too: save the summary anew.
    """
    spark = df.sparkSession
    saved = spark.table(table)
    kinds = [{f.name: f.dataType for f in side.schema} for side in (df, saved)]
    if kinds[0] != kinds[1]:
        raise ValueError(f"{table} has other columns than the summary: {sorted(kinds[1])}, not {sorted(kinds[0])}")
    new, old = (_digests(side, df.columns, partition_by) for side in (df, saved))
    both = new.withColumnRenamed("digest", "new").join(
        old.select(F.col("key").alias("old_key"), F.col("digest").alias("old")), F.col("key").eqNullSafe(F.col("old_key")), "full_outer")
    changed = both.filter(~F.col("new").eqNullSafe(F.col("old"))).select(
        F.when(F.col("new").isNull(), F.col("old_key")).otherwise(F.col("key")).alias("key"), F.col("new").isNull().alias("gone"))
    rows = changed.limit(MOST_PARTITIONS + 1).collect()
    if len(rows) > MOST_PARTITIONS:
        raise ValueError(f"more than {MOST_PARTITIONS} partitions of {table} differ")
    kept, gone = ([r.key for r in rows if r.gone == flag] for flag in (False, True))
    if kept:
        named = [k for k in kept if k is not None]
        wanted = F.when(F.col(partition_by).isNull(), F.lit(None in kept)).otherwise(F.col(partition_by).isin(named))
        part = df.filter(wanted).select(*saved.columns).hint("rebalance", partition_by)
        # The writer's option of this name is not read by insertInto.
        before = spark.conf.get(OVERWRITE_MODE)
        spark.conf.set(OVERWRITE_MODE, "dynamic")
        try:
            part.write.insertInto(table, overwrite=True)
        finally:
            spark.conf.set(OVERWRITE_MODE, before)
    for key in gone:
        value = "null" if key is None else "'" + str(key).replace("\\", "\\\\").replace("'", "\\'") + "'"
        spark.sql(f"alter table {table} drop if exists partition (`{partition_by}` = {value})")
    spark.catalog.refreshTable(table)
    return sorted(kept + gone, key=lambda k: (k is None, k if k is not None else 0))
