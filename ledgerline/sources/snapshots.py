from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions.amounts import parse_amount
from ledgerline.schemas import OPPORTUNITIES, SCHEMAS
from ledgerline.sources.catalog import table_names, tables_from_catalog

WEEKLY = ("revenue", "opportunities")


def weekly_snapshots(by_week: dict[int, DataFrame]) -> DataFrame:
    """Snapshots of the opportunity table, one per week, as one DataFrame with the week in ``Snapshot_Week``."""
    parts = [df.select("*", F.lit(week).alias("Snapshot_Week")) for week, df in sorted(by_week.items())]
    stacked, *rest = parts
    for part in rest:
        stacked = stacked.unionByName(part)
    return stacked


def snapshots_from_catalog(spark: SparkSession, weeks: Sequence[int], database: str | None = None) -> DataFrame:
    """The opportunity tables of several weeks, which carry the week in their names, as weekly snapshots."""
    return weekly_snapshots({week: tables_from_catalog(spark, week, database).opportunities for week in weeks})


def read_snapshots(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    """Snapshots stored in folders ``Snapshot_Week=NN``; a filter on the week reads only those folders."""
    columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in OPPORTUNITIES]
    return spark.read.format(format).load(path).select(*columns, F.col("Snapshot_Week").cast("int"))


def write_week(df: DataFrame, path: str, week: int, table: str = "opportunities", format: str = "parquet") -> None:
    """A week's snapshot as a folder below ``path`` under its table's name, which has the week in it; replaces that week's."""
    columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in SCHEMAS[table]]
    df.select(*columns).write.format(format).mode("overwrite").save(f"{path.rstrip('/')}/{table_names(week)[table]}")


def scan_weeks(spark: SparkSession, path: str, table: str = "opportunities", format: str = "parquet") -> DataFrame:
    """All weekly snapshots of a table below ``path`` as one source, with the week of each row's folder in ``Snapshot_Week``.

    One scan, however many weeks there are. The week comes from the file's name, so a filter on ``Snapshot_Week`` is decided
    when files are listed: only those of the weeks wanted are opened. Columns go by name, and have our types.
    """
    if table not in WEEKLY:
        raise ValueError(f"{table} has no weekly snapshots; {' and '.join(WEEKLY)} have")
    name = table_names(0)[table].removesuffix("0")
    week = F.regexp_extract("_metadata.file_path", rf"/{name}([0-9]+)[/.][^/]*$", 1).cast("int")
    return spark.read.schema(SCHEMAS[table]).format(format).load(f"{path.rstrip('/')}/{name}[0-9]*").select(
        "*", week.alias("Snapshot_Week"))


def save_bucketed_week(df: DataFrame, table: str, buckets: int = 256) -> None:
    """A week's opportunities as a table of the catalog, in buckets of Opportunity_ID with a file each, sorted by it.

    Weeks saved with the same number of buckets are compared without a shuffle; see ``objectives.wow_changes_bucketed``.
    """
    number = "Opportunity_ID"
    df.repartition(buckets, number).write.format("parquet").mode("overwrite").bucketBy(buckets, number).sortBy(
        number).saveAsTable(table)


def previous_week(opportunities: DataFrame) -> DataFrame:
    """A made-up snapshot of the week before, derived from this week's, with every kind of change in it.

    Every 7th opportunity is missing (new this week), every 11th has a twin under the negative number (closed this
    week), every 5th was one stage earlier in its cycle of four, every 3rd was worth 90%.
    """
    number = F.col("Opportunity_ID")
    stage = F.substring("Opportunity_Stage", -1, 1).cast("int")
    worth = (parse_amount("Opportunity_Usage") * F.lit(0.9).cast("decimal(2,1)")).cast("decimal(18,2)")
    before = opportunities.filter(number % 7 != 0).withColumns({
        "Opportunity_Stage": F.when(number % 5 == 0, F.concat(F.lit("Stage "), ((stage + 1) % 4).cast("string")))
                              .otherwise(F.col("Opportunity_Stage")),
        "Opportunity_Usage": F.when(number % 3 == 0, F.format_number(worth, 2))
                              .otherwise(F.col("Opportunity_Usage")),
    })
    closed = opportunities.filter(number % 11 == 0).withColumn("Opportunity_ID", -number)
    return before.unionByName(closed)
