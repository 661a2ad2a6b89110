from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.functions.categories import CATEGORY_RULES, UNMAPPED
from ledgerline.schemas import SCHEMAS, Tables
from ledgerline.sources.calendars import small_calendar


def table_names(week: int) -> dict[str, str]:
    """The tables' names; revenue and opportunities are weekly snapshots and carry the week as a suffix."""
    return {
        "revenue": f"Revenue_Wk{week}",
        "opportunities": f"Opportunities_Wk{week}",
        "targets": "Business_Targets",
        "calendar": "Calendar_Lookup",
        "stores": "Store_Lookup",
        "sellers": "Sellers_Lookup",
    }


def _open(week: int, load: Callable[[str, T.StructType], DataFrame]) -> Tables:
    """The tables as ``load`` opens them, with the columns the plans use, in their types.

    Other columns are dropped, so that the scan never reads them.
    """
    def opener(table: str, stored: str):
        def open_table() -> DataFrame:
            schema = SCHEMAS[table]
            df = load(stored, schema).select([F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])
            return small_calendar(df) if table == "calendar" else df
        return open_table

    return Tables(**{table: opener(table, stored) for table, stored in table_names(week).items()})


def tables_from_catalog(spark: SparkSession, week: int, database: str | None = None) -> Tables:
    """The six tables of ``database``, or of the session's current database."""
    prefix = f"`{database}`." if database else ""
    return _open(week, lambda stored, _: spark.table(prefix + stored))


def read_tables(spark: SparkSession, path: str, week: int, format: str = "parquet") -> Tables:
    """The six tables below ``path``, one folder or file each, under their table names.

    Columns go by name, in any order; one that is missing, or has values that are not of its type, is an error. Parquet
    and ORC bring their own types and are cast to ours, CSV has text under the names in its header.
    """
    def load(stored: str, schema: T.StructType) -> DataFrame:
        reader = spark.read.format(format)
        if format == "csv":
            reader = reader.option("header", True)
        if format == "json":
            reader = reader.option("mode", "FAILFAST").schema(schema)
        return reader.load(f"{path.rstrip('/')}/{stored}")

    return _open(week, load)


# The text that the operators compare with fixed words, or that users type.
TYPED_TEXT = {
    "revenue": ("Revenue_Type", "Product_Category"),
    "opportunities": ("Product", "Project_Status", "Opportunity_Status", "Opportunity_Stage"),
}
IGNORE_CASE = "UTF8_LCASE"


def ignoring_case(tables: Tables) -> Tables:
    """The tables with a collation that ignores case on the text that users type.

    Spark then compares, searches and groups this text without regard to case in every operator, like a database
    whose default collation does. Without it, case counts. Target groups, which are joined with the names of the
    categories, get the spelling of these names.
    """
    def collated(table: str):
        names = TYPED_TEXT.get(table, ())
        return lambda: getattr(tables, table).withColumns({n: F.collate(n, IGNORE_CASE) for n in names})

    def targets() -> DataFrame:
        group = F.col("Service_Comp_Group")
        categories = [*[category for _, category in CATEGORY_RULES], UNMAPPED]
        spelt = [F.when(F.collate(group, IGNORE_CASE) == name, F.lit(name)) for name in categories]
        return tables.targets.withColumn("Service_Comp_Group", F.coalesce(*spelt, group))

    return Tables(**{table: collated(table) for table in SCHEMAS if table != "targets"}, targets=targets)
