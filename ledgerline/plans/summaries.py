"""The two reporting views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions.ranges import range_label
from ledgerline.operators.keys import COPIES, CORRECTED, check_mode
from ledgerline.operators.lookups import add_lookups
from ledgerline.operators.merge import expand_copies, fold_copies
from ledgerline.operators.opportunities import opportunity_detail
from ledgerline.plans.facts import all_facts, all_facts_as_written
from ledgerline.schemas import Tables


def with_lookups(df: DataFrame, tables: Tables) -> DataFrame:
    return add_lookups(df, tables.calendar, tables.stores, tables.sellers)


def revenue_summary(tables: Tables, mode: str = CORRECTED, expand: bool = True) -> DataFrame:
    """All facts by account, month and category, with the attributes of month and account: 24 columns.

    In mode ``as_written``, ``expand=False`` gives distinct rows, with their number in ``Copies``, the last column. The facts
    are folded, not the summary: a month and an account have one row of attributes, so facts that differ still do with them.
    They are folded by account, as the lookups want them.
    """
    if not check_mode(mode):
        return with_lookups(all_facts(tables), tables)
    facts = all_facts_as_written(tables)
    if expand:
        return expand_copies(with_lookups(facts, tables))
    folded = with_lookups(fold_copies(facts.repartition("Account_No")), tables)
    return folded.select(*[c for c in folded.columns if c != COPIES], COPIES)


def with_ranges(detail: DataFrame) -> DataFrame:
    return detail.withColumns({
        f"{amount}_Range": range_label(F.col(amount)) for amount in ("Opportunity_Usage", "Opportunity_Extrap")
    })


def opportunity_summary(tables: Tables) -> DataFrame:
    """The pipeline by account, category, month, product, status and stage, with ranges and attributes: 24 columns."""
    return with_lookups(with_ranges(opportunity_detail(tables.opportunities, tables.calendar)), tables)


def create_views(spark: SparkSession, tables: Tables, prefix: str = "", mode: str = CORRECTED) -> list[str]:
    """Register both summaries as temporary views; ``prefix`` goes before their names.

    The views are lazy: each read runs the plan again on what the tables then hold. They end with the session;
    ``sources.save_summary`` saves a summary as a table that stays.
    """
    views = {
        f"{prefix}Revenue_Summary": revenue_summary(tables, mode),
        f"{prefix}Opportunity_Summary": opportunity_summary(tables),
    }
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return list(views)

