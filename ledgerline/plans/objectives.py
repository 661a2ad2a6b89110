"""The reports the two views are meant for. What each is to show is given; how exactly it is defined is ours."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.amounts import parse_amount
from ledgerline.operators.fiscal import month_attributes, on_day, with_anchor
from ledgerline.operators.forecast import baseline_average
from ledgerline.operators.lattice import column_sizes, cube_by_lattice
from ledgerline.operators.lookups import MONTH_COLUMNS, SELLER_COLUMNS, STORE_COLUMNS, account_attributes
from ledgerline.operators.opportunities import clean_opportunities
from ledgerline.operators.revenue import revenue_lines
from ledgerline.operators.targets import rename_targets
from ledgerline.plans.facts import anchor_of, month_totals, stacked_facts
from ledgerline.schemas import Tables

MONTH = ("Fiscal_Month", "Fiscal_Year", "Month_ID")
SLICES = ("Segment", "Vertical", "General_Seller", "Product_Category")
SLICED = ("Revenue", "Partner_Fee", "Registration_Fee", "Target", "Baseline", "Opportunity_Into_RR")


def _dated_revenue(tables: Tables) -> DataFrame:
    lines = revenue_lines(tables.revenue).withColumnRenamed("Fiscal_Month", "Revenue_Date")
    return on_day(lines, "Revenue_Date", tables.calendar, *MONTH)


def revenue_by_month(tables: Tables) -> DataFrame:
    """Revenue of each month in the calendar that has any revenue row."""
    return _dated_revenue(tables).groupBy(*MONTH).agg(F.sum("Revenue").alias("Revenue"))


def fees_by_month(tables: Tables) -> DataFrame:
    fees = ("Partner_Fee", "Registration_Fee")
    return _dated_revenue(tables).groupBy(*MONTH).agg(*[F.sum(f).alias(f) for f in fees])


def revenue_vs_target(tables: Tables) -> DataFrame:
    """Revenue and target by month and category, their difference, and revenue as a share of the target.

    Attainment is NULL where the target is 0 or missing. The rows of both are stacked and summed in one shuffle.
    """
    by = ("Fiscal_Month", "Month_ID", "Product_Category")
    dated = rename_targets(tables.targets).withColumnRenamed("Fiscal_Month", "Target_Date")
    goals = on_day(dated, "Target_Date", tables.calendar, "Fiscal_Month", "Month_ID").select(*by, "Target")
    sold = _dated_revenue(tables).select(*by, "Revenue")
    sums = sold.unionByName(goals, allowMissingColumns=True).groupBy(*by).agg(
        F.coalesce(F.sum("Revenue"), F.lit(0)).alias("Revenue"),
        F.coalesce(F.sum("Target"), F.lit(0)).alias("Target"),
    )
    return sums.withColumns({
        "Variance": F.col("Revenue") - F.col("Target"),
        "Attainment": F.try_divide(F.col("Revenue").cast("double"), F.col("Target").cast("double")),
    })


def forecast(tables: Tables) -> DataFrame:
    """Per month: Revenue + Partner_Fee up to the anchor month, Baseline + run-rate after it, and the running total
    over the fiscal year. Amounts without a month of the calendar are a row of their own, with a NULL month: Actual, as nothing
    is expected of no month. It is left out if it has no amounts, as where only pipeline lacks a month.

    The window runs over month totals, a row per month, never over the facts.
    """
    totals, anchor = month_totals(tables)
    monthly = totals.join(month_attributes(tables.calendar), "Fiscal_Month", "left").filter(
        "Month_ID is not null or Sold != 0")
    is_actual = F.col("Month_ID").isNull() | (F.col("Month_ID") <= F.col("_anchor.Month_ID"))
    amount = F.when(is_actual, F.col("Sold")).otherwise(F.col("Expected"))
    so_far = Window.partitionBy("Fiscal_Year").orderBy("Month_ID").rowsBetween(Window.unboundedPreceding, 0)
    return with_anchor(monthly, anchor).select(
        *MONTH, F.when(is_actual, "Actual").otherwise("Forecast").alias("Kind"), amount.alias("Amount")
    ).withColumn("Year_To_Date", F.sum("Amount").over(so_far))


# Roughly how many values a column has that is not an attribute of accounts; more than any other, if it is not here.
ROW_SIZES = {"Product_Category": 4, "Fiscal_Quarter": 4, "Fiscal_Year": 10, "Fiscal_Month": 120, "Month_ID": 120}


def slice_sizes(tables: Tables, by: Sequence[str] = SLICES) -> dict[str, int]:
    """Roughly how many values each column of ``slices`` has. Reads the account lookups, at once."""
    of_account = [name for name in by if name in (*STORE_COLUMNS, *SELLER_COLUMNS)]
    sizes = column_sizes(account_attributes(tables.stores, tables.sellers), of_account) if of_account else {}
    return {name: sizes.get(name, ROW_SIZES.get(name, 2**31)) for name in by}


def slices(
    tables: Tables, by: Sequence[str] = SLICES, measures: Sequence[str] = SLICED, sizes: Mapping[str, int] | None = None
) -> DataFrame:
    """The measures for every combination of the given columns; ``Grouping_ID`` has a bit set for each column that is
    summed over, first column highest, which tells a total from a missing attribute.

    Summed by account before the attributes are joined, then by all the columns, and from there along a lattice of
    combinations, each from its smallest parent; ``sizes`` (columns and roughly how many values they have) tells which
    that is. Left out, ``slice_sizes`` reads it from the account lookups.
    """
    of_account = (*STORE_COLUMNS, *SELLER_COLUMNS)
    of_row = [name for name in by if name not in of_account and name != "Account_No"]
    of_month = [name for name in of_row if name in MONTH_COLUMNS]
    own = [name for name in of_row if name not in of_month]
    rows = stacked_facts(tables, measures)
    needed = dict.fromkeys(["Account_No", *own, *(["Fiscal_Month"] if of_month else [])])
    by_account = rows.groupBy(*needed).agg(*[F.sum(m).alias(m) for m in measures])
    if of_month:
        by_account = by_account.join(month_attributes(tables.calendar), "Fiscal_Month", "left")
    accounts = account_attributes(tables.stores, tables.sellers)
    attributed = by_account.join(accounts, F.col("Account_No") == F.col("Account"), "left")
    finest = attributed.groupBy(*by).agg(*[
        F.coalesce(F.sum(m), F.lit(0)).cast(by_account.schema[m].dataType).alias(m) for m in measures])
    return cube_by_lattice(finest, by, measures, sizes or slice_sizes(tables, by))


def average_baseline(tables: Tables, months: int = 3) -> DataFrame:
    return baseline_average(revenue_lines(tables.revenue), tables.calendar, anchor_of(tables), months)


# --- changes week on week -----------------------------------------------------------------------------------------

NEW, CLOSED, SAME = "New", "Closed", "Same"
STAGE_CHANGED, VALUE_CHANGED, BOTH_CHANGED = "Stage changed", "Value changed", "Stage and value changed"


# What is told of an opportunity in each week.
FOLLOWED = ("Account_No", "Product_Category", "Opportunity_Status", "Opportunity_Stage")


def _nameless():
    return F.raise_error(F.lit("an opportunity without an Opportunity_ID")).cast("long")


def _side(name: str, condition=None) -> list:
    """The usage and attributes of one week, of the rows that meet ``condition``."""
    def those(column):
        return column if condition is None else F.when(condition, column)

    total = F.sum(those(F.col("Usage"))).alias(f"{name}Opportunity_Usage")
    last = F.max(those(F.struct("Opportunity_Status", "Opportunity_Stage", *FOLLOWED[:2])))
    return [total, *[last[a].alias(f"{name}{a}") for a in FOLLOWED]]


def _described(paired: DataFrame) -> DataFrame:
    """Both weeks of an opportunity, side by side, and what changed; ``_here`` and ``_before`` tell which week has it."""
    stage = ~(
        F.col("Opportunity_Stage").eqNullSafe(F.col("Previous_Opportunity_Stage"))
        & F.col("Opportunity_Status").eqNullSafe(F.col("Previous_Opportunity_Status"))
    )
    value = ~F.col("Opportunity_Usage").eqNullSafe(F.col("Previous_Opportunity_Usage"))
    change = (
        F.when(~F.col("_before"), NEW).when(~F.col("_here"), CLOSED)
        .when(stage & value, BOTH_CHANGED).when(stage, STAGE_CHANGED).when(value, VALUE_CHANGED)
        .otherwise(SAME)
    )
    return paired.select(
        "Opportunity_ID", "Snapshot_Week",
        *[F.coalesce(a, f"Previous_{a}").alias(a) for a in FOLLOWED[:2]],
        *[c for a in FOLLOWED[2:] for c in (a, f"Previous_{a}")],
        "Opportunity_Usage", "Previous_Opportunity_Usage",
        change.alias("Change_Type"),
    )


def wow_changes(snapshots: DataFrame, weeks: Sequence[int] | None = None) -> DataFrame:
    """Each opportunity in each week, beside itself in the snapshot before, and what changed.

    ``snapshots`` has the opportunity columns and ``Snapshot_Week``; any number of weeks, gaps allowed. ``weeks`` names
    the weeks it has; left out, they are looked up, which reads the snapshots' weeks once more. The first week
    has nothing before it and so is only compared with. An opportunity of the week before that is missing is Closed.
    If a snapshot has an opportunity more than once, its usages are summed, and the attributes are those of one of its
    rows, the last by status and stage. Opportunities without a number cannot be followed, and are an error.

    A row is sent to its own week, as now, and to the next one, as before; one grouping by opportunity and week then
    has both. That is one shuffle with map-side sums, and no join in which one opportunity could hold up a task.
    """
    week = F.col("Snapshot_Week")
    if weeks is None:
        known = snapshots.agg(F.sort_array(F.collect_set(week))).scalar()  # one entry per snapshot week
    else:
        known = F.array(*[F.lit(w) for w in sorted(set(weeks))]).cast("array<int>")
    next_week = F.array_min(F.filter("_weeks", lambda w: w > week))
    usage = parse_amount("Opportunity_Usage")
    sent = (
        clean_opportunities(snapshots).withColumns({"Usage": usage, "_weeks": known})
        .withColumn("_to", F.explode(F.array(
            F.struct(week.alias("Week"), F.lit(True).alias("Now")),
            F.struct(next_week.alias("Week"), F.lit(False).alias("Now")),
        )))
        # Nothing follows the last week, and nothing precedes the first.
        .filter(F.col("_to.Week") > F.element_at("_weeks", 1))
    )
    now = F.col("_to.Now")

    sent = sent.withColumn("Opportunity_ID", F.coalesce("Opportunity_ID", _nameless()))
    paired = sent.groupBy("Opportunity_ID", F.col("_to.Week").alias("Snapshot_Week")).agg(
        *_side("", now), *_side("Previous_", ~now),
        F.max(now).alias("_here"), F.max(~now).alias("_before"),
    )
    return _described(paired)


def wow_changes_bucketed(before: DataFrame, now: DataFrame, week: int) -> DataFrame:
    """``wow_changes`` of two weeks that ``sources.save_bucketed_week`` saved as tables of equally many buckets.

    Both are grouped and joined within their buckets: neither the attributes nor the numbers of opportunities are shuffled,
    whether they changed or not.
    """
    def side(snapshot: DataFrame, name: str) -> DataFrame:
        clean = clean_opportunities(snapshot).withColumn("Usage", parse_amount("Opportunity_Usage"))
        return clean.groupBy("Opportunity_ID").agg(*_side(name))

    n, b = side(now, "").alias("n"), side(before, "Previous_").alias("b")
    paired = n.join(b, F.col("n.Opportunity_ID") == F.col("b.Opportunity_ID"), "full")
    named = F.coalesce("n.Opportunity_ID", "b.Opportunity_ID", _nameless())
    return _described(paired.select(
        named.alias("Opportunity_ID"), F.lit(week).alias("Snapshot_Week"),
        *[column for a in ("Opportunity_Usage", *FOLLOWED) for column in (F.col(f"n.{a}"), F.col(f"b.Previous_{a}"))],
        F.col("n.Opportunity_ID").isNotNull().alias("_here"), F.col("b.Opportunity_ID").isNotNull().alias("_before")))


def wow_measures(snapshots: DataFrame, weeks: Sequence[int] | None = None) -> DataFrame:
    """The change in usage of each opportunity: now less before, a missing side counting 0, and as a share of the
    usage before (NULL where that is 0 or missing)."""
    now, before = (F.coalesce(c, F.lit(0)) for c in ("Opportunity_Usage", "Previous_Opportunity_Usage"))
    return wow_changes(snapshots, weeks).select(
        "Opportunity_ID", "Snapshot_Week", "Change_Type", "Opportunity_Usage", "Previous_Opportunity_Usage",
        (now - before).alias("Usage_Change"),
        F.try_divide((now - before).cast("double"), F.col("Previous_Opportunity_Usage").cast("double"))
         .alias("Usage_Change_Share"),
    )


def wow_totals(snapshots: DataFrame, weeks: Sequence[int] | None = None) -> DataFrame:
    """Opportunities and change in usage by week, category and kind of change."""
    now, before = (F.coalesce(c, F.lit(0)) for c in ("Opportunity_Usage", "Previous_Opportunity_Usage"))
    return wow_changes(snapshots, weeks).groupBy("Snapshot_Week", "Product_Category", "Change_Type").agg(
        F.count("*").alias("Opportunities"), F.sum(now - before).alias("Usage_Change")
    )
