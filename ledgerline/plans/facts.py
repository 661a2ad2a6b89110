"""All facts on one key.

``all_facts`` is the plan to use; ``all_facts_as_written`` keeps the repeated rows that corrected mode removes.
``all_facts_joined`` gives the results of either by chained full outer joins of the pieces, the form in which they are
usually explained; it reads revenue once per piece that needs it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.amounts import zero_if_negative
from ledgerline.functions.months import months_left
from ledgerline.operators.fiscal import anchor_month, name_anchor, on_day, with_anchor
from ledgerline.operators.forecast import baseline, spread_runrate
from ledgerline.operators.keys import AS_WRITTEN, COPIES, CORRECTED, KEYS, check_mode
from ledgerline.operators.merge import merge_facts, one_row_per_key
from ledgerline.operators.opportunities import (
    extrapolate,
    future_opportunities,
    live_opportunities,
    months_times_usage,
    opportunity_monthly,
)
from ledgerline.operators.revenue import REVENUE_MEASURES, align_revenue, revenue_lines, revenue_monthly
from ledgerline.operators.targets import align_targets
from ledgerline.schemas import Tables

MEASURES = (
    *REVENUE_MEASURES, "Opportunity_Usage", "Opportunity_Extrap", "Baseline", "Target", "Opportunity_Into_RR",
)


# --- the pieces, one by one ---------------------------------------------------------------------------------------


def anchor_of(tables: Tables) -> DataFrame:
    return anchor_month(tables.revenue, tables.calendar)


def aligned_revenue(tables: Tables, mode: str = CORRECTED) -> DataFrame:
    as_written = check_mode(mode)
    rows = revenue_monthly(tables.revenue) if as_written else revenue_lines(tables.revenue)
    return align_revenue(rows, tables.calendar, mode)


def revenue_with_opportunities(tables: Tables, mode: str = CORRECTED) -> DataFrame:
    pipeline = extrapolate(opportunity_monthly(tables.opportunities, tables.calendar))
    return merge_facts(aligned_revenue(tables, mode), pipeline.drop("Extrap_Months_Left_For_FY"))


def baseline_of(tables: Tables, mode: str = CORRECTED) -> DataFrame:
    return baseline(aligned_revenue(tables, mode), anchor_of(tables))


def targets_of(tables: Tables, mode: str = CORRECTED) -> DataFrame:
    aligned = align_targets(tables.targets, tables.calendar)
    return aligned if check_mode(mode) else one_row_per_key(aligned)


def baseline_with_targets(tables: Tables, mode: str = CORRECTED) -> DataFrame:
    # As written, targets are not summed: nothing limits how many of them one key has.
    crowded = "right" if check_mode(mode) else None
    return merge_facts(baseline_of(tables, mode), targets_of(tables, mode), crowded=crowded)


def runrate_of(tables: Tables, mode: str = CORRECTED) -> DataFrame:
    anchor = anchor_of(tables)
    return spread_runrate(future_opportunities(tables.opportunities, tables.calendar, anchor), anchor, mode)


def expectations(tables: Tables, mode: str = CORRECTED) -> DataFrame:
    """Baseline, targets and run-rate."""
    if not check_mode(mode):
        return merge_facts(baseline_with_targets(tables), runrate_of(tables))
    # Merging on one key gives the same rows in any order; the targets, which may crowd on a key, come last.
    bounded = merge_facts(baseline_of(tables, mode), runrate_of(tables, mode))
    return merge_facts(bounded, targets_of(tables, mode), crowded="right")


def all_facts_joined(tables: Tables, mode: str = CORRECTED) -> DataFrame:
    """Revenue, pipeline, baseline, targets and run-rate by chained full outer joins."""
    sold = revenue_with_opportunities(tables, mode)
    if not check_mode(mode):
        return merge_facts(sold, expectations(tables))
    bounded = merge_facts(merge_facts(sold, baseline_of(tables, mode)), runrate_of(tables, mode))
    return merge_facts(bounded, targets_of(tables, mode), crowded="right")


# --- all of them, reading each source once ------------------------------------------------------------------------


def _sold(tables: Tables, measures: Sequence[str], as_written: bool, by: Sequence[str] = KEYS) -> DataFrame:
    """Revenue by account, month and category, and the last date with any non-zero revenue in it."""
    nonzero = F.when(F.col("Revenue") != 0, F.col("Month"))
    lines = revenue_lines(tables.revenue.withColumn("Last_Date", nonzero), "Last_Date")
    if not as_written:
        lines = lines.withColumnRenamed("Fiscal_Month", "Revenue_Date")
        lines = on_day(lines, "Revenue_Date", tables.calendar, "Fiscal_Month")
    return lines.groupBy(*by).agg(*[F.sum(m).alias(m) for m in measures], F.max("Last_Date").alias("Last_Date"))


def _anchor_of_sums(sold: DataFrame, tables: Tables, measures: Sequence[str]) -> DataFrame:
    """The anchor, taken from the sums by key instead of from the revenue rows.

    It carries the totals of the measures as well. Anchor and main plan then need the very same columns of the sums,
    so that Spark computes their shuffle once, for both, and reads the revenue table once.
    """
    totals = sold.agg(F.max("Last_Date").alias("Anchor_Date"), *[F.sum(m).alias(m) for m in measures])
    return name_anchor(totals, tables.calendar)


def _pipeline(tables: Tables, anchor: DataFrame) -> DataFrame:
    """Usage by key, in all and of estimates after the anchor date in its fiscal year (NULL if there are none)."""
    live = live_opportunities(tables.opportunities)
    dated = on_day(live, "Opportunity_Est_Date", tables.calendar, "Fiscal_Month", "Fiscal_Year", "Month_ID")
    ahead = (F.col("Opportunity_Est_Date") > F.col("_anchor.Anchor_Date")) & (
        F.col("Fiscal_Year") == F.col("_anchor.Fiscal_Year")
    )
    return with_anchor(dated, anchor).groupBy(*KEYS, "Month_ID").agg(
        F.sum("Opportunity_Usage").alias("Opportunity_Usage"),
        F.sum(F.when(ahead, F.col("Opportunity_Usage"))).alias("Ahead"),
    )


def _apart(label: Column) -> Column:
    """Rows with a NULL in the key match nothing: those of one origin belong together, others stay apart."""
    return F.when(reduce(or_, [F.col(k).isNull() for k in KEYS]), label).alias("_apart")


def _land(
    sums: DataFrame, label: Column, measures: Mapping[str, Column],
    months: Column, carries: Column, carried_label: str, carried: Mapping[str, Column],
) -> DataFrame:
    """Each sum on its own month with ``measures`` and, where it ``carries``, on ``months`` with ``carried``."""
    own = F.array(F.col("Fiscal_Month"))
    names = F.transform(months, lambda month: month["Fiscal_Month"])
    spread = sums.select(
        "*", F.posexplode(F.when(carries, F.concat(own, names)).otherwise(own)).alias("_at", "_month")
    )
    is_own = F.col("_at") == 0
    landed = spread.select(
        "Account_No", F.col("_month").alias("Fiscal_Month"), "Product_Category",
        F.when(is_own, label).otherwise(F.lit(carried_label)).alias("_label"),
        *[F.when(is_own, column).alias(name) for name, column in measures.items()],
        *[F.when(~is_own, column).alias(name) for name, column in carried.items()],
    )
    return landed.select(*[c for c in landed.columns if c != "_label"], _apart(F.col("_label")))


def _landed(tables: Tables, measures: Sequence[str], as_written: bool = False) -> tuple[DataFrame, DataFrame]:
    """Revenue and pipeline sums on the months they count for, own and future, not yet added up; and the anchor."""
    feeds = {"Baseline": ("Partner_Fee", "Revenue")}
    needed = {column for m in measures for column in feeds.get(m, (m,))}
    sold_measures = [m for m in REVENUE_MEASURES if m in needed]
    sold = _sold(tables, sold_measures, as_written)
    anchor = _anchor_of_sums(sold, tables, sold_measures)

    own = {m: F.col(m) for m in sold_measures}
    carried = {"Baseline": F.col("Partner_Fee") + F.col("Revenue")} if "Baseline" in measures else {}
    label = F.lit("revenue")
    if as_written:
        sold = align_revenue(sold.withColumn("Revenue_Date", F.col("Fiscal_Month")), tables.calendar, AS_WRITTEN)
        own["Sold_Copies"] = carried["Baseline_Copies"] = F.col(COPIES)
        label = F.concat(label, F.lit(" "), F.col("Revenue_Date").cast("string"))
    # No sum is later than the anchor. Saying so keeps Last_Date in the plan; see _anchor_of_sums.
    seen = F.col("Last_Date").isNull() | (F.col("Last_Date") <= F.col("_anchor.Anchor_Date"))
    revenue = _land(
        with_anchor(sold, anchor), label, own,
        months=F.col("_anchor.Future_Months"),
        carries=(F.col("Fiscal_Month") == F.col("_anchor.Fiscal_Month")) & seen,
        carried_label="baseline", carried=carried,
    )
    own_month, usage = F.col("Month_ID"), F.col("Opportunity_Usage")
    pipeline = _land(
        with_anchor(_pipeline(tables, anchor), anchor), F.lit("pipeline"),
        {"Opportunity_Usage": usage, "Opportunity_Extrap": months_times_usage(months_left("Fiscal_Month"), usage)},
        months=F.filter("_anchor.Future_Months", lambda month: month["Month_ID"] >= own_month),
        carries=F.col("Ahead").isNotNull(),
        carried_label="runrate", carried={"Opportunity_Into_RR": zero_if_negative(F.col("Ahead"))},
    )
    return revenue.unionByName(pipeline, allowMissingColumns=True), anchor


def _or_zero(df: DataFrame, measures: Sequence[str]) -> list[Column]:
    return [F.coalesce(m, F.lit(0).cast(df.schema[m].dataType)).alias(m) for m in measures]


def _by_key(stacked: DataFrame, *totals: Column) -> DataFrame:
    """``totals`` by key, in one shuffle, by account, and one sort.

    Hardly any two rows share a key by now. Summed in hash tables, one for the partial sums and one for the sums of these,
    a task would hold nearly all its rows twice, and then sort them for the join with the account's attributes. As one
    total is of text, which Spark keeps in no hash table, it sorts the rows by key instead, once for all three; and a sort
    spills where the memory does not suffice.
    """
    category = F.max("_category").alias("Product_Category")
    keyed = stacked.withColumnRenamed("Product_Category", "_category").repartition("Account_No")
    return keyed.groupBy("Account_No", "Fiscal_Month", "_category", "_apart").agg(category, *totals)


def all_facts(tables: Tables) -> DataFrame:
    """Revenue, pipeline, baseline, targets and run-rate, one row per key."""
    return facts_and_anchor(tables)[0]


def facts_and_anchor(tables: Tables, measures: Sequence[str] = MEASURES) -> tuple[DataFrame, DataFrame]:
    """``all_facts`` with the measures wanted, and the anchor it goes by.

    No joins but those with the calendar, and one pass over each source. Each is summed by key; revenue and pipeline
    sums are carried forward, row by row, to the future months they count for; and a last shuffle of these sums adds
    up what lands on the same key. That one is by account, which the join with the account's attributes needs
    anyway; an account has at most one row per source, month and category by then, so none is large.
    """
    landed, anchor = _landed(tables, measures)
    targets = targets_of(tables).select("*", _apart(F.lit("targets")))
    stacked = landed.unionByName(targets, allowMissingColumns=True)
    totals = _by_key(stacked, *[F.sum(m).alias(m) for m in measures])
    return totals.select(*KEYS, *_or_zero(totals, measures)), anchor


def stacked_facts(tables: Tables, measures: Sequence[str] = MEASURES) -> DataFrame:
    """The rows that ``all_facts`` sums by key, not summed: for totals of fewer columns, which are sums of these as well."""
    landed, _ = _landed(tables, measures)
    targets = align_targets(tables.targets, tables.calendar)
    stacked = landed.unionByName(targets, allowMissingColumns=True)
    return stacked.select(*KEYS, *measures)


def month_totals(tables: Tables) -> tuple[DataFrame, DataFrame]:
    """``Fiscal_Month``, ``Sold`` (Revenue + Partner_Fee) and ``Expected`` (Baseline + run-rate) of every month with any fact,
    and the anchor.

    Revenue and baseline are sums of revenue, so they are summed by month at once; only the run-rate is clamped by key, and so
    needs its keys first. A month that has targets alone counts as one with facts.
    """
    fees = ("Revenue", "Partner_Fee")
    sold = _sold(tables, fees, as_written=False, by=("Fiscal_Month",))
    anchor = _anchor_of_sums(sold, tables, fees)
    amount = F.col("Revenue") + F.col("Partner_Fee")
    seen = F.col("Last_Date").isNull() | (F.col("Last_Date") <= F.col("_anchor.Anchor_Date"))  # see _landed
    revenue = with_anchor(sold, anchor)
    own = revenue.select("Fiscal_Month", amount.alias("Sold"))
    base = revenue.filter((F.col("Fiscal_Month") == F.col("_anchor.Fiscal_Month")) & seen).select(
        F.explode("_anchor.Future_Months").alias("_month"), amount.alias("Expected"))
    ahead, estimate = _pipeline(tables, anchor), F.col("Month_ID")
    later = F.filter("_anchor.Future_Months", lambda month: month["Month_ID"] >= estimate)
    rate = with_anchor(ahead.filter("Ahead is not null"), anchor).select(
        F.explode(later).alias("_month"), zero_if_negative(F.col("Ahead")).alias("Expected"))
    expected = base.unionByName(rate).select(F.col("_month.Fiscal_Month").alias("Fiscal_Month"), "Expected")
    present = align_targets(tables.targets, tables.calendar).select("Fiscal_Month").unionByName(ahead.select("Fiscal_Month"))
    parts = own.unionByName(expected, allowMissingColumns=True).unionByName(present, allowMissingColumns=True)
    sums = parts.groupBy("Fiscal_Month").agg(F.sum("Sold").alias("Sold"), F.sum("Expected").alias("Expected"))
    return sums.select("Fiscal_Month", *_or_zero(sums, ("Sold", "Expected"))), anchor


def all_facts_as_written(tables: Tables) -> DataFrame:
    """The facts with ``Copies``: how many times each row stands in the result.

    Built like ``all_facts``. On a key there is at most one row each of revenue, pipeline and baseline, and a
    run-rate row for every estimate month, at most one per month of a fiscal year: these are listed while the others
    are put side by side, and then taken out of the list again. Nothing limits the targets on a key; they come last.
    """
    landed, _ = _landed(tables, MEASURES, as_written=True)
    single = [m for m in MEASURES if m not in ("Target", "Opportunity_Into_RR")]
    side_by_side = landed.groupBy(*KEYS, "_apart").agg(
        *[F.sum(m).alias(m) for m in single],
        (F.coalesce(F.max("Sold_Copies"), F.lit(1)) * F.coalesce(F.max("Baseline_Copies"), F.lit(1))).alias(COPIES),
        F.collect_list("Opportunity_Into_RR").alias("Runrates"),
    )
    rows = side_by_side.withColumn("Opportunity_Into_RR", F.explode_outer("Runrates"))
    bounded = rows.select(*KEYS, *_or_zero(rows, [*single, "Opportunity_Into_RR"]), COPIES)
    return merge_facts(bounded, targets_of(tables, AS_WRITTEN), crowded="right").select(*KEYS, *MEASURES, COPIES)
