"""Mixing sources to target weights by hash thresholds.

A document's hash, 60 bits of the MD5 of its doc_id, decides in which order its source is taken. Sizes are summed by source and
hash bucket; running sums over the buckets find the one in which a source's budget ends, and only that one is summed again by
finer buckets, level by level. What is below the threshold is taken; nothing is sorted.

Weights go by the rank of the source (code points, NULL last). Targets share ``share`` times all sizes by weight; none is above
``most`` times its source, and the excess goes to the others by weight. A target above its source takes the whole source once
and the rest of the budget again. The threshold is the one that comes nearest to the budget.

Defined cases: NULL and empty texts have size 0; rows that share a doc_id are taken together; a NULL doc_id has a hash of its
own; a NULL source is a source; an empty table gives no rows. The sources, one short row each, are ranked in one window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerline.llm.common import cut, sized, text_of, words

WEIGHTS = (5, 2, 1)
# 3/2 of all sizes; twice a source at most.
SHARE = (3, 2)
MOST = 2
LEVELS, BITS = 4, 15


def hash60(doc_id: Column) -> Column:
    name = F.coalesce(doc_id.cast("string"), F.lit("null"))
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, 15), 16, 10).cast("long")


def _bucket(level: int) -> Column:
    """The bits of the hash that levels 1 to ``level`` look at."""
    return F.shiftright("h", BITS * (LEVELS - level))


def targets(sizes: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST) -> DataFrame:
    """``source``, ``source_size``, ``target``: the fill level at which the capped targets add up to the share."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(rank - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = totals.select("source", "source_size", weight.cast("long").alias("w"))
    # In the order in which they reach their caps; what each would get per weight if those before it were capped.
    order = W.orderBy(F.col("source_size") / F.col("w"), F.col("source").asc_nulls_last())
    after = order.rowsBetween(0, W.unboundedFollowing)
    before = order.rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    budget = share[0] * F.sum("source_size").over(everything)
    capped = F.coalesce(F.sum("source_size").over(before), F.lit(0))
    rest = (budget - share[1] * most * capped).cast("double")
    level = rest / (share[1] * F.sum("w").over(after)).cast("double")
    levels = ranked.withColumn("place", F.row_number().over(order)).withColumn("level", level)
    is_open = F.col("level") * F.col("w") <= F.col("source_size") * most
    # The level of the first that stays under its cap.
    filled = levels.withColumn("fill", F.min_by("level", F.when(is_open, F.col("place"))).over(everything))
    cap = (F.col("source_size") * most).cast("double")
    target = F.when(F.col("fill").isNull(), cap).otherwise(F.least(cap, F.col("fill") * F.col("w")))
    return filled.select("source", "source_size", target.alias("target"))


def thresholds(sizes: DataFrame, budgets: DataFrame) -> DataFrame:
    """``source``, ``source_size``, ``target``, ``whole`` passes, and ``upto``: hashes up to it are taken once more.

    ``sizes``: ``source``, ``h``, ``size``. ``budgets``: from ``targets``. Both cut. A source has 2^15 buckets a level at most.
    """
    per_source = W.partitionBy("source").orderBy("bucket")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    budgets = budgets.withColumn("whole", whole)
    left = F.floor(F.col("target") - F.col("whole") * F.col("source_size")).cast("long")
    state = budgets.select("source", left.alias("left"), F.lit(0).cast("long").alias("prefix")).filter("left > 0")
    for level in range(1, LEVELS + 1):
        side = sized(cut(state))
        boundary = side.select(F.col("source").alias("of"), "left", "prefix")
        inside = sizes.join(boundary, F.col("source").eqNullSafe(F.col("of")) & (_bucket(level - 1) == F.col("prefix")))
        counted = inside.groupBy("source", "left", _bucket(level).alias("bucket")).agg(F.sum("size").alias("size"))
        running = counted.withColumn("upto", F.sum("size").over(per_source)).filter("upto >= left and upto - size < left")
        state = running.groupBy("source").agg(
            F.min_by(F.col("left") - F.col("upto") + F.col("size"), "bucket").alias("left"),
            F.min("bucket").alias("prefix"), F.min_by("size", "bucket").alias("size"))
    nearest = state.select(
        F.col("source").alias("of"), (F.col("prefix") - F.when(2 * F.col("left") >= F.col("size"), 0).otherwise(1)).alias("upto"))
    return budgets.join(nearest, F.col("source").eqNullSafe(F.col("of")), "left").select(
        "source", "source_size", "target", "whole", F.coalesce("upto", F.lit(-1)).alias("upto"))


def document_sizes(documents: DataFrame) -> DataFrame:
    """``doc_id``, ``source``, ``size`` in words, ``h``."""
    return documents.select(
        "doc_id", "source", F.size(words(text_of())).cast("long").alias("size"), hash60(F.col("doc_id")).alias("h"))


def _rules(sizes: DataFrame) -> DataFrame:
    found = cut(thresholds(sizes, cut(targets(sizes))))
    return sized(found.withColumnRenamed("source", "of"))


def mix(documents: DataFrame) -> DataFrame:
    """A row for each document: ``doc_id``, ``size``, ``source_size``, ``target``, ``taken``, and ``source``."""
    sizes = cut(document_sizes(documents))
    times = F.col("whole") + (F.col("h") <= F.col("upto")).cast("long")
    return sizes.join(_rules(sizes), F.col("source").eqNullSafe(F.col("of"))).select(
        "doc_id", "source", "size", "source_size", "target", (F.col("size") * times).alias("taken"))


def mixed_documents(documents: DataFrame) -> DataFrame:
    """The documents of the mix, whole rows: each as often as it is taken."""
    sizes = cut(document_sizes(documents))
    rows = documents.select(F.struct("*").alias("row"), hash60(F.col("doc_id")).alias("own_hash"))
    times = F.col("whole") + (F.col("own_hash") <= F.col("upto")).cast("long")
    joined = rows.join(_rules(sizes), F.col("row.source").eqNullSafe(F.col("of")))
    return joined.select("row", F.explode(F.array_repeat(F.lit(0), times.cast("int")))).select("row.*")
