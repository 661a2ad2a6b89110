"""Bringing facts together on account, month and category."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.operators.keys import COPIES, KEYS


def one_row_per_key(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """All other columns summed by key. The shuffle is on the key, so a join on it needs no further one."""
    return df.groupBy(*keys).agg(*[F.sum(name).alias(name) for name in df.columns if name not in keys])


def _measures(df: DataFrame, keys: Sequence[str]) -> list[str]:
    return [name for name in df.columns if name not in (*keys, COPIES)]


def _copies(side: str, df: DataFrame) -> Column:
    return F.coalesce(f"{side}.{COPIES}", F.lit(1)) if COPIES in df.columns else F.lit(1)


def _or_zero(side: str, df: DataFrame, name: str) -> Column:
    # The zero takes the measure's own type, so that the type does not depend on which side is missing.
    return F.coalesce(f"{side}.{name}", F.lit(0).cast(df.schema[name].dataType)).alias(name)


def merge_facts(
    left: DataFrame, right: DataFrame, keys: Sequence[str] = KEYS, crowded: str | None = None
) -> DataFrame:
    """Full outer join on ``keys``: every key of either side once, with 0 for the measures of a side that lacks it.

    Rows with a NULL in the key match nothing and stay apart. Where a side repeats a key, the other side's row is
    repeated with it, and their ``Copies`` multiply.

    A full outer join needs all rows of a key in one task. That is fine for sums by key; if one side is not summed,
    so that one key may hold any share of its rows, name it (``"left"`` or ``"right"``) in ``crowded``. The join is
    then made of two that Spark may split within a key: that side with what matches it, plus the other side's rows
    that match nothing.
    """
    if crowded not in (None, "left", "right"):
        raise ValueError(f"crowded must be 'left' or 'right', not {crowded!r}")
    if crowded == "left":
        merged = merge_facts(right, left, keys, "right")
        order = [*keys, *_measures(left, keys), *_measures(right, keys)]
        return merged.select(*order, *[c for c in (COPIES,) if c in merged.columns])

    a, b = left.alias("a"), right.alias("b")
    same_key = reduce(and_, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys])
    columns = [
        *[F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in keys],
        *[_or_zero("a", left, m) for m in _measures(left, keys)],
        *[_or_zero("b", right, m) for m in _measures(right, keys)],
    ]
    with_copies = COPIES in left.columns or COPIES in right.columns
    if with_copies:
        columns.append((_copies("a", left) * _copies("b", right)).alias(COPIES))

    if crowded is None:
        return a.join(b, same_key, "full").select(*columns)

    # One key column that is never NULL: a key with a NULL in it is labelled by side, and so still matches nothing.
    # Without NULLs to filter, both joins take the left side as it is, and Spark shuffles it once for the two.
    def keyed(df: DataFrame, side: str) -> DataFrame:
        has_null = reduce(or_, [F.col(k).isNull() for k in keys])
        return df.withColumn("_key", F.struct(*keys, F.when(has_null, F.lit(side)).alias("_side")))

    a, b = keyed(left, "left").alias("a"), keyed(right, "right").alias("b")
    matched = b.join(a, F.col("a._key") == F.col("b._key"), "left").select(*columns)
    alone = a.join(b.select("_key").distinct(), "_key", "left_anti").alias("a")
    zeros = [F.lit(0).cast(right.schema[m].dataType).alias(m) for m in _measures(right, keys)]
    copies = [_copies("a", left).alias(COPIES)] if with_copies else []
    own = [_or_zero("a", left, m) for m in _measures(left, keys)]
    return matched.unionByName(alone.select(*keys, *own, *zeros, *copies))


def expand_copies(df: DataFrame) -> DataFrame:
    """Each row as many times as its ``Copies`` say."""
    return df.withColumn(COPIES, F.explode(F.sequence(F.lit(1), F.col(COPIES)))).drop(COPIES)


def fold_copies(df: DataFrame) -> DataFrame:
    """Equal rows as one, with their number in ``Copies``, the last column."""
    return df.groupBy(*[name for name in df.columns if name != COPIES]).agg(F.sum(COPIES).alias(COPIES))
