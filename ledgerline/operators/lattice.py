"""All combinations of grouping columns, each summed from a smaller one instead of from the rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def smallest_parent(kept: Sequence[str], by: Sequence[str], sizes: Mapping[str, int]) -> tuple[str, ...]:
    """The combination with one column of ``by`` more that ``cube_by_lattice`` sums ``kept`` from: the one with the fewest rows,
    as the product of its columns' sizes has it, which is that with the smallest column added."""
    order = _largest_first(by, sizes)
    added = [c for c in order if c not in kept][-1]
    return tuple(c for c in by if c in kept or c == added)


def _largest_first(by: Sequence[str], sizes: Mapping[str, int]) -> list[str]:
    return sorted(by, key=lambda c: -sizes[c])


def cube_by_lattice(finest: DataFrame, by: Sequence[str], measures: Sequence[str], sizes: Mapping[str, int]) -> DataFrame:
    """``finest`` has one row for each combination of values of ``by``; the result has the sums for all combinations of columns,
    with NULL for a column that is summed over, and ``Grouping_ID`` with a bit for each such column, the first one's highest.

    A cube turns every row into one for each of the 2^n combinations before its one shuffle. Here the columns are summed over one
    after the other, the largest first, each step on the sums of the steps before: a row becomes two, one of them without the
    column, so n steps shuffle two rows for each of the finest at most, and mostly one. Each combination is thereby summed from
    its smallest parent. Sums are taken on the map side first, so a value that most rows have makes no large task.

    ``sizes`` tells roughly how many values each column has; it decides on the order, not on the result.
    """
    rows = finest.select(*by, F.lit(0).cast("long").alias("Grouping_ID"), *measures)
    for column in _largest_first(by, sizes):
        bit = 1 << (len(by) - 1 - list(by).index(column))
        gone = F.col("_gone")
        doubled = rows.withColumn("_gone", F.explode(F.array(F.lit(False), F.lit(True)))).withColumns({
            column: F.when(~gone, F.col(column)),
            "Grouping_ID": F.col("Grouping_ID") + F.when(gone, F.lit(bit)).otherwise(F.lit(0)),
        })
        rows = doubled.groupBy(*by, "Grouping_ID").agg(*[
            F.sum(m).cast(finest.schema[m].dataType).alias(m) for m in measures])
    return rows


def column_sizes(df: DataFrame, columns: Sequence[str]) -> dict[str, int]:
    """Roughly how many values each column has: one pass over ``df``, run at once, of sketches of a few kB each."""
    row = df.agg(*[F.approx_count_distinct(c).alias(c) for c in columns]).first()
    return {c: max(row[c], 1) for c in columns}
