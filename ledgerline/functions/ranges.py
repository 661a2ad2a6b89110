from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lower and upper bound (both inclusive) and label; an amount on two bounds takes the earlier range.
BELOW_ZERO = "Below < $0"
RANGES = (
    (0, 10_000, "$0 to $10,000"),
    (10_000, 50_000, "$10,000 to $50,000"),
    (50_000, 100_000, "$50,000 to $100,000"),
    (100_000, 200_000, "$100,000 to $200,000"),
)
ABOVE = "200,000 +"


def range_label(amount: Column | str) -> Column:
    """The reporting range of an amount. NULL is in no range and so gets the last label, like any amount above."""
    amount = F.col(amount) if isinstance(amount, str) else amount
    return reduce(
        lambda labels, bounds: labels.when(amount.between(bounds[0], bounds[1]), F.lit(bounds[2])),
        RANGES,
        F.when(amount < 0, F.lit(BELOW_ZERO)),
    ).otherwise(F.lit(ABOVE))
