from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word to look for, category it stands for; the first word found decides.
CATEGORY_RULES = (("Service", "Services"), ("Support", "Support"), ("Product", "Products"))
UNMAPPED = "Need Mapping"


def category_of(
    text: Column | str, rules: Sequence[tuple[str, str]] = CATEGORY_RULES, default: str = UNMAPPED
) -> Column:
    """The category of a free-text product name; NULL and names without any of the words get ``default``.

    Case counts, unless the column has a collation that ignores it (``sources.ignoring_case``).
    """
    text = F.col(text) if isinstance(text, str) else text
    # Built from the last rule outwards, so that the first rule ends up outermost.
    return reduce(
        lambda rest, rule: F.when(text.contains(rule[0]), F.lit(rule[1])).otherwise(rest),
        reversed(rules),
        F.lit(default),
    )
