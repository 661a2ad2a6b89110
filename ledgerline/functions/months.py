from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The months of the fiscal year, first to last.
FISCAL_MONTHS = (
    "July", "August", "September", "October", "November", "December",
    "January", "February", "March", "April", "May", "June",
)


def months_left(fiscal_month: Column | str, inclusive: bool = False) -> Column:
    """Months from ``fiscal_month`` (text that holds a month name) to the end of its fiscal year.

    The last month has 0 left, or 1 if ``inclusive``. NULL for NULL and for text without a month name.
    """
    text = F.col(fiscal_month) if isinstance(fiscal_month, str) else fiscal_month
    last = len(FISCAL_MONTHS) - (0 if inclusive else 1)
    return F.coalesce(*[F.when(text.contains(name), F.lit(last - i)) for i, name in enumerate(FISCAL_MONTHS)])
