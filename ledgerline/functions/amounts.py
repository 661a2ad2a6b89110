from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.schemas import MONEY


def _number(text: Column | str, to: T.DataType) -> Column:
    # A text may be costly to make, and a filter makes it wherever it is named: that of a number is needed once.
    plain = F.trim(F.replace(text, F.lit(","), F.lit("")))
    return F.coalesce(plain.try_cast(to), F.when(plain == "", F.lit(0).cast(to)))


def is_amount(text: Column | str, to: T.DataType = MONEY) -> Column:
    """Whether ``parse_amount`` can read the text; NULL and blank text it can."""
    return _number(text, to).isNotNull() | F.isnull(text)


def parse_amount(text: Column | str, to: T.DataType = MONEY) -> Column:
    """A text amount such as ``-1,234.50`` as a number; NULL stays NULL, and blank text is 0.

    Text that is no number, or too large for ``to``, is an error. ``is_amount`` tells such rows beforehand.
    Decimal, so that sums do not depend on the order in which partitions arrive. Digits beyond the scale of ``to``
    are rounded.
    """
    text = F.col(text) if isinstance(text, str) else text
    wrong = F.raise_error(F.concat(F.lit("not an amount: "), text)).cast(to)
    return F.coalesce(_number(text, to), F.when(F.isnotnull(text), wrong))


def zero_if_negative(amount: Column) -> Column:
    """NULL stays NULL, which ``greatest(amount, 0)`` would not keep."""
    return F.when(amount < 0, F.lit(0)).otherwise(amount)
