"""Column expressions: text to category, text to amount, month to months left, amount to range label."""

from ledgerline.functions.amounts import is_amount, parse_amount
from ledgerline.functions.categories import category_of
from ledgerline.functions.months import months_left
from ledgerline.functions.ranges import range_label

__all__ = ["category_of", "is_amount", "months_left", "parse_amount", "range_label"]
