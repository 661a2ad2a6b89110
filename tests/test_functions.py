from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerline.functions import category_of, is_amount, months_left, parse_amount, range_label
from ledgerline.functions.amounts import zero_if_negative
from ledgerline.functions.months import FISCAL_MONTHS


def apply(spark, expr, values, dtype):
    df = spark.createDataFrame(list(enumerate(values)), f"i int, x {dtype}")
    return [r[0] for r in df.select("i", expr(F.col("x")).alias("y")).orderBy("i").select("y").collect()]


def test_amounts_keep_every_digit(spark):
    texts = ["1,234.50", "-50,000", "0", " 12 ", "1e3", "", "0.004", "12345678901234567.00", "10.005", None]
    assert apply(spark, parse_amount, texts, "string") == [
        Decimal("1234.50"), -50000, 0, 12, 1000, 0, Decimal("0.004"), 12345678901234567, Decimal("10.005"), None,
    ]


@pytest.mark.parametrize("text", ["n/a", "$500", "(500)", "1 000", "1" * 30])
def test_text_that_is_no_amount_is_an_error(spark, text):
    assert apply(spark, is_amount, [text, "1", None], "string") == [False, True, True]
    with pytest.raises(Exception, match="not an amount"):
        apply(spark, parse_amount, [text], "string")


def test_zero_if_negative_keeps_null(spark):
    assert apply(spark, zero_if_negative, [-1, 0, 2, None], "int") == [0, 0, 2, None]


@pytest.mark.parametrize("text, category", [
    ("Service Basic", "Services"), ("Support Desk", "Support"), ("Product Promo", "Products"),
    ("Service Support Plus", "Services"), ("Product Support", "Support"),  # the first word in the rules wins
    ("Standard", "Need Mapping"), (None, "Need Mapping"), ("service", "Need Mapping"),
])
def test_category(spark, text, category):
    assert apply(spark, category_of, [text], "string") == [category]


def test_category_with_own_rules(spark):
    assert apply(spark, lambda c: category_of(c, [("a", "A")], "?"), ["ba", "b"], "string") == ["A", "?"]


def test_months_left_counts_down_from_july(spark):
    months = [f"{name}, 2019" for name in FISCAL_MONTHS]
    assert apply(spark, months_left, months, "string") == list(range(11, -1, -1))
    assert apply(spark, lambda c: months_left(c, inclusive=True), months, "string") == list(range(12, 0, -1))
    assert apply(spark, months_left, [None, "2019"], "string") == [None, None]


def test_range_edges_take_the_earlier_range_and_null_the_last(spark):
    values = [-1.0, 0.0, 10000.0, 10000.01, 50000.0, 100000.0, 200000.0, 200000.01, None]
    assert apply(spark, range_label, values, "double") == [
        "Below < $0", "$0 to $10,000", "$0 to $10,000", "$10,000 to $50,000", "$10,000 to $50,000",
        "$50,000 to $100,000", "$100,000 to $200,000", "200,000 +", "200,000 +",
    ]
