from itertools import product

import pytest
from conftest import bag
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from ledgerline.operators import expand_copies, merge_facts, one_row_per_key

KEY = st.tuples(st.sampled_from([1, 2, None]), st.sampled_from(["a", "b", None]), st.sampled_from(["x", "y"]))
ROWS = st.lists(st.tuples(KEY, st.integers(-3, 3)), max_size=8)


def frame(spark, rows, measure):
    return spark.createDataFrame(
        [(*key, value) for key, value in rows],
        f"Account_No int, Fiscal_Month string, Product_Category string, {measure} int",
    )


def brute_force(a, b):
    """The full outer join, key by key, in plain Python; a NULL in a key matches nothing."""
    out = []
    matchable = {k for k, _ in a + b if None not in k}
    for key in matchable:
        left = [v for k, v in a if k == key] or [0]
        right = [v for k, v in b if k == key] or [0]
        out += [(*key, x, y) for x, y in product(left, right)]
    out += [(*k, v, 0) for k, v in a if None in k] + [(*k, 0, v) for k, v in b if None in k]
    return sorted(out, key=repr)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(a=ROWS, b=ROWS)
def test_merge_is_a_full_outer_join_however_it_is_planned(spark, a, b):
    left, right = frame(spark, a, "A"), frame(spark, b, "B")
    for crowded in (None, "left", "right"):
        merged = merge_facts(left, right, crowded=crowded)
        assert merged.columns == ["Account_No", "Fiscal_Month", "Product_Category", "A", "B"]
        assert bag(merged) == brute_force(a, b)


def test_copies_multiply_and_expand(spark):
    left = spark.createDataFrame([(1, "a", "x", 5, 3), (2, "a", "x", 6, 2)],
                                 "Account_No int, Fiscal_Month string, Product_Category string, A int, Copies long")
    right = spark.createDataFrame([(1, "a", "x", 7, 2), (3, "a", "x", 8, 4)],
                                  "Account_No int, Fiscal_Month string, Product_Category string, B int, Copies long")
    expected = [(1, "a", "x", 5, 7, 6), (2, "a", "x", 6, 0, 2), (3, "a", "x", 0, 8, 4)]
    for crowded in (None, "left", "right"):
        merged = merge_facts(left, right, crowded=crowded)
        assert bag(merged) == expected
        assert bag(expand_copies(merged)) == sorted([r[:-1] for r in expected for _ in range(r[-1])], key=repr)


def test_one_row_per_key_sums_and_keeps_null_keys(spark):
    rows = [((1, "a", "x"), 2), ((1, "a", "x"), 3), ((1, None, "x"), 4)]
    assert bag(one_row_per_key(frame(spark, rows, "A"))) == [(1, "a", "x", 5), (1, None, "x", 4)]


def test_crowded_takes_a_side(spark):
    with pytest.raises(ValueError, match="crowded"):
        merge_facts(frame(spark, [], "A"), frame(spark, [], "B"), crowded="both")
