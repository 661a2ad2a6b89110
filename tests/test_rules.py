"""Categories from a table of rules against the chain of conditions, and against brute force."""

import random

from conftest import bag

from ledgerline import operators as ops
from ledgerline.functions.categories import CATEGORY_RULES, category_of

SCHEMA = "Rank int, Word string, Category string"


def test_equals_the_chain_on_its_rules(spark, tiny):
    rules = spark.createDataFrame([(i, *r) for i, r in enumerate(CATEGORY_RULES)], SCHEMA)
    got = ops.categorize_by_rules(tiny.revenue, "Product_Category", "Into", rules)
    assert bag(got) == bag(tiny.revenue.withColumn("Into", category_of("Product_Category")))


def test_thousands_of_rules_and_odd_ones(spark):
    choose = random.Random(3)
    text = lambda n: "".join(choose.choice("abé ") for _ in range(n))
    rules = [(choose.randint(0, 900), text(choose.randint(1, 7)), f"c{i}") for i in range(3000)]
    rules += [(None, "", "last"), (0, None, "never"), (0, "b", None), (5000, "zz", "z"), (5000, "z", "one z"), (5000, "z", "a z")]
    texts = [text(choose.randint(0, 30)) for _ in range(200)] + ["zz", "zz", "", "q", None, None]
    rows = [(t, i % 3) for i, t in enumerate(texts)]

    def first(t, kept):
        hits = [(r is None, r or 0, w, c) for r, w, c in kept if w is not None and c is not None and t is not None and w in t]
        return min(hits)[3] if hits else "none"

    df = spark.createDataFrame(rows, "Word string, Rank int")
    for kept in (rules, rules[-4:], []):
        got = ops.categorize_by_rules(df, "Word", "Into", spark.createDataFrame(kept, SCHEMA), "none")
        assert got.columns == ["Word", "Rank", "Into"]
        assert bag(got) == sorted(((t, k, first(t, kept)) for t, k in rows), key=repr)


def test_the_plan_does_not_grow_with_the_rules(spark, tiny):
    def length(n):
        rules = spark.range(n).selectExpr("cast(id as int) as Rank", "cast(id as string) as Word", "'x' as Category")
        df = ops.categorize_by_rules(tiny.revenue, "Product_Category", "Into", rules)
        return len(df._jdf.queryExecution().optimizedPlan().toString().splitlines())

    assert length(3) == length(5000)
