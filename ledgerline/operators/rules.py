"""Categories from a table of rules, for more rules than a chain of conditions could hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.categories import UNMAPPED

# Characters of a rule's word, from its start, under which it is found.
ANCHOR = 4


def _pieces(text: Column, length: int) -> Column:
    """The runs of so many characters of the text."""
    last = F.char_length(text) - length + 1
    return F.when(last < 1, F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda at: F.substring(text, at, F.lit(length))))


def categorize_by_rules(df: DataFrame, col: str, into: str, rules: DataFrame, default: str = UNMAPPED) -> DataFrame:
    """``df`` with ``into``: the category of the first rule, by rank, whose word is within the text ``col``; else ``default``.

    ``rules`` has ``Rank``, ``Word``, ``Category``. The result is that of ``category_of`` on the rules in order of rank, but
    the plan does not grow with them: the distinct texts are split into runs of up to ``ANCHOR`` characters, which meet the rules
    on the start of their words in one join, and only those that meet are looked for. A column may be named as in ``rules``.

    Of equal ranks the smaller word, then the smaller category, is first; a rule without a rank comes last. Rules without a word
    or category are left out, an empty word is in every text but NULL. Case counts. Repeated rows stay.
    """
    text = F.col("text")
    names = df.select(F.col(col).cast("string").alias("text")).filter("text is not null").groupBy("text").agg(F.count("*").alias("n"))
    runs = F.array_distinct(F.concat(F.array(F.lit("")), *[_pieces(text, n) for n in range(1, ANCHOR + 1)]))
    told = rules.select(
        F.col("Rank").alias("rank"), F.col("Word").cast("string").alias("word"), F.col("Category").alias("category"))
    told = told.filter("word is not null and category is not null").withColumn("anchor", F.substring("word", 1, ANCHOR))
    # Each word is found by one run only, as long as its anchor, so a text meets a rule once.
    met = names.select("text", F.explode(runs).alias("anchor")).join(told, "anchor").filter(text.contains(F.col("word")))
    first = met.groupBy(text.alias("__text")).agg(
        F.min_by("category", F.struct(F.col("rank").isNull(), "rank", "word", "category")).alias("__category"))
    found = df.join(first, F.col(col).cast("string") == F.col("__text"), "left")
    return found.withColumn(into, F.coalesce("__category", F.lit(default))).drop("__text", "__category")
