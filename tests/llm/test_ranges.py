"""Documents in order over ranges: followers against brute force, with hot ids, hot rows and NULLs."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgerline.llm import fingerprints, ranges
from ledgerline.llm.common import ship
from ledgerline.llm.fingerprints import edited

SCHEMA = "doc_id long, text string"


def digests(rows):
    """Of each row its id and the digest of its edited text, one after the other."""
    def place(row):
        text = (row[1] or "").encode()
        return row[0] is None, row[0] or 0, text[: ranges.PREFIX].ljust(ranges.PREFIX, b"\0"), text

    order = sorted(rows, key=place)
    return Counter((i, hashlib.sha256(edited(t or "", order[(k + 1) % len(order)][1] or "").encode()).hexdigest())
                   for k, (i, t) in enumerate(order))


def found(spark, rows):
    ship(spark)
    done = fingerprints.compared(spark.createDataFrame(rows, SCHEMA).repartition(5))
    return Counter((r.doc_id, r.edited_sha256) for r in done.collect())


@pytest.mark.parametrize("doc_id", [7, None, 2**63 - 1, -(2**63)])
def test_equal_rows_are_divided_and_followed(spark, monkeypatch, doc_id):
    monkeypatch.setattr(ranges, "LEAST_ROWS", 50)
    rows = [(i, f"own text {i} and so on") for i in range(-500, 500)] + [(doc_id, "said again and again")] * 1_500
    rows += [(None, f"{i} without an id") for i in range(300)] + [(7, f"{i} of one id") for i in range(300)]
    assert found(spark, rows) == digests(rows)


def test_texts_of_one_long_beginning_are_divided(spark, monkeypatch):
    monkeypatch.setattr(ranges, "LEAST_ROWS", 20)
    ship(spark)
    rows = [(None, "x" * 40 + f" {i}") for i in range(2_000)]
    keyed = spark.createDataFrame(rows, SCHEMA).withColumn(
        "key", F.concat(ranges.number_key("doc_id", True), ranges.text_key(F.col("text"))))
    sizes = [r["count"] for r in ranges.in_ranges(keyed, "text", 1 << 20).groupBy("range").count().collect()]
    assert len(sizes) > 32 and max(sizes) < 200 and sum(sizes) == len(rows)


@pytest.mark.parametrize("rows", [[(1, "alone with itself")], [(None, None), (None, None), (3, "")], [(1, "a\0b c d"), (1, "a"), (1, "a\0")]])
def test_few_rows(spark, rows):
    assert found(spark, rows) == digests(rows)


def test_ranges_go_with_the_bytes(spark, monkeypatch):
    ship(spark)
    keyed = spark.range(20_000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("t"), 100).alias("text")).withColumn(
        "key", F.concat(ranges.number_key("doc_id", True), ranges.text_key(F.col("text"))))
    assert ranges.ranges_of(keyed, "text", 1 << 15).total == 20_000 * 164 // (1 << 15)


def test_likeness_is_near_true_jaccard(spark):
    ship(spark)
    words = [f"w{i}" for i in range(600)]
    rows = [(i, " ".join(words[: 600 - 40 * i])) for i in range(10)]
    sets = [{tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for _, t in rows]
    for r in fingerprints.compared(spark.createDataFrame(rows, SCHEMA)).collect():
        a, b = sets[r.doc_id], sets[(r.doc_id + 1) % 10]
        assert abs(r.near_next - len(a & b) / len(a | b)) < 0.15
