"""Sharding: the law of bytes where rows repeat, gapless slots, ends against brute force."""

import random
from collections import Counter, defaultdict

import pytest
from conftest import TESTDATA
from pyspark.sql import functions as F

from ledgerline.llm import sharding
from ledgerline.llm.common import ship


def frame(spark, rows):
    ship(spark)
    return spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows],
                                 "doc_id long, text string, row string, shard int, k1 string")


def held(rows, spread=1):
    """Checks slots, and that shards are within the tolerance or a record of the ideal; returns the bytes by shard."""
    sizes, slots = Counter(), defaultdict(list)
    for r in rows:
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    ideal = sum(sizes.values()) / sharding.SHARDS
    largest = max(r.size for r in rows)
    assert all(abs(sizes[s] - ideal) <= 2 * max(sharding.TOLERANCE * ideal, spread * largest / 2) + 1 for s in range(8))
    return sizes


EQUAL = [(7, "the very same row")] * 4000
OWN = [(i, f"text {i} " + "x" * (i % 13)) for i in range(6000)]


def test_equal_rows_are_divided(spark):
    rows = sharding.sharded(frame(spark, EQUAL + OWN)).collect()
    assert len(rows) == 10_000 and len(held(rows)) == 8


def test_rows_without_an_id_are_divided(spark):
    rows = sharding.sharded(frame(spark, [(None, "one text")] * 5000 + [(None, f"t{i}") for i in range(300)])).collect()
    assert len(held(rows)) == 8 and Counter(r.doc_id for r in rows) == {None: 5300}
    only = sharding.sharded(frame(spark, [(None, None)] * 4000)).collect()
    assert held(only) == dict.fromkeys(range(8), 500)


def test_one_key_of_many_rows_is_spread_over_cells(spark):
    records = frame(spark, EQUAL + OWN)
    rows = sharding.keyed(records)
    assert rows.select("row").distinct().count() == 10_000
    spread = rows.filter("doc_id = 7").groupBy(F.pmod("row", F.lit(sharding.LEAST_CELLS))).count().collect()
    assert len(spread) == sharding.LEAST_CELLS and max(r["count"] for r in spread) < 150


@pytest.mark.parametrize("few", [1024, 4])
def test_ends_equal_brute_force(spark, monkeypatch, few):
    """Also when sampling has to go on until four items are left."""
    monkeypatch.setattr(sharding, "FEW", few)
    monkeypatch.setattr(sharding, "TOLERANCE", 0.0)
    rng = random.Random(1)
    rows = [(rng.randint(0, 40), "w" * rng.choice([0, 5, 50])) for _ in range(500)] + [(i, f"a{i}") for i in range(900)]
    rows += [(3, "hot")] * 700
    keys = sharding.keyed(frame(spark, rows)).select("k1", "k2", "size").collect()
    order = sorted((r.k1, r.k2, r.size) for r in keys)
    total, ends, reached = sum(s for *_, s in order), [], 0
    bounds = [0]
    for *_, size in order:
        reached += size
        bounds.append(reached)
    want = [min(abs(b - shard * total / 8) for b in bounds) for shard in range(1, 8)]
    got = sharding.sharded(frame(spark, rows)).groupBy("shard").agg(F.sum("size").alias("size")).orderBy("shard").collect()
    assert [r.shard for r in got] == list(range(8))
    reached = 0
    for shard, miss in zip(range(1, 8), want, strict=True):
        reached += got[shard - 1].size
        ends.append(abs(reached - shard * total / 8))
        assert ends[-1] == pytest.approx(miss)


def ended_nearest(rows, spread=0):
    """Checks that each end is as near to its place as the order allows, give or take the tolerance."""
    sizes, reached = held(rows), 0
    total = sum(sizes.values())
    for shard in range(1, 8):
        reached += sizes[shard - 1]
        assert abs(reached - shard * total / 8) <= max(sharding.TOLERANCE * total / 8, spread)


COPIED = "one text that many documents share"


@pytest.mark.parametrize("copies, others", [(4000, 6000), (2500, 40_000), (9000, 0)])
def test_ends_among_copies_of_a_text_are_found(spark, copies, others):
    """A text that holds most of a range beside others, which were cut off by one sampled text each round."""
    texts = [COPIED] * copies + [f"text {i}" for i in range(others)]
    rows = sharding.sharded(frame(spark, list(enumerate(texts)))).collect()
    assert len({r.doc_id for r in rows}) == copies + others
    ended_nearest(rows, spread=len(COPIED))


def test_ends_among_equal_rows_between_copies_are_found(spark):
    """A record of many equal rows, among records of the same text of which there are too many to be looked at one by one."""
    rows = sharding.sharded(frame(spark, [(None, COPIED)] * 9000 + [(i, COPIED) for i in range(6000)] + OWN)).collect()
    assert len(rows) == 21_000
    ended_nearest(rows, spread=len(COPIED))


def test_reruns_agree_and_the_tables_hold_the_law(spark):
    documents = spark.read.parquet(str(TESTDATA / "sf0.001/documents.parquet"))
    first = sorted(map(tuple, sharding.sharded(documents).select("doc_id", "shard", "slot").collect()))
    again = sorted(map(tuple, sharding.sharded(documents.repartition(5)).select("doc_id", "shard", "slot").collect()))
    assert first == again
    held(sharding.sharded(documents).collect())


def test_fewer_records_than_shards(spark):
    rows = sharding.sharded(frame(spark, [(1, "a"), (2, "b")])).collect()
    assert len({(r.shard, r.slot) for r in rows}) == 2 and sharding.sharded(frame(spark, [])).count() == 0


def test_tasks_go_with_the_rows_not_with_the_partitions(spark):
    """Where adaptive execution merges no partitions, the small jobs of the rounds do not start all of them each time."""
    settings = {"spark.sql.shuffle.partitions": "101", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    documents, old = frame(spark, EQUAL + OWN).repartition(101), {name: spark.conf.get(name) for name in settings}
    context = spark.sparkContext
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        context.setJobGroup("few_tasks", "")
        rows = sharding.sharded(documents).collect()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        for name, value in old.items():
            spark.conf.set(name, value)
    told = context.statusTracker()
    stages = {s for job in told.getJobIdsForGroup("few_tasks") for s in told.getJobInfo(job).stageIds}
    started = sum(info.numCompletedTasks for s in stages if (info := told.getStageInfo(s)))
    assert len(held(rows)) == 8 and 101 < started < 6 * 101
