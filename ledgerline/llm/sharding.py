"""Sharding by sampled splitters: near-equal bytes in every shard.

Records are ordered by a key, the hash of the text and then that of the doc_id, so copies of a text lie together. Records of one
key are equal rows; they are first summed to one item with their number and bytes. Splitters are quantiles of a sample of items in
which an item's chance grows with its bytes. Items are put into the ranges between splitters, whose exact bytes are then summed.
A range that holds the end of a shard is overfull: it is sampled and split again, between texts, or between records where it is
of one text, until a splitter comes within ``TOLERANCE`` of the end, or at most ``FEW`` items are left around it. These are looked
at one by one; an end within an item divides its equal rows by number. So every end is within ``TOLERANCE`` of a shard, or half a
record. A text or record that takes several of the quantiles is split off on both sides: a range with what follows it would
hardly shrink.

Records and items are a few numbers each. Once written they are read in tasks of about ``ROWS_IN_TASK``, however many files or
shuffle partitions there are: the rounds are many small jobs, whose time is that of starting tasks. So is that of a round's sample,
which goes to one task.

Equal rows are numbered, and slots given, by cells: rows are counted by cell, and numbered within one. A cell is chosen by the
hash of the record, and for a key of more than ``HEAVY`` rows by a number of the row instead, which spreads them over all cells.

Defined cases: NULL and empty texts have size 1 and checksum 0; a NULL doc_id is a key like others; equal rows, of which any may
take another's place, are divided where an end falls among them, and have slots of their own; empty shards are possible where
there are fewer records than shards; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerline.llm.common import cut, sized, text_of

SHARDS = 8
TOLERANCE = 0.002
# Bounds of what the driver holds: expected samples of a round, splitters of a shard's end, items around an end.
SAMPLES = 4096
SPLITS = 16
FEW = 1024
# Each round leaves at most about three sixteenths of a range, or one text or record: this many are never needed, and more are
# an error.
MOST_ROUNDS = 64
ROWS_IN_CELL = 100_000
ROWS_IN_TASK = 100_000
LEAST_CELLS = 64
HEAVY = 1000

Key = tuple[int, int]
LOWEST, HIGHEST = -(2**63), (2**63 - 1, 2**63 - 1)


def keyed(documents: DataFrame) -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, the key, ``k1`` of the text and ``k2`` of the record, and ``row``, a number to
    tell equal rows apart, which holds once the rows are written."""
    return documents.select(
        "doc_id", (F.octet_length(text_of()).cast("long") + 1).alias("size"),
        F.crc32(text_of().cast("binary")).alias("text_crc32"), F.xxhash64(text_of()).alias("k1"),
        F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), text_of()).alias("k2"),
        F.xxhash64(F.monotonically_increasing_id()).alias("row"))


def items_of(records: DataFrame) -> DataFrame:
    """``k1``, ``k2``, ``size`` (bytes of all rows of the key), ``rows``."""
    return records.groupBy("k1", "k2").agg(F.sum("size").alias("size"), F.count("*").alias("rows"))


def _reaches(cut_at: Key) -> Column:
    first, second = (F.lit(part).cast("long") for part in cut_at)
    return (F.col("k1") > first) | ((F.col("k1") == first) & (F.col("k2") >= second))


def range_of(cuts: list[Key], low: int = 0) -> Column:
    """The number of cuts that a record reaches, by halving."""
    if not cuts:
        return F.lit(low)
    middle = len(cuts) // 2
    return F.when(_reaches(cuts[middle]), range_of(cuts[middle + 1 :], low + middle + 1)).otherwise(range_of(cuts[:middle], low))


def _after(key: Key, by_record: bool) -> Key:
    """The least key after a record, or after all of its text."""
    first, second = key
    if by_record and second < HIGHEST[1]:
        return first, second + 1
    return (first + 1, LOWEST) if first < HIGHEST[0] else HIGHEST


def _splitters(items: DataFrame, cuts: list[Key], wanted: dict[int, int], by_record: set[int], seed: int) -> set[Key]:
    """Quantiles of a sample of each wanted range (number: bytes): between texts, or between records where in ``by_record``.
    Where several quantiles are of one text or record, also where it ends."""
    each = SAMPLES // len(wanted)
    rate = F
    for number, total in wanted.items():
        rate = rate.when(F.col("place") == number, F.lit(each / total))
    chance = F.shiftrightunsigned(F.xxhash64("k2", F.lit(seed)), 11).cast("double") / float(2**53)
    drawn = (
        items.withColumn("place", range_of(cuts)).filter(F.col("place").isin(list(wanted))).withColumn("rate", rate)
        .filter(chance < F.col("size") * F.col("rate"))
        .select("place", "k1", "k2", F.greatest(F.col("size").cast("double"), 1 / F.col("rate")).alias("weight"))
    )
    drawn = drawn.repartition(1)  # SAMPLES at most, as expected
    order = W.partitionBy("place").orderBy("k1", "k2")
    share = F.sum("weight").over(order) / F.sum("weight").over(W.partitionBy("place"))
    ranked = drawn.withColumn("step", F.floor(share * SPLITS))
    ranked = ranked.withColumn("before", F.lag("step", 1, 0).over(order))
    found = ranked.filter("step > before").select("place", "k1", "k2", (F.col("step") - F.col("before")).alias("steps")).collect()
    steps: Counter[tuple[Key, bool]] = Counter()
    for row in found:
        in_text = row.place in by_record
        steps[(row.k1, row.k2 if in_text else LOWEST), in_text] += row.steps
    return {key for key, _ in steps} | {_after(*at) for at, taken in steps.items() if taken > 1}


Span = tuple[tuple[Key, int], tuple[Key, int]]
End = tuple[int, int, int]


def _of_one_text(span: Span) -> bool:
    (low, _), (high, _) = span
    return high <= (low[0] + 1, LOWEST)


def _end_among(items: list, before: int, goal: float) -> End:
    """The end nearest to ``goal``, in bytes, among sorted items that begin at ``before``: a key, and how many of its rows are
    left of the end."""
    for item in items:
        if before + item.size > goal or item is items[-1]:
            one = item.size // item.rows
            return item.k1, item.k2, min(max(round((goal - before) / one), 0), item.rows)
        before += item.size
    raise ValueError("no items around the end")


def shard_ends(items: DataFrame, shards: int = SHARDS) -> list[End]:
    """Where shards 1, 2, ... begin: a key, and how many rows of it are still left of it. What comes to the driver is bounded by
    the shards, not the records."""
    whole = items.agg(F.sum("size").alias("size"), F.count("*").alias("items")).first()
    if not whole.items:
        return []
    goals = [shard * whole.size / shards for shard in range(1, shards)]
    allowed = TOLERANCE * whole.size / shards
    # Of each end: the cuts around it with the bytes before each, and how many items are between them.
    around: list[Span] = [(((LOWEST, LOWEST), 0), (HIGHEST, whole.size))] * len(goals)
    between = dict.fromkeys(around, whole.items)
    ends: dict[int, End] = {}
    for seed in range(MOST_ROUNDS):
        spans = sorted({around[i] for i in range(len(goals)) if i not in ends and between[around[i]] > FEW})
        if not spans:
            break
        cuts = sorted({cut_at for span in spans for cut_at, _ in span})
        number_of = {span: cuts.index(span[0][0]) + 1 for span in spans}
        new = _splitters(items, cuts, {number_of[s]: s[1][1] - s[0][1] for s in spans},
                         {number_of[s] for s in spans if _of_one_text(s)}, seed)
        cuts = sorted(set(cuts) | new)
        sums = {row.place: row for row in items.groupBy(range_of(cuts).alias("place")).agg(
            F.sum("size").alias("size"), F.count("*").alias("items")).collect()}
        before, items_before = {}, {}
        size = count = 0
        for number, cut_at in enumerate(cuts):
            if number in sums:
                size, count = size + sums[number].size, count + sums[number].items
            before[cut_at], items_before[cut_at] = size, count
        for i, goal in enumerate(goals):
            if around[i] not in spans or i in ends:
                continue
            old = around[i]
            inside = [(cut_at, before[cut_at]) for cut_at in cuts if old[0][0] <= cut_at <= old[1][0]]
            low = max(x for x in inside if x[1] <= goal)
            high = min((x for x in inside if x[0] > low[0]), default=inside[-1])
            around[i] = (low, high)
            between[around[i]] = items_before[high[0]] - items_before[low[0]]
            nearest = low if goal - low[1] <= high[1] - goal else high
            if abs(nearest[1] - goal) <= allowed:
                ends[i] = (*nearest[0], 0)
    else:
        raise RuntimeError(f"a shard's end was not found in {MOST_ROUNDS} rounds")
    few = {span for i, span in enumerate(around) if i not in ends}
    if few:
        cuts = sorted({cut_at for span in few for cut_at, _ in span})
        wanted = {cuts.index(span[0][0]) + 1: span for span in few}
        last = F.lit(HIGHEST[0])
        top = (F.col("k1") == last) & (F.col("k2") == last)  # the only key that reaches the highest cut
        place = F.when(top & F.lit(HIGHEST in cuts), len(cuts) - 1).otherwise(range_of(cuts))
        rows = items.withColumn("place", place).filter(F.col("place").isin(list(wanted))).collect()
        for i, goal in enumerate(goals):
            if i not in ends:
                number = cuts.index(around[i][0][0]) + 1
                found = sorted((r for r in rows if r.place == number), key=lambda r: (r.k1, r.k2))
                ends[i] = _end_among(found, around[i][0][1], goal)
    return [ends[i] for i in range(len(goals))]


def _numbered(rows: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """``rows`` with a number from 0 without gaps in ``name``, by ``by``: counted by their ``cell``, and numbered within it."""
    counts = rows.groupBy(*by, "cell").agg(F.count("*").alias("n"))
    offset = F.sum("n").over(W.partitionBy(*by).orderBy("cell")) - F.col("n")
    offsets = sized(cut(counts.select(*by, "cell", offset.alias("offset")).coalesce(1)))  # a row for each cell
    within = F.row_number().over(W.partitionBy(*by, "cell").orderBy(*order)) - 1
    return (
        rows.withColumn("within", within).join(offsets, [*by, "cell"])
        .withColumn(name, F.col("offset") + F.col("within")).drop("offset", "within")
    )


def placed(records: DataFrame, ends: list[End]) -> DataFrame:
    """``records``, which have a ``cell``, with their ``shard``."""
    cuts = [(k1, k2) for k1, k2, _ in ends]
    divided = sorted({(k1, k2) for k1, k2, left in ends if left})
    if not divided:
        return records.withColumn("shard", range_of(cuts))
    is_divided = F.lit(False)
    for k1, k2 in divided:
        is_divided = is_divided | ((F.col("k1") == F.lit(k1).cast("long")) & (F.col("k2") == F.lit(k2).cast("long")))
    others = records.filter(~is_divided).withColumn("shard", range_of(cuts))
    copies = _numbered(records.filter(is_divided), ["k1", "k2"], ["row"], "copy")
    shard = F.lit(0)
    for k1, k2, left in ends:
        same = (F.col("k1") == F.lit(k1).cast("long")) & (F.col("k2") == F.lit(k2).cast("long"))
        shard = shard + F.when(same, F.col("copy") >= left).otherwise(_reaches((k1, k2))).cast("int")
    return others.unionByName(copies.withColumn("shard", shard).drop("copy"))


def sharded(documents: DataFrame, shards: int = SHARDS) -> DataFrame:
    """A row for each document: ``doc_id``, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot``, ``grown_shard``."""
    records = cut(keyed(documents))
    rows = records.count()
    tasks = max(1, -(-rows // ROWS_IN_TASK))
    records = records.coalesce(tasks)
    items = cut(items_of(records)).coalesce(tasks)
    cells = max(LEAST_CELLS, rows // shards // ROWS_IN_CELL)
    heavy = sized(cut(items.filter(F.col("rows") > HEAVY).select("k1", "k2", F.lit(True).alias("heavy"))))
    spread = F.when(F.col("heavy"), F.col("row")).otherwise(F.xxhash64("k2", F.lit("cell")))
    celled = records.join(heavy, ["k1", "k2"], "left").withColumn("cell", F.pmod(spread, F.lit(cells))).drop("heavy")
    return _numbered(placed(celled, shard_ends(items, shards)), ["shard"], ["k1", "k2", "row"], "slot").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))
