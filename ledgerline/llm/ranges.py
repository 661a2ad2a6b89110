"""Rows in one order over the whole table, dealt to ranges that a task streams through one at a time.

The order is a binary key: numbers, the first ``PREFIX`` bytes of a text, and a hash of all that tells rows apart. Ranges begin at
keys of the table, found by a sample of about ``SAMPLED`` keys a range, as a sort of Spark finds them. Their number goes with the
bytes of the table, so that the bytes of a range do not grow with it. A key that holds several ranges' rows, which are then alike,
is divided among them by a salt; the last of these ranges also holds the keys that follow. It has one of the key's rows at least,
but for a chance of less than one in 2^60.

Defined cases: an empty table gives no rows; NULL numbers stand where the key says; NULL texts are empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import sized

PREFIX = 32
SAMPLED = 20
# What a row counts besides its text; ranges that small tables have, if each gets LEAST_ROWS.
ROW_BYTES, LEAST_RANGES, LEAST_ROWS = 64, 64, 200
SEED = 5


def _eight_bytes(number: Column) -> Column:
    return F.unhex(F.lpad(F.hex(number), 16, "0"))


def number_key(column: str, nulls_last: bool) -> Column:
    """Nine bytes in the order of a long."""
    number = F.col(column).cast("long")
    there, missing = (b"\x00", b"\x01") if nulls_last else (b"\x01", b"\x00")
    biased = _eight_bytes(number.bitwiseXOR(F.lit(-(1 << 63))))
    return F.when(number.isNull(), F.lit(bytearray(missing + bytes(8)))).otherwise(F.concat(F.lit(bytearray(there)), biased))


def text_key(text: Column, *more: Column) -> Column:
    """The first bytes of a text, then a hash of it and of what else tells rows apart."""
    begun = F.substring(text.cast("binary"), 1, PREFIX)
    return F.concat(F.unhex(F.rpad(F.hex(begun), 2 * PREFIX, "0")), _eight_bytes(F.xxhash64(text, *more)))


@dataclass
class Ranges:
    """Keys at which ranges begin, in order, and how many ranges each has."""

    edges: np.ndarray
    counts: np.ndarray

    @property
    def total(self) -> int:
        return int(self.counts.sum())

    @property
    def starts(self) -> np.ndarray:
        return np.cumsum(self.counts) - self.counts


def ranges_of(df: DataFrame, text: str, range_bytes: int) -> Ranges:
    """The ranges of a table with its order as ``key``. Some keys for each range come to the driver."""
    stats = df.agg(F.count("*").alias("rows"), F.sum(F.octet_length(text) + ROW_BYTES).alias("bytes"), F.min("key").alias("low")).first()
    if not stats.rows:
        return Ranges(np.zeros(1, "S1"), np.ones(1, np.int64))
    n = max(1, min(stats.rows // LEAST_ROWS, max(LEAST_RANGES, stats.bytes // range_bytes)))
    cuts = []
    if n > 1:
        sample = df.select("key").sample(min(1.0, SAMPLED * n / stats.rows), SEED).toArrow().column("key").to_pylist()
        sample.sort()
        cuts = [sample[i] for i in sorted({k * len(sample) // n for k in range(1, n)})] if sample else []
    edges, counts = np.unique(np.array([bytes(stats.low), *cuts], f"S{len(stats.low)}"), return_counts=True)
    return Ranges(edges, counts)


def in_ranges(df: DataFrame, text: str, range_bytes: int, followed: bool = False) -> DataFrame:
    """The rows of a table that has its order as ``key``, with ``range`` and ``ahead`` = 0: a partition for each range, in order.

    Where ``followed``, each range also has, with ``ahead`` = 1, the row after its last one; after the last of all, the first.
    """
    found = ranges_of(df, text, range_bytes)
    edges, counts, starts = found.edges, found.counts, found.starts

    @F.pandas_udf("int")
    def range_of(keys: pd.Series, salts: pd.Series) -> pd.Series:
        held = np.array(keys.tolist(), edges.dtype)
        at = np.maximum(np.searchsorted(edges, held, side="right") - 1, 0)
        inner = np.where(edges[at] == held, salts.to_numpy() % counts[at], counts[at] - 1)
        return pd.Series((starts[at] + inner).astype(np.int32))

    salt = F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 1)
    dealt = df.withColumn("range", range_of("key", salt)).withColumn("ahead", F.lit(0))
    if followed:
        dealt = dealt.unionByName(_ahead(df, found))
    return dealt.repartitionById(found.total, "range").sortWithinPartitions("ahead", "key")


def _ahead(df: DataFrame, found: Ranges) -> DataFrame:
    """One row of each key that begins a range, for the range before, and for all of the key's own ranges but the last."""
    width = found.edges.dtype.itemsize
    marks = [
        (bytearray(bytes(edge).ljust(width, b"\x00")), [(int(start) - 1) % found.total, *range(int(start), int(start + count) - 1)])
        for edge, count, start in zip(found.edges, found.counts, found.starts, strict=True)]
    begins = sized(df.sparkSession.createDataFrame(marks, "edge binary, ranges array<int>"))
    hits = df.join(begins, F.col("key") == F.col("edge")).drop("edge")

    def first_of_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = set()
        for batch in batches:
            own = []
            for i, key in enumerate(batch.column("key").to_pylist()):
                if key not in met:
                    met.add(key)
                    own.append(i)
            if own:
                yield batch.take(pa.array(own))

    few = hits.mapInArrow(first_of_each, hits.schema)
    rest = [c for c in few.columns if c != "key"]
    one = few.groupBy("key").agg(F.first(F.struct(*rest)).alias("row")).select("key", "row.*")
    return one.withColumn("range", F.explode("ranges")).drop("ranges").withColumn("ahead", F.lit(1))
