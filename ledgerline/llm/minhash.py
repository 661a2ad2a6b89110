"""Near-duplicate documents by circulant MinHash.

Two permutations of 32-bit numbers make the whole signature: the first scatters the shingles, the second is applied to
their places shifted by 0, 1, 2, ..., once for each coordinate, and the smallest value counts. Bands of the signature
propose pairs; every link is confirmed on the full shingle sets.

Defined cases: text is taken in lower case (A-Z only); NULL and empty texts have no shingles and no links; a text of fewer
words than a shingle is one shingle; equal shingle sets are one node, whatever their number; rows that share a doc_id are
one document; a NULL doc_id has a NULL component, and is kept; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import cut, distinct_rows, mix64, odd_constants, pieces, shingle_hashes, sized, word_hashes
from ledgerline.llm.links import components, link_components

BANDS, ROWS = 32, 6
# At 0.85 a link escapes all 32 bands of 6 with a probability of 3e-7; at 0.3, 2 pairs in 100 are looked at in vain.
PERCENT = 85

SKETCH = "doc_id long, n_shingles long, set_key binary, bands array<long>, sig binary"


def circulant_signatures(shingles: np.ndarray, starts: np.ndarray, coordinates: int = BANDS * ROWS) -> np.ndarray:
    """The signatures of consecutive runs of shingles, none of them empty: a row each, of ``coordinates`` 32-bit numbers."""
    place = (mix64(shingles ^ np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)
    first, second = (np.uint32(c >> np.uint64(32) | np.uint64(1)) for c in odd_constants(2, seed=32))
    out = np.empty((len(starts), coordinates), np.uint32)
    moved, high = np.empty_like(place), np.empty_like(place)
    for k in range(coordinates):
        np.subtract(place, np.uint32(k), out=moved)
        np.multiply(moved, first, out=moved)
        np.right_shift(moved, 15, out=high)
        np.bitwise_xor(moved, high, out=moved)
        np.multiply(moved, second, out=moved)
        out[:, k] = np.minimum.reduceat(moved, starts)
    return out


def sketched(
    documents: DataFrame, signatures_of: Callable[[np.ndarray, np.ndarray], np.ndarray], bands_of: int, rows_of: int,
) -> DataFrame:
    """A sketch of each document, of signatures that ``signatures_of`` makes of runs of shingles, in bands."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salts = odd_constants(bands_of * rows_of, seed=3).reshape(bands_of, rows_of)
        for batch in pieces(batches, limit=1 << 18):
            with np.errstate(over="ignore"):
                words, word_starts = word_hashes(batch.column("text"), lower=True)
                shingles, starts = shingle_hashes(words, word_starts)
                sets = [np.unique(shingles[a:b]) for a, b in zip(starts[:-1], starts[1:], strict=True)]
                sizes = np.array([len(s) for s in sets], np.int64)
                full = np.flatnonzero(sizes)
                bands = np.zeros((len(sets), bands_of), np.uint64)
                sig = np.zeros((len(sets), bands_of * rows_of), np.uint8)
                keys: list[bytes | None] = [None] * len(sets)
                if len(full):
                    flat = np.concatenate([sets[i] for i in full])
                    begins = np.r_[0, np.cumsum(sizes[full])][:-1]
                    values = signatures_of(flat, begins)
                    banded = (values.reshape(-1, bands_of, rows_of).astype(np.uint64) * salts).sum(axis=2, dtype=np.uint64)
                    bands[full] = mix64(banded + np.arange(1, bands_of + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                    # Of the mixed minimum: the top bits of a minimum shrink towards 0 as sets grow.
                    sig[full] = (mix64(values.astype(np.uint64)) & np.uint64(0xFF)).astype(np.uint8)
                    sums = np.stack([np.add.reduceat(mix64(flat ^ salt), begins) for salt in salts[0, :2]], axis=1)
                    for i, pair in zip(full, sums, strict=True):
                        keys[i] = pair.tobytes()
            lists = pa.ListArray.from_arrays(
                np.arange(len(sets) + 1, dtype=np.int32) * bands_of, pa.array(bands.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id").cast(pa.int64()), pa.array(sizes), pa.array(keys, pa.binary()), lists,
                pa.array([s.tobytes() for s in sig], pa.binary()),
            ], ["doc_id", "n_shingles", "set_key", "bands", "sig"])

    return documents.select("doc_id", "text").mapInArrow(run, SKETCH)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        with np.errstate(over="ignore"):
            shingles, starts = shingle_hashes(*word_hashes(batch.column("text"), lower=True))
        sets = [np.unique(shingles[a:b]) for a, b in zip(starts[:-1], starts[1:], strict=True)]
        offsets = np.r_[0, np.cumsum([len(s) for s in sets])].astype(np.int32)
        flat = np.concatenate(sets).view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").cast(pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(flat))], ["doc_id", "members"])


def shingle_sets(documents: DataFrame) -> DataFrame:
    """``doc_id`` and ``members``, the distinct shingles of the whole text as 64-bit hashes."""
    return documents.select("doc_id", "text").mapInArrow(_sets, "doc_id long, members array<long>")


def sets_in(documents: DataFrame):
    """The shingle sets of the documents whose ids are asked for."""
    return lambda ids: shingle_sets(documents.select("doc_id", "text").join(sized(ids), "doc_id", "left_semi"))


def near_duplicates(documents: DataFrame, percent: int = PERCENT) -> DataFrame:
    """A row for each document: ``doc_id``, ``n_shingles``, ``component_id`` (smallest doc_id reachable by links), ``kept``."""
    result = labelled(documents, sketched(documents, circulant_signatures, BANDS, ROWS), percent, BANDS * ROWS)
    return result.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def labelled(documents: DataFrame, sketch: DataFrame, percent: int, coordinates: int) -> DataFrame:
    """A row for each document of the sketch: ``doc_id``, ``n_shingles``, ``component_id``."""
    sketch = cut(sketch)
    linkable = sketch.filter("set_key is not null and doc_id is not null")
    nodes = linkable.groupBy("set_key").agg(F.min("doc_id").alias("node"))
    nodes = cut(nodes)
    by_id = linkable.select("doc_id", "set_key").join(nodes, "set_key")
    firsts = cut(
        linkable.join(nodes, "set_key").filter("doc_id = node")
        .groupBy("set_key", "node").agg(F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    )
    found = link_components(firsts, sets_in(documents), percent, coordinates)
    # Copies of a set follow its node; an id with several sets joins them.
    several = distinct_rows(by_id.select("doc_id", "node")).groupBy("doc_id").agg(
        F.min("node").alias("node"), F.max("node").alias("high")).filter("node != high").select("doc_id")
    several = cut(several)
    if not several.isEmpty():
        own = by_id.join(several, "doc_id", "left_semi")
        known = found.select(F.col("node").alias("a"), F.col("component").alias("b"))
        found = components(known.unionByName(distinct_rows(own.select(F.col("node").alias("a"), F.col("doc_id").alias("b")))))
    of_sets = nodes.join(found, "node", "left").select("set_key", F.coalesce("component", "node").alias("component_id"))
    result = sketch.select("doc_id", "n_shingles", "set_key").join(of_sets, "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return result.select("doc_id", "n_shingles", component.alias("component_id"))


def without_near_duplicates(documents: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The documents, whole rows, of which one of each group of near duplicates stays: that with the smallest doc_id.

    Of several rows with that doc_id one stays. Rows without a doc_id stay.
    """
    found = cut(near_duplicates(documents, percent))
    gone = cut(distinct_rows(found.filter("not kept").select(F.col("doc_id").alias("gone_id"))))
    repeated = cut(found.filter("doc_id is not null and kept").groupBy(F.col("doc_id").alias("repeated_id"))
                   .agg(F.count("*").alias("n")).filter("n > 1").select("repeated_id"))
    whole = documents.select(F.struct("*").alias("row"))
    whole = whole.join(sized(gone), F.col("row.doc_id") == F.col("gone_id"), "left_anti")
    if repeated.isEmpty():
        return whole.select("row.*")
    small, hit = sized(repeated), F.col("row.doc_id") == F.col("repeated_id")
    once = whole.join(small, hit, "left_semi").groupBy("row.doc_id").agg(
        F.min_by("row", F.struct(F.xxhash64("row.text"), F.col("row.text"))).alias("row"))
    return whole.join(small, hit, "left_anti").unionByName(once.select("row")).select("row.*")
