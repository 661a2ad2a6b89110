"""Document fingerprints: MinHash with a universal hash function for each coordinate.

A coordinate is the smallest value of (a x + b) over the text's shingles x, mod 2^64, of which 16 bits are kept after mixing: the
top bits of a minimum shrink towards 0 as texts grow, and would agree between unrelated long texts. The share of equal
coordinates estimates the Jaccard similarity. Bands of the signature, joined in Spark, propose similar
documents, which are verified on their full shingle sets.

Defined cases: words in any case are told apart by fingerprints, but not by ``similar``; NULL texts are empty; an empty text
has no shingles and a fingerprint of its own; a text of fewer words than a shingle is one shingle; equal texts have equal
fingerprints; an empty table gives no rows. In the order of documents, rows that share a doc_id go by the first bytes of their
text, then by its hash, and NULL ids come last; the last is followed by the first. Ids that hold many rows, and equal rows, are
divided among ranges (``ranges``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import mix64, odd_constants, pieces, shingle_hashes, text_of, word_hashes
from ledgerline.llm.minhash import labelled, sketched
from ledgerline.llm.ranges import in_ranges, number_key, text_key

COORDINATES = 128
BANDS, ROWS = 32, 4
PERCENT = 80
# Bytes of a range of documents, which one task streams through.
RANGE_BYTES = 32 << 20
STREAMED_BYTES = 1 << 18


def minima(shingles: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A row of 16-bit coordinates for each of the consecutive runs of shingles, none of them empty."""
    factors, terms = odd_constants(COORDINATES, seed=81), odd_constants(COORDINATES, seed=82)
    out, hashed = np.empty((len(starts), COORDINATES), np.uint16), np.empty_like(shingles)
    with np.errstate(over="ignore"):
        for k in range(COORDINATES):
            np.multiply(shingles, factors[k], out=hashed)
            np.add(hashed, terms[k], out=hashed)
            out[:, k] = (mix64(np.minimum.reduceat(hashed, starts)) & np.uint64(0xFFFF)).astype(np.uint16)
    return out


def signatures(texts: pa.Array) -> np.ndarray:
    """A row of 16-bit coordinates for each text; all ones for a text without words."""
    with np.errstate(over="ignore"):
        shingles, ends = shingle_hashes(*word_hashes(texts, lower=False))
    out = np.full((len(texts), COORDINATES), 0xFFFF, np.uint16)
    full = np.flatnonzero(np.diff(ends))
    if len(full):
        out[full] = minima(shingles, ends[:-1][full])
    return out


def fingerprint(signature: np.ndarray) -> str:
    return signature.astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def edited(text: str, following: str) -> str:
    """The text with its last quarter of code points replaced by the first as many of the following text."""
    quarter = len(text) // 4
    return text[: len(text) - quarter] + following[:quarter]


def in_order(documents: DataFrame) -> DataFrame:
    """``range``, ``ahead``, ``doc_id``, ``text``: documents by ranges, each with the document that follows its last one."""
    keyed = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).withColumn(
        "key", F.concat(number_key("doc_id", nulls_last=True), text_key(F.col("text"))))
    return in_ranges(keyed, "text", RANGE_BYTES, followed=True).select("range", "ahead", "doc_id", "text")


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in order, each with the one that follows in its range."""
    held: tuple | None = None  # the row before, and its signature
    for batch in pieces(batches, limit=STREAMED_BYTES):
        own = signatures(batch.column("text"))
        rows = list(zip(*(batch.column(name).to_pylist() for name in ("range", "ahead", "doc_id", "text")), own, strict=True))
        if held:
            rows.insert(0, held)
        held = rows.pop()
        yield _finished(rows, [*rows[1:], held])
    if held:
        yield _finished([held], [None])


def _finished(rows: list[tuple], following: list[tuple | None]) -> pa.RecordBatch:
    pairs = [(row, after if after and after[0] == row[0] else None)
             for row, after in zip(rows, following, strict=True) if not row[1]]
    changed = [edited(row[3], after[3] if after else "") for row, after in pairs]
    marks = signatures(pa.array(changed, pa.string())) if changed else []
    columns = zip(*(
        (row[2], len(row[3]), hashlib.sha256(text.encode()).hexdigest(), fingerprint(row[4]), fingerprint(mark),
         likeness(row[4], mark), likeness(row[4], after[4]) if after else 0.0)
        for (row, after), text, mark in zip(pairs, changed, marks, strict=True)), strict=True)
    types = [pa.int64(), pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2]
    data = list(columns) or [()] * len(types)
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(data, types, strict=True)], names)


def compared(documents: DataFrame) -> DataFrame:
    """A row for each document: its fingerprint, that of its edited text, and their likeness to it and the next document's."""
    return in_order(documents).mapInArrow(
        _compared, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
                   "near_edited double, near_next double")


def fingerprints(documents: DataFrame) -> DataFrame:
    """``doc_id`` and ``fingerprint`` of every document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, limit=STREAMED_BYTES):
            marks = [fingerprint(s) for s in signatures(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(marks, pa.string())],
                                             ["doc_id", "fingerprint"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, fingerprint string")


def similar(documents: DataFrame, percent: int = PERCENT) -> DataFrame:
    """A row for each document: ``doc_id``, ``component_id``, the smallest doc_id reachable by links; its own if it has none.

    Words count in lower case (A-Z) in the signatures whose bands propose links, as in the verification on full shingle sets.
    Documents of equal shingle sets are one. A NULL doc_id has a NULL component.
    """
    sketch = sketched(documents, minima, BANDS, ROWS)
    return labelled(documents, sketch, percent, COORDINATES).select("doc_id", "component_id")
