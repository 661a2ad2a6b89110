"""Quality classifier: a regularised quadratic discriminant over transformed document statistics.

Each class has the mean and covariance of the statistics of its labelled documents, summed up in Spark. Covariances are shrunk
towards their diagonal, standardised by the pooled deviations, and kept as the inverses of their Cholesky factors, made once. A score is the logistic of the
difference of the classes' log densities, of which the Mahalanobis part is a product with such a triangle.

Labels are learned from rows whose crc32 of the doc_id is not 2 mod 4. Statistics are of the text alone.

Defined cases: NULL texts are empty, and an empty text is scored like any other; NULL ids are not held out; NULL labels and ids
are not learned from; an id labelled twice counts twice; without two documents of each class every score is the share of good
ones, or a half; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import cut, pieces, sized, word_hashes

FOLDS, HELD_OUT = 4, 2
SHRINKAGE = 0.2
# Variance, in units of the pooled one, that every statistic has at least.
FLOOR = 0.05
LEAST_SCORE = 0.7
STATISTICS = (
    "log words", "log characters", "mean word length", "upper case", "digits", "symbols", "exclamations", "bars", "full stops",
    "commas", "white space", "distinct words", "words met before", "log lines", "log words a line",
)
D = len(STATISTICS)


def _classes() -> np.ndarray:
    """What kinds a byte counts for, as columns: upper, digit, symbol, exclamation, bar, stop, comma, space, start of a character."""
    table = np.zeros((256, 9), bool)
    for column, chars in enumerate(("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "#*$%&<>@^~_=+{}[]\\/", "!", "|", ".", ",", " \t\n\r")):
        table[[ord(c) for c in chars], column] = True
    table[:, 8] = (np.arange(256) & 0xC0) != 0x80
    return table


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    running = np.r_[0, np.cumsum(values, dtype=np.int64)]
    return (running[starts[1:]] - running[starts[:-1]]).astype(float)


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of transformed statistics for each text."""
    encoded = [(t or "").encode() for t in texts.to_pylist()]
    data = np.frombuffer(b"".join(encoded), np.uint8)
    starts = np.r_[0, np.cumsum([len(t) for t in encoded])].astype(np.int64)
    table = _classes()
    counts = [_sums(table[:, k][data], starts) for k in range(9)]
    # Capital letters beyond ASCII, of the Latin-1 block.
    wide = np.r_[False, (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)] if len(data) else np.zeros(0, bool)
    upper, digits, symbols, calls, bars, stops, commas, spaces, chars = counts
    upper = upper + _sums(wide, starts)
    lines = _sums(data == 10, starts) + 1
    words, word_starts = word_hashes(texts, lower=True)
    n = np.diff(word_starts).astype(float)
    distinct = np.array([len(np.unique(words[a:b])) for a, b in zip(word_starts[:-1], word_starts[1:], strict=True)], float)
    some, all_chars = np.maximum(n, 1), np.maximum(chars, 1)
    root = lambda x: np.sqrt(np.clip(x, 0, None))
    return np.stack([
        np.log1p(n), np.log1p(chars), np.log1p((chars - spaces) / some), root(upper / all_chars), root(digits / all_chars),
        root(symbols / all_chars), root(calls / all_chars), root(bars / some), root(stops / some), root(commas / some),
        root(spaces / all_chars), distinct / some, np.log1p(n - distinct) - np.log1p(n), np.log(lines), np.log1p(n / lines),
    ], axis=1)


def is_held_out():
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS)) == HELD_OUT, F.lit(False))


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a task's documents by label: the sums of 1, x and x x'."""
    total = {}
    for batch in pieces(batches):
        x = np.c_[np.ones(batch.num_rows), statistics(batch.column("text"))]
        label = np.asarray(batch.column("quality"))
        for q in (0, 1):
            own = x[label == q]
            total[q] = total.get(q, 0) + own.T @ own
    for q, sums in total.items():
        flat = sums.ravel()
        yield pa.RecordBatch.from_arrays([pa.array([q] * len(flat), pa.int32()), pa.array(np.arange(len(flat), dtype=np.int32)),
                                          pa.array(flat)], ["quality", "place", "value"])


def fit(documents: DataFrame, labels: DataFrame) -> list[dict]:
    """The classes 0 and 1: log prior, mean, inverse Cholesky factor and log determinant. A few hundred sums come to the driver."""
    known = labels.filter("doc_id is not null and quality in (0, 1)").filter(~is_held_out())
    known = cut(known.groupBy(F.col("doc_id").alias("known_id"), "quality").agg(F.count("*").alias("times")))
    texts = documents.select("doc_id", "text").join(sized(known), F.col("doc_id") == F.col("known_id"))
    rows = texts.select("text", F.col("quality").cast("int").alias("quality"), F.explode(F.array_repeat(F.lit(0), F.col("times").cast("int"))))
    sums = rows.select("text", "quality").mapInArrow(_moments, "quality int, place int, value double")
    cells = sums.groupBy("quality", "place").agg(F.sum("value").alias("value")).collect()
    total = np.zeros((2, (D + 1) ** 2))
    for cell in cells:
        total[cell.quality, cell.place] = cell.value
    return _classes_of(total.reshape(2, D + 1, D + 1))


def _classes_of(total: np.ndarray) -> list[dict]:
    n = total[:, 0, 0]
    if n.min() < 2:
        share = n[1] / n.sum() if n.sum() else 0.5
        prior = np.log(np.clip([1 - share, share], 1e-6, None))
        return [{"prior": float(p), "mean": np.zeros(D), "whiten": np.eye(D), "scale": np.ones(D), "logdet": 0.0} for p in prior]
    means = total[:, 0, 1:] / n[:, None]
    covariances = total[:, 1:, 1:] / n[:, None, None] - means[:, :, None] * means[:, None, :]
    pooled = (n[:, None] * np.einsum("cii->ci", covariances)).sum(axis=0) / n.sum()
    scale = np.sqrt(np.maximum(pooled, 1e-8))
    classes = []
    for q in (0, 1):
        own = covariances[q] / np.outer(scale, scale)
        diagonal = np.diag(np.maximum(np.diag(own), 0))
        own = (1 - SHRINKAGE) * own + SHRINKAGE * diagonal + FLOOR * np.eye(D)
        factor = np.linalg.cholesky(own)
        classes.append({"prior": float(np.log(n[q] / n.sum())), "mean": means[q], "whiten": np.linalg.inv(factor), "scale": scale,
                        "logdet": float(2 * np.log(np.diag(factor)).sum())})
    return classes


def density(x: np.ndarray, of: dict) -> np.ndarray:
    """The class's log density at each row, but for a constant, with its log prior."""
    white = ((x - of["mean"]) / of["scale"]) @ of["whiten"].T
    return of["prior"] - 0.5 * ((white**2).sum(axis=1) + of["logdet"])


def score(texts: pa.Array, classes: list[dict]) -> np.ndarray:
    x = statistics(texts)
    difference = density(x, classes[1]) - density(x, classes[0])
    return np.round(1 / (1 + np.exp(-np.clip(difference, -500, 500))), 9)


def scored(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each document: ``doc_id``, ``held_out``, ``score``, ``predicted``."""
    classes = fit(documents, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(score(batch.column("text"), classes))],
                                             ["doc_id", "score"])

    found = documents.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
    return found.select("doc_id", is_held_out().alias("held_out"), "score", (F.col("score") >= LEAST_SCORE).cast("int").alias("predicted"))
