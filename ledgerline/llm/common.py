"""What several operators share: words, cut lineage, joins whose small side is broadcast only if it was counted."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The white space between words, and between a line's ends and its text.
SPACES = " \t\n\x0b\x0c\r"
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

BROADCAST_ROWS = 1_000_000
SHINGLE = 5


def ship(spark: SparkSession) -> None:
    """Gives the executors this package, once for each application: its functions run there."""
    context = spark.sparkContext
    if getattr(context, "_llm_shipped", False):
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp()) / "ledgerline.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in package.parent.rglob("*.py"):
            out.write(file, file.relative_to(package.parent.parent))
    context.addPyFile(str(archive))
    context._llm_shipped = True


def shipped(spark: SparkSession, path: str) -> str:
    """Gives the executors a file of the driver's, once for each application, and tells its name there."""
    context = spark.sparkContext
    files = context.__dict__.setdefault("_llm_files", {})
    name = Path(path).name
    if name not in files:
        context.addFile(path)
        files[name] = path
    elif files[name] != path:
        raise ValueError(f"another file of the name {name} was shipped before: {files[name]}")
    return name


def shipped_path(name: str) -> str:
    """Where a task finds a file that ``shipped`` sent."""
    return SparkFiles.get(name)


def text_of(column: str = "text") -> Column:
    """The text, empty where it is NULL."""
    return F.coalesce(F.col(column), F.lit(""))


def words(text: Column) -> Column:
    """The words of a text as an array, empty if there are none."""
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(F.length(trimmed) == 0, F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE))


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case and every other character as it is."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it; a temporary one only where all is one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    context = spark.sparkContext
    if not hasattr(context, "_llm_folder"):
        context._llm_folder = tempfile.mkdtemp()
    return context._llm_folder


def cut(df: DataFrame) -> DataFrame:
    """The rows, written to the folder that all executors share: later plans start from there, and survive lost executors."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


class Scratch:
    """Tables written to the shared folder, each in place of the one before it, which is then deleted."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder, self.count = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4()}", 0

    def replaced(self, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{self.count}"
        df.write.parquet(path)
        if self.count:
            self._delete(f"{self.folder}/{self.count - 1}")
        self.count += 1
        return self.spark.read.schema(df.schema).parquet(path)

    def _delete(self, path: str) -> None:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)


def sized(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """The small side of a join, of a few short columns: broadcast if it has at most ``limit`` rows, else left to Spark.

    Counts the rows, so ``df`` had better be cut before.
    """
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def distinct_rows(df: DataFrame) -> DataFrame:
    return df.groupBy(*df.columns).agg(F.count("*").alias("__n")).drop("__n")


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``limit`` bytes of text each, one row at least: bounds what a task holds."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
        slot = (np.cumsum(sizes) - sizes) // limit
        starts = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]])
        for start, end in zip(starts, np.r_[starts[1:], batch.num_rows], strict=True):
            yield batch.slice(start, end - start)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit. Its constants are those of a well-known finaliser."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def odd_constants(count: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def word_hashes(texts: pa.Array, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts, in order, and where each text's words begin (one more entry: the end)."""
    texts = pc.fill_null(texts, "")
    texts = pc.utf8_trim(pc.ascii_lower(texts) if lower else texts, characters=SPACES)
    empty = np.asarray(pc.equal(pc.binary_length(texts), 0))
    lists = pc.split_pattern_regex(texts, pattern="[ \t-\r]+")
    counts = np.asarray(pc.list_value_length(lists), dtype=np.int64)
    encoded = pc.dictionary_encode(lists.flatten())
    known = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in encoded.dictionary.cast(pa.binary()).to_pylist()),
                        dtype=np.uint64, count=len(encoded.dictionary))
    hashes = known[np.asarray(encoded.indices)] if len(known) else np.zeros(0, np.uint64)
    if empty.any():
        hashes = hashes[np.repeat(~empty, counts)]
        counts = np.where(empty, 0, counts)
    return hashes, np.r_[0, np.cumsum(counts)]


def shingle_hashes(words: np.ndarray, starts: np.ndarray, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of every run of n words, repeats included; of a shorter text its whole sequence; none of an empty one."""
    factors = odd_constants(n, seed=n)
    counts = np.diff(starts)
    total = len(words)
    with np.errstate(over="ignore"):
        rolled = np.zeros(max(total - n + 1, 0), np.uint64)
        for j in range(n):
            rolled += words[j : total - n + 1 + j] * factors[j] if len(rolled) else np.zeros(0, np.uint64)
        rolled = mix64(rolled)
        made = np.where(counts >= n, counts - n + 1, (counts > 0).astype(np.int64))
        ends = np.r_[0, np.cumsum(made)]
        out = np.empty(ends[-1], np.uint64)
        long = np.flatnonzero(counts >= n)
        if len(long):
            offsets = np.repeat(starts[long] - np.r_[0, np.cumsum(made[long])][:-1], made[long])
            target = np.repeat(ends[long] - np.r_[0, np.cumsum(made[long])][:-1], made[long])
            run = np.arange(made[long].sum())
            out[run + target] = rolled[run + offsets]
        for i in np.flatnonzero((counts > 0) & (counts < n)):
            short = words[starts[i] : starts[i + 1]]
            out[ends[i]] = mix64((short * factors[: len(short)]).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(short)))[0]
    return out, ends
