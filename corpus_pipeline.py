"""From documents to tokens: rules, line dedup, near-duplicate removal, the mix of sources, and byte-pair encoding.

Each stage takes all rows that the one before returned, and every stage but the last returns the columns of the documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerline.llm import bpe, line_dedup, minhash, mixing, quality_rules
from ledgerline.llm.common import Scratch, ship
from ledgerline.llm.queries import table, tokenizer_path

# The Jaccard similarity, in percent, from which documents are near duplicates here; that of op4 is its own.
NEAR_PERCENT = 80


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    ship(spark)
    return quality_rules.good_documents(docs, table(spark, sf_dir, "labels"))


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that several documents share stay in the first only."""
    ship(spark)
    return line_dedup.with_lines_dropped(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    ship(spark)
    return minhash.without_near_duplicates(docs, percent=NEAR_PERCENT)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    ship(spark)
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of each document: their number, and digests of the ids and of the text decoded from them."""
    ship(spark)
    return bpe.digest(docs, tokenizer_path())


STAGES = [
    ("quality rules", keep_good),
    ("line dedup", drop_shared_lines),
    ("MinHash near-dedup", drop_near_duplicates),
    ("mix sources", mix),
    ("BPE", encode),
]

# A hashed log-likelihood ratio and byte-pair encoding are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written where all executors can read it, and read again by the next.

    Once a stage is written, what it read is deleted; the last stage's input stays, as its rows are made when they are asked for.
    """
    written = Scratch(spark, "corpus")
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written.replaced(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
