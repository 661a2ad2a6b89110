"""Lines that several documents share, kept in one of them.

A line's key is the line without white space at its ends, A-Z in lower case. A key of at least ``least`` code points found in
at least ``documents_with`` documents loses all its lines but those in the smallest doc_id that holds it.

Defined cases: NULL and empty texts are one empty line; repeated keys within a document count once; rows that share a doc_id
are one document; a NULL doc_id counts as one document after all others; an empty table gives no rows. Lines are told apart by
96 bits of hash. Only DataFrame functions; the lines of a document stand together in one row only, as its text does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import SPACES, cut, lower_ascii, text_of

LEAST_LENGTH = 10
DOCUMENTS_WITH = 2
LAST_ID = 2**63 - 1


def _order(doc_id: Column) -> Column:
    return F.coalesce(doc_id, F.lit(LAST_ID))


def shared_lines(documents: DataFrame, least: int = LEAST_LENGTH, documents_with: int = DOCUMENTS_WITH) -> DataFrame:
    """Which lines go: ``doc_id``, ``text_hash``, ``positions`` (from 0) of each text that loses any."""
    lines = documents.select("doc_id", F.xxhash64(text_of()).alias("text_hash"), F.posexplode(F.split(text_of(), "\n")))
    keys = lines.select(
        "doc_id", "text_hash", F.col("pos").alias("position"), lower_ascii(F.btrim("col", F.lit(SPACES))).alias("key"))
    hashed = keys.filter(F.char_length("key") >= least).select(
        "doc_id", "text_hash", "position", F.xxhash64("key").alias("h1"), F.hash("key").alias("h2"))
    # Distinct documents by hash: of two, the smallest and the largest id tell; of more, they are counted.
    by_key = hashed.groupBy("h1", "h2")
    if documents_with <= 2:
        counted = by_key.agg(F.min(_order(F.col("doc_id"))).alias("first_id"), F.max(_order(F.col("doc_id"))).alias("last_id"))
        shared = counted.filter("first_id != last_id") if documents_with == 2 else counted
    else:
        once = hashed.groupBy("h1", "h2", _order(F.col("doc_id")).alias("id")).agg(F.count("*").alias("n"))
        shared = once.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("id").alias("first_id")).filter(
            F.col("n") >= documents_with)
    # Cut, so that the join stands between two plain shuffles, whose large keys Spark can split.
    gone = hashed.join(cut(shared.select("h1", "h2", "first_id")), ["h1", "h2"]).filter(_order(F.col("doc_id")) != F.col("first_id"))
    return gone.groupBy("doc_id", "text_hash").agg(F.collect_set("position").alias("positions"))


def without_shared_lines(documents: DataFrame, least: int = LEAST_LENGTH, documents_with: int = DOCUMENTS_WITH) -> DataFrame:
    """``row`` (the whole document), ``kept_text``, ``n_lines`` and ``n_dropped`` of every document."""
    gone = cut(shared_lines(documents, least, documents_with))
    gone = gone.select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash"), "positions")
    rows = documents.select(F.struct("*").alias("row"))
    joined = rows.join(
        gone, F.col("row.doc_id").eqNullSafe(F.col("gone_id")) & (F.xxhash64(text_of("row.text")) == F.col("gone_hash")), "left")
    lines = F.split(text_of("row.text"), "\n")
    split = joined.select("row", "positions", lines.alias("lines"))
    places = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("positions"))
    kept = F.array_join(F.transform(places, lambda i: F.get(F.col("lines"), i)), "\n")
    return split.select(
        "row", F.when(F.col("positions").isNull(), F.col("row.text")).otherwise(kept).alias("kept_text"),
        F.size("lines").cast("long").alias("n_lines"), F.coalesce(F.size("positions"), F.lit(0)).cast("long").alias("n_dropped"))


def digest(documents: DataFrame) -> DataFrame:
    done = without_shared_lines(documents.select("doc_id", "text"))
    return done.select("row.doc_id", "n_lines", "n_dropped", F.sha2(text_of("kept_text"), 256).alias("kept_sha256"))


def with_lines_dropped(documents: DataFrame) -> DataFrame:
    """The documents with the text that remains and its length; a text that loses nothing stays as it is, NULL included.

    ``n_chars``, if there, becomes the length of a shortened text.
    """
    done = without_shared_lines(documents)
    changed = F.col("n_dropped") > 0
    columns = []
    for name in documents.columns:
        own = F.col(f"row.`{name}`")
        if name == "text":
            own = F.col("kept_text")
        elif name == "n_chars":
            own = F.when(changed, F.char_length("kept_text").cast(documents.schema[name].dataType)).otherwise(own)
        columns.append(own.alias(name))
    return done.select(*columns)
