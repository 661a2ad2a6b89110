"""How the sources of a language differ in their words, by run-length columns.

Terms are counted by language and source, and by the documents of the language that hold them; each language keeps the terms of
at least ``LEAST_DOCUMENTS``. A kept term's counts over the sources are its row of a table whose columns are the sources. Terms
with the same row are folded into one with a run length, which Spark counts. The rows are dealt to blocks of a bounded number of
cells; within a block they are reordered so that equal counts lie together, and every column is run-length encoded. For two
sources the boundaries of their runs are intersected, and the divergence of a pair of counts is multiplied by the length of the
run that they share. Blocks are added up. A block's pairs are dealt to tiles where there are too many for one task.

All arithmetic is on whole numbers. With ``p`` of a group and ``q`` of another, of a term, f = floor((p - q)^2 / q). The sum of
all ``p`` of a group is at most 10^9 + V, so the sum of f is below (10^9 + V)(10^9 + 1) and fits a long up to eight billion terms.

Defined cases: NULL text, lang and source are empty ones, and meet those that are empty; every row is a document, also where
rows are equal; a group without terms is there with counts of 0; a language that keeps no term has pairs of value 0; ties are
ranked by the item's UTF-8; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerline.llm.common import cut, pieces, sized

# Fixed value: what stands between terms.
BETWEEN_TERMS = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"

LEAST_DOCUMENTS = 3
SCALE = 1_000_000_000
TOP_TERMS = 200
# Bounds of a task's block: counts held at once, and sums of pairs given out.
CELLS = 1 << 17
PAIRS = 1 << 20
PIECE = 4 << 20
# Counts below this stay within a long when multiplied by SCALE.
SMALL_COUNT = 9 * 10**9

COUNTS = "lang string, source string, term string, n long, docs long"


def _count(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Counts of one batch's terms by group; a NULL term with counts of 0 tells that the group is there."""
    lang, source = (pc.fill_null(batch.column(name), "").dictionary_encode() for name in ("lang", "source"))
    wide = max(len(source.dictionary), 1)
    group = np.asarray(lang.indices, dtype=np.int64) * wide + np.asarray(source.indices, dtype=np.int64)
    lists = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(batch.column("text"), "")), pattern=BETWEEN_TERMS)
    lengths = np.asarray(pc.list_value_length(lists), dtype=np.int64)
    encoded = lists.flatten().dictionary_encode()
    terms = max(len(encoded.dictionary), 1)
    real = np.asarray(pc.not_equal(encoded.dictionary, ""), dtype=bool)
    code = np.asarray(encoded.indices, dtype=np.int64)
    row = np.repeat(np.arange(batch.num_rows), lengths)
    kept = real[code] if len(code) else np.zeros(0, bool)
    in_row, times = np.unique(row[kept] * terms + code[kept], return_counts=True)
    keys, where = np.unique(group[in_row // terms] * terms + in_row % terms, return_inverse=True)
    n = np.bincount(where, weights=times, minlength=len(keys)).astype(np.int64)
    docs = np.bincount(where, minlength=len(keys)).astype(np.int64)
    there = np.unique(group)
    groups = np.r_[keys // terms, there]
    term = pa.concat_arrays([encoded.dictionary.take(pa.array(keys % terms)), pa.nulls(len(there), pa.string())])
    zeros = np.zeros(len(there), np.int64)
    return pa.RecordBatch.from_arrays(
        [lang.dictionary.take(pa.array(groups // wide)), source.dictionary.take(pa.array(groups % wide)), term,
         pa.array(np.r_[n, zeros]), pa.array(np.r_[docs, zeros])], ["lang", "source", "term", "n", "docs"])


def term_counts(documents: DataFrame) -> DataFrame:
    """``lang``, ``term``, ``counts`` (array of ``source``, ``n``), ``in_lang``: kept terms, and a NULL term with all groups."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, limit=PIECE):
            yield _count(batch)

    counted = (
        documents.select("lang", "source", "text").mapInArrow(run, COUNTS)
        .groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    )
    by_term = counted.groupBy("lang", "term").agg(
        F.sort_array(F.collect_list(F.struct("source", "n"))).alias("counts"), F.sum("n").alias("in_lang"),
        F.sum("docs").alias("docs"))
    return by_term.filter(F.col("term").isNull() | (F.col("docs") >= LEAST_DOCUMENTS)).select(
        "lang", "term", "counts", "in_lang")


def group_totals(table: DataFrame) -> DataFrame:
    """``lang``, ``source``, ``total``, ``kept`` (V), ``lang_total`` of every group."""
    groups = table.filter("term is null").select("lang", F.explode("counts.source").alias("source"))
    kept = table.filter("term is not null")
    sums = kept.select("lang", F.inline("counts")).groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("in_lang").alias("lang_total"))
    return groups.join(sums, ["lang", "source"], "left").join(langs, "lang", "left").fillna(
        0, ["total", "kept", "lang_total"])


def probabilities(counts: np.ndarray, total: int, kept: int) -> np.ndarray:
    """1 + floor(SCALE (count + 1) / (total + kept)), as longs."""
    if len(counts) and counts.max() >= SMALL_COUNT:
        return np.array([1 + SCALE * (int(c) + 1) // (total + kept) for c in counts], dtype=np.int64)
    return 1 + SCALE * (counts + 1) // (total + kept)


def pair_sums(table: np.ndarray, lengths: np.ndarray, totals: list[int], kept: int,
              wanted: list[tuple[int, int]]) -> Iterator[tuple[int, int, int]]:
    """(source, other, sum of f over the block), both ways, for each wanted pair of columns.

    ``table`` has a row for each run of equal terms, of ``lengths``, and a column for each source.
    """
    # The columns of fewest different counts decide first: their runs become longest.
    by_variety = np.argsort([len(np.unique(table[:, j])) for j in range(table.shape[1])], kind="stable")
    order = np.lexsort(table[:, by_variety[::-1]].T)
    table, upto = table[order], np.r_[0, np.cumsum(lengths[order])]
    columns = []
    for j, total in enumerate(totals):
        starts = np.flatnonzero(np.r_[True, table[1:, j] != table[:-1, j]])
        columns.append((starts, probabilities(table[starts, j], total, kept)))
    for a, b in wanted:
        (starts_a, p_a), (starts_b, p_b) = columns[a], columns[b]
        bounds = np.union1d(starts_a, starts_b)
        p = p_a[np.searchsorted(starts_a, bounds, "right") - 1]
        q = p_b[np.searchsorted(starts_b, bounds, "right") - 1]
        shared = np.diff(upto[np.r_[bounds, len(table)]])
        squares = (p - q) * (p - q)
        yield a, b, int((squares // q * shared).sum())
        yield b, a, int((squares // p * shared).sum())


def _block(rows: pa.Table, heads: pa.Table) -> pa.Table:
    """The sums of one block and tile: ``rows`` are folded terms, ``heads`` the groups of the language."""
    heads = heads.sort_by("source")
    names, totals = heads.column("source").combine_chunks(), heads.column("total").to_pylist()
    size, tile, tiles = len(names), heads.column("tile")[0].as_py(), heads.column("tiles")[0].as_py()
    wanted = [(a, b) for a in range(size) for b in range(a + 1, size) if (a + b) % tiles == tile]
    if rows.num_rows:
        counts = rows.column("counts").combine_chunks()
        cells = counts.flatten()
        table = np.zeros((rows.num_rows, size), np.int64)
        at = np.repeat(np.arange(rows.num_rows), np.asarray(pc.list_value_length(counts)))
        table[at, np.asarray(pc.index_in(cells.field("source"), value_set=names))] = np.asarray(cells.field("n"))
        sums = list(pair_sums(table, np.asarray(rows.column("run")), totals, heads.column("kept")[0].as_py(), wanted))
    else:
        sums = [(x, y, 0) for a, b in wanted for x, y in ((a, b), (b, a))]
    first, second, value = (np.array([s[i] for s in sums], dtype=np.int64) for i in range(3))
    lang = pa.repeat(heads.column("of")[0], len(sums))
    return pa.table([lang, names.take(pa.array(first)), names.take(pa.array(second)), pa.array(value)],
                    names=["lang", "source", "item", "value"])


def pair_divergences(table: DataFrame, totals: DataFrame) -> DataFrame:
    """``lang``, ``source``, ``item`` (another source), ``value``."""
    folded = cut(table.filter("term is not null").groupBy("lang", "counts").agg(F.count("*").alias("run")))
    sources = totals.groupBy("lang").agg(F.count("*").alias("sources"))
    sizes = folded.groupBy("lang").agg(F.count("*").alias("rows"))
    layout = sized(cut(
        sources.join(sizes, "lang", "left").select(
            "lang", F.greatest(F.lit(1), F.ceil(F.coalesce("rows", F.lit(0)) * F.col("sources") / CELLS)).alias("blocks"),
            F.greatest(F.lit(1), F.ceil(F.col("sources") * F.col("sources") / PAIRS)).alias("tiles"))))
    every_tile = F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("tile")
    every_block = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block")
    dealt = folded.join(layout, "lang").select(
        "lang", F.pmod(F.xxhash64("counts"), F.col("blocks")).alias("block"), every_tile, "counts", "run")
    heads = totals.join(layout, "lang").select("lang", "source", "total", "kept", "tiles", every_block)
    heads = heads.select(F.col("lang").alias("of"), F.col("block").alias("in_block"), every_tile, "source", "total", "kept", "tiles")
    sums = dealt.groupBy("lang", "block", "tile").cogroup(heads.groupBy("of", "in_block", "tile")).applyInArrow(
        _block, "lang string, source string, item string, value long")
    return sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def _probability(count: Column, total: Column, kept: Column) -> Column:
    exact = F.lit(SCALE).cast("decimal(10,0)") * (count + 1).cast("decimal(20,0)")
    return F.call_function("div", exact, (total + kept).cast("decimal(20,0)")) + 1


def term_divergences(table: DataFrame, totals: DataFrame) -> DataFrame:
    """``lang``, ``source``, ``item`` (a kept term that the group has more of than its language), ``value``."""
    rows = table.filter("term is not null").select("lang", "term", "in_lang", F.inline("counts"))
    told = rows.join(sized(totals), ["lang", "source"]).select(
        "lang", "source", F.col("term").alias("item"),
        _probability(F.col("n"), F.col("total"), F.col("kept")).alias("p"),
        _probability(F.col("in_lang"), F.col("lang_total"), F.col("kept")).alias("q"))
    difference = F.col("p") - F.col("q")
    return told.filter("p > q").select(
        "lang", "source", "item", F.call_function("div", difference * difference, F.col("q")).alias("value"))


def divergences(documents: DataFrame, top: int = TOP_TERMS) -> DataFrame:
    """``lang``, ``source``, ``part``, ``item``, ``value``, ``rank``: each source against the others (``pair``, all ranks) and
    the terms it has more of than its language (``term``, the first ``top``)."""
    table = cut(term_counts(documents))
    totals = cut(group_totals(table))
    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")

    def part(name: str, rows: DataFrame) -> DataFrame:
        return rows.select("lang", "source", F.lit(name).alias("part"), "item", "value", rank)

    terms = part("term", term_divergences(table, totals)).filter(F.col("rank") <= top)
    return part("pair", pair_divergences(table, totals)).unionByName(terms)
