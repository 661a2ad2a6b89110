"""Quality rules: counts of every text, and a log-likelihood ratio of its hashed word n-grams.

Words and word pairs are hashed into ``BUCKETS`` buckets. Two multinomials over them are counted: of the trusted documents
(labelled of good quality) and of all documents. A document's score is the mean over its n-grams of log p(trusted) - log
p(all). It is kept from a threshold up, unless a base rule rejects it. The threshold is the ``QUANTILE`` of the scores that the
trusted documents would have without their label, that is, with their own n-grams taken out of the trusted multinomial: the
form in which a document without a label is scored.

Base rules: under 20 words; more than 30% of the words in runs of 8 words that the text has twice.

Defined cases: NULL and empty texts have no words and fail; documents without a label, and NULL ids or labels, count among all
documents only; an id labelled twice is trusted if one label says so; repeated rows all count; an empty table gives no rows;
without trusted documents that have words there is no threshold, and the base rules alone decide.
Nothing is joined to whole texts but the set of trusted ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import cut, distinct_rows, sized, text_of, words

BUCKETS = 1 << 13
QUANTILE = 0.001
# Scores are counted by steps of this size for the quantile, some ten thousand steps at most.
STEP = 0.001
# Added to each bucket of both multinomials.
SMOOTHING = 1.0
WINDOW = 8
LEAST_WORDS, MOST_REPEATED = 20, 30
SYMBOLS = r"[#*$%&|<>]"


def _next(column: str, step: int) -> Column:
    """Hashes of each element with that ``step`` after it; as many less."""
    return F.transform(
        F.slice(F.col(column), 1, F.greatest(F.size(column) - step, F.lit(0))),
        lambda x, i: F.xxhash64(x, F.get(F.col(column), i + step)))


def hashed(documents: DataFrame, *carried: Column) -> DataFrame:
    """``words``, hashes of words (``w1``) and of pairs (``w2``), and their buckets (``grams``), of each text."""
    split = documents.select(*carried, words(text_of()).alias("words"))
    ones = split.withColumn("w1", F.transform("words", lambda w: F.xxhash64(w)))
    return ones.withColumn("w2", _next("w1", 1))


def _bucket(h: Column) -> Column:
    return F.pmod(h, F.lit(BUCKETS)).cast("int")


def _flagged(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id``, ``text`` and ``good``, 1 where the document is trusted, else 0."""
    trusted = cut(distinct_rows(labels.filter("quality = 1 and doc_id is not null").select(F.col("doc_id").alias("trusted_id"))))
    flagged = documents.select("doc_id", "text").join(sized(trusted), F.col("doc_id") == F.col("trusted_id"), "left")
    return flagged.select("doc_id", "text", F.col("trusted_id").isNotNull().cast("long").alias("good"))


def log_ratios(flagged: DataFrame) -> DataFrame:
    """One row: ``ratios``, log p(trusted) - log p(all) of every bucket, in order; the counts ``t`` (trusted) and ``n`` (all)
    behind them, and their sums ``all_t`` and ``all_n``."""
    grams = hashed(flagged, F.col("good")).select("good", F.explode(F.concat("w1", "w2")).alias("h"))
    counts = grams.groupBy(_bucket(F.col("h")).alias("bucket")).agg(F.count("*").alias("n"), F.sum("good").alias("t"))
    every = flagged.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    full = every.join(counts, "bucket", "left").select(
        "bucket", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("t", F.lit(0)).alias("t"))
    rows = full.agg(F.sort_array(F.collect_list(F.struct("bucket", "n", "t"))).alias("rows"), F.sum("n").alias("all_n"),
                    F.sum("t").alias("all_t"))
    spread = SMOOTHING * BUCKETS
    ratio = lambda r: F.log((r.t + SMOOTHING) / (F.col("all_t") + spread)) - F.log(
        (r.n + SMOOTHING) / (F.col("all_n") + spread))
    return rows.select(F.transform("rows", ratio).alias("ratios"), F.col("rows.t").alias("t"), F.col("rows.n").alias("n"), "all_t", "all_n")


def unlabelled_scores(flagged: DataFrame, model: DataFrame) -> DataFrame:
    """``doc_id`` and ``llr`` (NULL without words) of each trusted document, its own n-grams taken out of the trusted counts.

    ``model`` is the row of ``log_ratios``, which is cut.
    """
    grams = hashed(flagged.filter("good = 1"), F.col("doc_id")).select(
        "doc_id", F.sort_array(F.transform(F.concat("w1", "w2"), _bucket)).alias("own"))
    # Each bucket of the document and where its run of equal buckets begins.
    runs = F.filter(
        F.transform("own", lambda b, i: F.struct(b.alias("b"), i.alias("i"))),
        lambda x: (x["i"] == 0) | (x["b"] != F.get(F.col("own"), x["i"] - 1)))
    rated = grams.withColumn("runs", runs).withColumn("m", model.select(F.struct("t", "n", "all_t", "all_n")).scalar())
    spread, size = SMOOTHING * BUCKETS, F.size("own")

    def value(run: Column, k: Column) -> Column:
        count = F.coalesce(F.get(F.col("runs"), k + 1)["i"], size) - run["i"]
        trusted = (F.get(F.col("m.t"), run["b"]) - count + SMOOTHING) / (F.col("m.all_t") - size + spread)
        every = (F.get(F.col("m.n"), run["b"]) + SMOOTHING) / (F.col("m.all_n") + spread)
        return count * (F.log(trusted) - F.log(every))

    total = F.aggregate(F.transform("runs", value), F.lit(0.0), lambda t, x: t + x)
    # No filter on ``own``: Spark would move it below the arrays, and make them anew for each element.
    return rated.select("doc_id", F.when(size > 0, total / size).alias("llr"))


def threshold(scores: DataFrame) -> DataFrame:
    """One row: ``threshold``, the quantile of ``llr``, by steps; NULL without scores."""
    steps = scores.groupBy(F.floor(F.col("llr") / STEP).alias("step")).agg(F.count("*").alias("n"))
    return steps.agg((F.percentile("step", QUANTILE, F.col("n")) * STEP).alias("threshold"))


def _runs(column: str) -> Column:
    """The hash and place of each run, sorted by hash; empty, the usual case, if no two are equal."""
    places = F.sort_array(F.transform(F.col(column), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    return F.when(F.size(F.array_distinct(column)) == F.size(column), none).otherwise(places)


def _twice(runs: str) -> Column:
    """The places, in order, of runs that are equal to another."""
    def like(h: Column, i: Column) -> Column:
        return F.coalesce(h == F.get(F.col(runs), i)["h"], F.lit(False))

    found = F.filter(runs, lambda x, i: like(x["h"], i - 1) | like(x["h"], i + 1))
    return F.sort_array(F.transform(found, lambda x: x["i"]))


def scored(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``row`` (the whole document), the counts, ``llr``, ``base_failed`` and ``kept`` of every document."""
    flagged = _flagged(documents, labels)
    model = cut(log_ratios(flagged))
    least = cut(threshold(unlabelled_scores(flagged, model)))
    text = text_of()
    lines = F.filter(F.split(text, "\n"), lambda line: F.length(F.btrim(line, F.lit(" \t\n\x0b\x0c\r"))) > 0)
    base = hashed(
        documents, F.struct("*").alias("row"), F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        lines.alias("lines"))
    base = base.withColumn("w4", _next("w2", 2)).withColumn("w8", _next("w4", 4))
    base = base.withColumn("runs", _runs("w8")).withColumn("starts", _twice("runs"))
    n = F.size("words").cast("long")
    covered = F.aggregate(
        F.transform("starts", lambda s, i: F.least(F.lit(WINDOW), F.coalesce(F.get("starts", i + 1) - s, F.lit(WINDOW)))),
        F.lit(0), lambda total, x: total + x)
    counted = base.select(
        "row", n.alias("n_words"), F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"), "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"), F.concat("w1", "w2").alias("grams"),
        F.spark_partition_id().alias("partition"))
    counted = counted.withColumn("ratios", model.select("ratios").scalar())
    total = F.aggregate("grams", F.lit(0.0), lambda t, h: t + F.get(F.col("ratios"), F.pmod(h, F.lit(BUCKETS)).cast("int")))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    llr = F.when(F.size("grams") > 0, total / F.size("grams"))
    rated = counted.select(
        "row", "partition", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), llr.alias("llr"))
    # Without a threshold, all that the base rules let through.
    passed = F.coalesce(F.col("llr") >= least.scalar(), F.lit(True))
    return rated.withColumn("kept", ~F.col("base_failed") & passed)


def digest(documents: DataFrame, labels: DataFrame) -> DataFrame:
    done = scored(documents.select("doc_id", "text"), labels)
    return done.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
                       "llr")


def good_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents, whole rows, that the rules keep."""
    # The partition's number stands here so that the filter stays above the counts: Spark would else move it below them all,
    # and write each out again wherever the condition needs it.
    return scored(documents, labels).filter("kept and partition >= 0").select("row.*")
