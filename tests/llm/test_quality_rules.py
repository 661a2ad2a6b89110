"""Scores and threshold of the quality rules against brute force, over whole tables."""

import math
import re
from collections import Counter

import pytest
import xxhash

from conftest import TESTDATA
from ledgerline.llm import quality_rules as rules
from ledgerline.llm.common import ship


def hashed(value, seed=42):
    data = value.encode() if isinstance(value, str) else value.to_bytes(8, "little")
    return xxhash.xxh64_intdigest(data, seed=seed)


def buckets(text):
    ones = [hashed(w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    grams = ones + [hashed(b, seed=hashed(a)) for a, b in zip(ones, ones[1:], strict=False)]
    # The hashes are signed numbers to Spark; 2^64 is a multiple of the buckets.
    return Counter(h % rules.BUCKETS for h in grams)


def mean_ratio(own, t, n, without):
    """Of a text's bucket counts; with ``without``, those are first taken out of the trusted ones."""
    size, all_t, all_n, spread = sum(own.values()), sum(t.values()), sum(n.values()), rules.SMOOTHING * rules.BUCKETS
    total = 0.0
    for b, c in own.items():
        trusted = (t[b] - c * without + rules.SMOOTHING) / (all_t - size * without + spread)
        total += c * (math.log(trusted) - math.log((n[b] + rules.SMOOTHING) / (all_n + spread)))
    return total / size if size else None


@pytest.fixture(scope="module")
def tables(spark):
    ship(spark)
    sf = TESTDATA / "sf0.001"
    docs = spark.read.parquet(str(sf / "documents.parquet")).select("doc_id", "text")
    odd = spark.createDataFrame([(None, "no id"), (-1, None), (-2, ""), (-3, "twice twice twice"), (-3, "twice twice twice"), (-4, "é " * 5000)],
                                "doc_id long, text string")
    labels = spark.read.parquet(str(sf / "labels.parquet")).select("doc_id", "quality")
    more = spark.createDataFrame([(None, 1), (-1, 1), (-2, 1), (-3, 1), (-3, 0), (-4, None)], "doc_id long, quality int")
    return docs.unionByName(odd), labels.unionByName(more)


def test_scores_threshold_and_verdicts_equal_brute_force(tables):
    docs, labels = tables
    good = {r.doc_id for r in labels.collect() if r.quality == 1 and r.doc_id is not None}
    texts = [(r.doc_id, r.text, buckets(r.text)) for r in docs.collect()]
    n, t = Counter(), Counter()
    for i, _, own in texts:
        n.update(own)
        t.update(own if i in good else {})
    alone = sorted(s for i, _, own in texts if i in good and (s := mean_ratio(own, t, n, True)) is not None)
    flagged = rules._flagged(docs, labels)
    scores = rules.unlabelled_scores(flagged, rules.log_ratios(flagged))
    assert sorted(r.llr for r in scores.collect() if r.llr is not None) == pytest.approx(alone, abs=1e-9)
    place = rules.QUANTILE * (len(alone) - 1)
    low = [math.floor(s / rules.STEP) * rules.STEP for s in alone]
    least = low[int(place)] + (place - int(place)) * (low[int(place) + 1] - low[int(place)])
    assert rules.threshold(scores).first().threshold == pytest.approx(least, abs=1e-9)
    want = Counter()
    for i, _, own in texts:
        s = mean_ratio(own, t, n, False)
        want[i, None if s is None else round(s, 8), s is not None and s >= least] += 1
    got = Counter((r.doc_id, None if r.llr is None else round(r.llr, 8), r.kept or (r.base_failed and r.llr is not None and r.llr >= least))
                  for r in rules.digest(docs, labels).collect())
    assert got == want


def test_without_trusted_documents_the_base_rules_decide(tables):
    docs, labels = tables
    rows = rules.digest(docs, labels.filter("false")).collect()
    assert len(rows) == docs.count() and all(r.kept == (not r.base_failed) for r in rows)
