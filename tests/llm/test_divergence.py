"""Divergence of sources against brute force, also in many small blocks and tiles."""

import random
import re
from collections import Counter, defaultdict

import numpy as np

from ledgerline.llm import divergence
from ledgerline.llm.common import ship

SCHEMA = "doc_id long, text string, lang string, source string, item string, rank int, term string, n long"


def brute(rows):
    docs = [(la or "", s or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+",
             re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))) for t, la, s in rows]
    holders, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for la, s, terms in docs:
        groups[la].add(s)
        holders[la].update(set(terms))
        counts[la, s].update(terms)
    out = set()
    for la in groups:
        kept = [t for t, k in holders[la].items() if k >= 3]

        def p(count, kept=kept):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 1) // (total + len(kept)) for t in kept}

        whole = p(sum((counts[la, s] for s in groups[la]), Counter()))
        own = {s: p(counts[la, s]) for s in groups[la]}
        for s in groups[la]:
            pairs = [(sum((own[s][t] - own[o][t]) ** 2 // own[o][t] for t in kept), o) for o in groups[la] if o != s]
            terms = [((own[s][t] - whole[t]) ** 2 // whole[t], t) for t in kept if counts[la, s][t] and own[s][t] > whole[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, 200)):
                ranked = sorted(items, key=lambda x: (-x[0], x[1].encode()))[:most]
                out |= {(la, s, part, item, value, k + 1) for k, (value, item) in enumerate(ranked)}
    return out


def found(spark, rows):
    made = [(i, t, la, s, "x", 1, "y", 2) for i, (t, la, s) in enumerate(rows)]
    ship(spark)
    return [tuple(r) for r in divergence.divergences(spark.createDataFrame(made, SCHEMA)).collect()]


ODD = [
    (None, None, None), ("", "en", "a"), ("12 - 3\x00", "en", "z"), ("Ærø ærø the THE cat", "en", "a"), ("the cat's Ærø", "en", "b"),
    ("the the cat", "en", None), ("the the cat", "en", None), ("cat Ærø\x7fthe", "en", ""), ("lonely words here", "fr", "a"),
    ("other words", "fr", "b"), ("x " * 5000, "de", "a"), ("x", "de", "a"), ("x y", "de", "b"), ("日本 日本", "de", "c"),
]


def test_odd_rows_equal_brute_force(spark):
    rows = found(spark, ODD)
    assert len(rows) == len(set(rows)) and set(rows) == brute(ODD)
    assert {(r[0], r[4]) for r in rows if r[0] == "fr"} == {("fr", 0)}


def test_empty_table_and_single_group(spark):
    assert found(spark, []) == []
    assert found(spark, [("a b", "en", "s")] * 2) == []


def test_blocks_and_tiles_add_up(spark, monkeypatch):
    rng = random.Random(7)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    rows = [(" ".join(rng.choices(words, weights=[1 / (i + 1) for i in range(300)], k=rng.randint(0, 200))),
             rng.choice(["en", "en", "en", "de"]), f"s{int(rng.paretovariate(0.7)) % 9}") for _ in range(150)]
    want = brute(rows)
    assert set(found(spark, rows)) == want
    monkeypatch.setattr(divergence, "CELLS", 64)
    monkeypatch.setattr(divergence, "PAIRS", 10)
    assert set(found(spark, rows)) == want


def test_counts_beyond_a_long_product_are_exact():
    counts = np.array([0, 7, 10**13, 3 * 10**12 + 1])
    total = int(counts.sum())
    assert divergence.probabilities(counts, total, 4).tolist() == [1 + 10**9 * (int(c) + 1) // (total + 4) for c in counts]


def test_top_terms_are_cut_before_the_shuffle(spark):
    docs = spark.createDataFrame([("a b c", "en", "s")] * 4, "text string, lang string, source string")
    plan = divergence.divergences(docs)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan and "CartesianProduct" not in plan
