"""Roles of transcripts: Viterbi against all paths, conversations over many ranges, accuracy on held-out turns."""

import itertools

import numpy as np
import pytest

from conftest import TESTDATA
from ledgerline.llm import chat, ranges
from ledgerline.llm.common import ship
from ledgerline.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string"


def random_model(seed):
    rng, s = np.random.default_rng(seed), len(chat.STATES)
    return {kind: np.log(rng.dirichlet(np.ones(s if kind in ("start", "next") else size), 1 if kind == "start" else s))
            for kind, size in chat.KINDS.items()}


def log_probability(states, lines, model):
    total = model["start"][0, states[0]] + sum(model["next"][a, b] for a, b in itertools.pairwise(states))
    for state, line in zip(states, lines, strict=True):
        total += sum(model[kind][state, value] for kind, value in zip(("marker", "length", "asks"), chat.shown(line), strict=True))
    return total


@pytest.mark.parametrize("seed", range(5))
def test_path_is_the_best_of_all(seed):
    model = random_model(seed)
    lines = ["User: hello", "what is it?", "", "### Assistant: a long answer to it", "more of it"]
    best = max(itertools.product(range(len(chat.STATES)), repeat=len(lines)), key=lambda path: log_probability(path, lines, model))
    assert tuple(chat._path(lines, model)) == best
    for a, b in [(1, 3), (2, 4), (1, 2)]:
        parts = [lines[:a], lines[a:b], lines[b:]]
        ends = chat._between([chat._matrix(part, model) for part in parts])
        assert tuple(k for part, at in zip(parts, ends, strict=True) for k in chat._path(part, model, *at)) == best


@pytest.mark.parametrize("turn", [None, 4])
def test_a_conversation_of_one_turn_number_is_divided(spark, monkeypatch, turn):
    monkeypatch.setattr(ranges, "LEAST_ROWS", 100)
    ship(spark)
    said = [f"User: {i} and more?" if i % 3 else f"{i}\nof two lines" for i in range(3_000)]
    talks = spark.createDataFrame([(9, turn, None, t) for t in said] + [(i, 0, "user", "x") for i in range(20, 900)], SCHEMA)
    model = random_model(3)
    turns = chat.transcript_turns(talks)
    found = chat.recovered(turns, model)
    sizes = found.filter("conv_id = 9").rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert sum(sizes) == len(said) and max(sizes) < 400
    order = sorted(said, key=lambda t: t.encode()[: ranges.PREFIX])
    states = iter(chat._path([line for t in order for line in t.split("\n")], model))
    want = {t: "".join(chat.STATES[k][0][0].upper() if chat.STATES[k][1] else chat.STATES[k][0][0]
                       for k in (next(states) for _ in t.split("\n"))) for t in order}
    rendered = found.filter("conv_id = 9").collect()
    assert sorted(want.values()) == sorted(r.states for r in rendered)
    assert sum(r.rendered.endswith("<|end|>\n") for r in rendered) == 1


def test_equal_rows_of_one_conversation_are_divided(spark, monkeypatch):
    monkeypatch.setattr(ranges, "LEAST_ROWS", 100)
    ship(spark)
    talks = spark.createDataFrame([(1, 1, "user", "the same")] * 2_500 + [(2, 1, "user", "another")], SCHEMA)
    found = chat.recovered(chat.transcript_turns(talks), random_model(1))
    sizes = found.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert sum(sizes) == 2_501 and max(sizes) < 600


def test_most_held_out_turns_have_their_role(spark):
    found = QUERIES["op1_chat_format"](spark, str(TESTDATA / "sf0.01")).filter("held_out and role in ('system', 'user', 'assistant')")
    row = found.selectExpr("avg(cast(right as int))", "avg(cast(upper(left(states, 1)) = upper(left(role, 1)) as int))").first()
    # Of 137 turns 60% are found whole, and the first line of 80% has the right role.
    assert row[0] > 0.55 and row[1] > 0.75
