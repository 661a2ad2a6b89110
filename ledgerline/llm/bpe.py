"""Byte-pair encoding by an automaton over tokens, and decoding by its labels.

The automaton reads tokens and accepts exactly the sequences that the merges produce. It starts as one state that may read any
byte again and again. Each merge (u, v) then adds a gadget: wherever u and v could be read, their join may be read too, and
leads where v led; and u now leads to a copy of its state in which v can't be read. So a state is all that a token's right
side forbids, every token leads to one state, and there is a state for each merge. A state is stored as the one it copies and
the arc that it lacks; its other arcs are worked out when first used, and kept.

A word is encoded from left to right: at a place, a table of byte transitions finds the tokens that begin there, and the
automaton says which of them may follow; the longest is tried first. Of every prefix there is just one accepted sequence, so no
place is reached in two ways. Words are cut by the tokenizer's pattern, and special tokens before that.

Reads tokenizer files of byte-level BPE. A file with a normaliser, a prefix space or other things not done here is refused.

Defined cases: NULL texts are empty, and an empty text has no tokens; repeated rows are encoded each; a NULL doc_id is kept; an
empty table gives no rows; long words and texts are taken whole.
"""

from __future__ import annotations

import hashlib
import json
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache
from itertools import batched, chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from ledgerline.llm.common import pieces, shipped, shipped_path

# Fixed value: how the byte-level pre-tokenizer cuts text.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
REMEMBERED_WORDS, REMEMBERED_LENGTH, REMEMBERED_ARCS = 300_000, 64, 1_000_000
WORDS_AT_ONCE = 100_000


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in vocabulary files: itself where it can be seen, else one from 256 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(seen)]
    return {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Automaton:
    """Compiled from the labels of all tokens by id, and merges (left id, right id, joined id) by priority."""

    def __init__(self, labels: dict[int, bytes], merges: list[tuple[int, int, int]]):
        self.labels = labels
        joined = {join for _, _, join in merges}
        single = [t for t, label in labels.items() if len(label) == 1 and t not in joined]
        self.made = dict.fromkeys(single, -1)
        self.left: dict[int, int] = {}
        self.state_of = dict.fromkeys(single, 0)
        # Of each state: whose right side it is, and the merge that made it. State 0 is the first.
        self.owner, self.since = [-1], [-1]
        # Of each token: its state before its first split, and the states and times of its splits.
        self.base: dict[int, int] = {}
        self.chain: dict[int, list[int]] = {}
        self.times: dict[int, list[int]] = {}
        self.split_at: dict[tuple[int, int], int] = {}
        self.arcs: dict[tuple[int, int], bool] = {}
        for time, (u, v, join) in enumerate(merges):
            self._gadget(time, u, v, join)
        self.arcs.clear()
        self.nodes: dict[int, int] = {}
        self.found = [-1]
        for token in self.made:
            self._add_label(token)
        self.longest = max((len(labels[token]) for token in self.made), default=0)

    def _gadget(self, time: int, u: int, v: int, join: int) -> None:
        if u not in self.state_of or v not in self.state_of or join in self.made or not self._arc(self.state_of[u], v):
            return  # u and v never stand side by side
        self.made[join], self.left[join] = time, u
        self.state_of[join] = self.state_of[v]
        self.owner.append(u)
        self.since.append(time)
        self.base.setdefault(u, self.state_of[u])
        self.state_of[u] = len(self.owner) - 1
        self.chain.setdefault(u, []).append(self.state_of[u])
        self.times.setdefault(u, []).append(time)
        self.split_at[u, v] = time

    def _arc(self, state: int, token: int) -> bool:
        """Whether the token can be read in the state."""
        while state:
            if self.made[token] >= self.since[state]:
                token = self.left[token]  # younger than the state: it came where its left part could be read
                continue
            owner = self.owner[state]
            if self.split_at.get((owner, token), self.since[state] + 1) <= self.since[state]:
                return False
            earlier = bisect_right(self.times[owner], self.made[token])
            state = self.chain[owner][earlier - 1] if earlier else self.base[owner]
        return True

    def _add_label(self, token: int) -> None:
        node = 0
        for byte in self.labels[token]:
            node = self.nodes.setdefault(node << 8 | byte, len(self.found))
            if node == len(self.found):
                self.found.append(-1)
        self.found[node] = token

    def _beginning_at(self, word: bytes, start: int) -> list[int]:
        """The tokens that the bytes from a place on begin with, the longest last."""
        nodes, found, node, out = self.nodes, self.found, 0, []
        for byte in word[start : start + self.longest]:
            node = nodes.get(node << 8 | byte)
            if node is None:
                break
            if found[node] >= 0:
                out.append(found[node])
        return out

    def encode(self, word: bytes) -> tuple[int, ...]:
        """The tokens of a word: the path that spells it, longer tokens tried first.

        A place can be reached in one way only, so one that turns out to lead nowhere is not tried again.
        """
        size, arcs, labels, state_of = len(word), self.arcs, self.labels, self.state_of
        path: list[int] = []
        state, place, nowhere = 0, 0, set()
        choices = [self._beginning_at(word, 0)]
        while place < size:
            left = choices[-1]
            while left:
                token = left.pop()
                end = place + len(labels[token])
                if end in nowhere:
                    continue
                allowed = arcs.get((state, token))
                if allowed is None:
                    allowed = arcs[state, token] = self._arc(state, token)
                if allowed:
                    path.append(token)
                    state, place = state_of[token], end
                    if place < size:
                        choices.append(self._beginning_at(word, place))
                    break
            else:
                if not path:
                    raise ValueError("the vocabulary lacks a byte of the text")
                nowhere.add(place)
                choices.pop()
                place -= len(labels[path.pop()])
                state = state_of[path[-1]] if path else 0
        return tuple(path)


class Tokenizer:
    """Encodes and decodes whole texts by a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, cutter = spec["model"], spec["pre_tokenizer"] or {}
        odd = [key for key in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback",
                               "ignore_merges") if model.get(key)]
        if model["type"] != "BPE" or cutter.get("type") != "ByteLevel" or cutter.get("add_prefix_space") \
                or not cutter.get("use_regex", True) or spec["normalizer"] or odd:
            raise ValueError(f"not a plain byte-level BPE file: {path}")
        letters = byte_letters()
        vocabulary = model["vocab"]
        labels = {i: bytes(letters[c] for c in token) for token, i in vocabulary.items() if all(c in letters for c in token)}
        pairs = [tuple(pair.split(" ")) if isinstance(pair, str) else tuple(pair) for pair in model["merges"]]
        self.automaton = Automaton(labels, [(vocabulary[a], vocabulary[b], vocabulary[a + b]) for a, b in pairs])
        added = spec.get("added_tokens") or []
        if any(token.get(key) for token in added for key in ("single_word", "lstrip", "rstrip")):
            raise ValueError(f"special tokens that strip their neighbours: {path}")
        self.special = {token["content"]: token["id"] for token in added}
        self.labels = labels | {i: content.encode() for content, i in self.special.items()}
        names = sorted(self.special, key=len, reverse=True)
        self.special_pattern = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None
        self.pattern = regex.compile(PATTERN)
        self.texts = {i: str(i) for i in self.labels}
        self.known: dict[str, tuple[int, ...]] = {}

    def _words(self, text: str) -> Iterator[list[str]]:
        if len(text) <= WORDS_AT_ONCE:
            yield self.pattern.findall(text)
        else:
            for some in batched(self.pattern.finditer(text), WORDS_AT_ONCE):
                yield [match.group() for match in some]

    def _word(self, word: str) -> tuple[int, ...]:
        ids = self.automaton.encode(word.encode("utf-8"))
        if len(word) <= REMEMBERED_LENGTH:
            if len(self.known) >= REMEMBERED_WORDS:
                self.known.clear()
            if len(self.automaton.arcs) >= REMEMBERED_ARCS:
                self.automaton.arcs.clear()
            self.known[word] = ids
        return ids

    def encode_parts(self, text: str) -> Iterator[list[int]]:
        """The token ids, some at a time."""
        parts = self.special_pattern.split(text) if self.special_pattern else [text]
        for part in parts:
            if part in self.special:
                yield [self.special[part]]
            elif part:
                for words in self._words(part):
                    known = self.known
                    yield list(chain.from_iterable([known.get(w) or self._word(w) for w in words]))

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(self.encode_parts(text)))

    def label_bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.labels.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        """The text that the labels spell; bytes that are no UTF-8 become the replacement character."""
        return self.label_bytes(ids).decode("utf-8", errors="replace")

    def round_trip(self, text: str) -> tuple[int, str, str]:
        """How many tokens, the SHA-256 of the ids joined by commas, and of the text decoded from them."""
        count, joined, spelled = 0, hashlib.sha256(), []
        for ids in self.encode_parts(text):
            if ids:
                joined.update(("," * bool(count) + ",".join(map(self.texts.__getitem__, ids))).encode())
                count += len(ids)
                spelled.append(self.label_bytes(ids))
        decoded = b"".join(spelled).decode("utf-8", errors="replace")
        return count, joined.hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


@cache
def tokenizer(path: str) -> Tokenizer:
    """One for each task process."""
    return Tokenizer(path)


def encoded(documents: DataFrame, path: str) -> DataFrame:
    """``doc_id`` and ``ids`` of every document."""
    name = shipped(documents.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(shipped_path(name))
        for batch in pieces(batches):
            ids = [own.encode(text or "") for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decoded(encodings: DataFrame, path: str) -> DataFrame:
    """``doc_id`` and ``text`` from ``doc_id`` and ``ids``; NULL ids give an empty text."""
    name = shipped(encodings.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(shipped_path(name))
        for batch in batches:
            texts = [own.decode(ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(texts, pa.string())],
                                             ["doc_id", "text"])

    return encodings.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digest(documents: DataFrame, path: str) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids_sha256``, ``decoded_sha256``: each text encoded, then decoded, in one pass."""
    name = shipped(documents.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(shipped_path(name))
        for batch in pieces(batches):
            counts, ids, texts = [], [], []
            for text in batch.column("text").to_pylist():
                for column, value in zip((counts, ids, texts), own.round_trip(text or ""), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(ids, pa.string()),
                 pa.array(texts, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return documents.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
