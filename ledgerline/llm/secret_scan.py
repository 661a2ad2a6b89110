"""Secrets in texts: three known forms, and random strings by their token efficiency.

Words of a language are spelled with few tokens of a byte-pair vocabulary, random strings with many. Every run of letters,
digits and ``+/_=-`` of at least ``LEAST_CHARS`` is encoded, and is a span of kind ``random`` if it has fewer than ``RATIO``
characters a token. Runs of letters in the case of a word must have ``LEAST_LETTERS``; those in capitals are encoded in lower
case, as capitals alone make any word costly. Not taken for random: digests and identifiers that are known by their form
(``known_form``), and what overlaps a span of a known form. Runs longer than ``WINDOW`` are encoded in windows of that length,
whose tokens are added up: the cost stays linear.

The known forms are ``assign`` (a name such as token or password, with its value), ``access`` (an access key's id) and ``hex``
(hexadecimal digits). Their matches are the leftmost that do not overlap, each form by itself; those too short are dropped after
matching. A span is a match as a whole, in code points, its end exclusive.

Defined cases: a NULL or empty text has no spans; repeated rows each have their own; a NULL doc_id is kept; letters of names are
A-Z in either case, no others; an empty table gives no rows; other columns are not read. Texts are taken whole.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import DataFrame

from ledgerline.llm.common import pieces, shipped, shipped_path

# The three forms, the length from which a match of each counts, and the pattern that splits text before merges.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_VALUE, LEAST_ACCESS = 6, 20
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

KINDS = ("assign", "access", "hex", "random")
LEAST_CHARS, LEAST_LETTERS = 16, 20
# Of random strings of 16 characters over 62, one in a thousand has more than 1.78; of long words, one in a hundred has less than 2.
RATIO = 1.9
WINDOW = 4096
RUN = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST_CHARS},}}")

# Any of the forms, as a sieve for whole texts: what it lets through is looked at in full.
SIEVE = rf"(?i)password|passwd|secret|token|api_?key|(?-i)AKIA|[0-9a-f]{{24}}|[A-Za-z0-9+/_=-]{{{LEAST_CHARS}}}"

# Hexadecimal digits of the usual digests: MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512.
DIGEST_LENGTHS = frozenset((32, 40, 56, 64, 96, 128))
DIGEST = re.compile(r"[0-9a-f]+|[0-9A-F]+")
NAMED_DIGEST = re.compile(r"(?:md5|sha-?(?:1|224|256|384|512))[-_=+/].*", re.IGNORECASE)
UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
CAMEL = re.compile(r"[A-Za-z]?[a-z]{2,}(?:[A-Z][a-z]{2,})+[0-9]{0,4}")
SEPARATOR = re.compile(r"[+/_=-]+")
WORD = re.compile(r"[A-Za-z]?[a-z]+|[A-Z]+")
PART = re.compile(r"[0-9]*|[A-Za-z]?[a-z]{0,7}[0-9]{0,2}|[A-Z]{1,8}[0-9]{0,2}")

Span = tuple[str, int, int]


def known_form(run: str) -> bool:
    """Whether a run is a digest or an identifier by its form.

    Digests: hexadecimal digits of a digest's length, a UUID, or what is named a digest. Identifiers: digits and separators
    only; names in camel case; short words or numbers joined by separators, as in paths and constants.
    """
    if (len(run) in DIGEST_LENGTHS and DIGEST.fullmatch(run)) or UUID.fullmatch(run) or NAMED_DIGEST.fullmatch(run):
        return True
    parts = SEPARATOR.split(run)
    if all(part.isdigit() or not part for part in parts) or CAMEL.fullmatch(run):
        return True
    return len(parts) > 1 and all(len(part) <= 8 and PART.fullmatch(part) for part in parts)


class Scanner:
    """Finds spans by one vocabulary: a file of lines with a token in base64 and its rank."""

    def __init__(self, path: str, ratio: float = RATIO):
        with open(path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        self.ratio = ratio
        self.encoding = tiktoken.Encoding("scan", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def tokens(self, run: str) -> int:
        return sum(len(self.encoding.encode_ordinary(run[i : i + WINDOW])) for i in range(0, len(run), WINDOW))

    def is_random(self, run: str) -> bool:
        word = WORD.fullmatch(run)
        if known_form(run) or (word and len(run) < LEAST_LETTERS):
            return False
        return len(run) < self.ratio * self.tokens(run.lower() if word and run.isupper() else run)

    def spans(self, text: str) -> list[Span]:
        """All spans, by their start and then by kind."""
        found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
        found += [("hex", *m.span()) for m in HEX.finditer(text)]
        base = sorted((start, end) for _, start, end in found)
        reached, at = 0, 0  # the furthest end of the base spans that start before the run's end
        for m in RUN.finditer(text):
            while at < len(base) and base[at][0] < m.end():
                reached, at = max(reached, base[at][1]), at + 1
            if reached <= m.start() and self.is_random(m[0]):
                found.append(("random", *m.span()))
        return sorted(found, key=lambda span: (span[1], KINDS.index(span[0])))


@cache
def scanner(path: str) -> Scanner:
    """One for each task process."""
    return Scanner(path)


def _scanned(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[tuple[pa.RecordBatch, list[list[Span]]]]:
    own = scanner(shipped_path(name))
    for batch in pieces(batches):
        texts = pc.fill_null(batch.column("text"), "")
        suspect = pc.match_substring_regex(texts, SIEVE).to_pylist()
        yield batch, [own.spans(text.as_py()) if look else [] for text, look in zip(texts, suspect, strict=True)]


def found_secrets(documents: DataFrame, path: str) -> DataFrame:
    """``doc_id``, ``kind``, ``start``, ``end``, ``secret``: a row for each span, with its text."""
    name = shipped(documents.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, spans in _scanned(batches, name):
            rows = [(i, *span, text[span[1] : span[2]]) for i, text, found in
                    zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), spans, strict=True) for span in found]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
                                             ["doc_id", "kind", "start", "end", "secret"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, kind string, start long, end long, secret string")


def without_secrets(documents: DataFrame, path: str) -> DataFrame:
    """The documents with every span replaced by its kind in square brackets; spans that overlap become one, of the first kind."""
    name, schema = shipped(documents.sparkSession, path), documents.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, spans in _scanned(batches, name):
            texts = [masked(text, found) for text, found in zip(batch.column("text").to_pylist(), spans, strict=True)]
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return documents.mapInArrow(run, schema)


def masked(text: str | None, spans: list[Span]) -> str | None:
    if not spans:
        return text
    out, reached = [], 0
    for kind, start, end in spans:
        if start >= reached:
            out += [text[reached:start], f"[{kind}]"]
        reached = max(reached, end)
    return "".join([*out, text[reached:]])


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def digest(documents: DataFrame, path: str) -> DataFrame:
    """``doc_id``, ``n_assign``, ``n_access``, ``n_hex``, ``base_sha256`` of the known forms' spans, ``n_random``, ``spans``."""
    name = shipped(documents.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, spans in _scanned(batches, name):
            counts = [pa.array([sum(s[0] == kind for s in found) for found in spans], pa.int64()) for kind in KINDS]
            base = [hashlib.sha256(joined([s for s in found if s[0] != "random"]).encode()).hexdigest() for found in spans]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), *counts[:3], pa.array(base, pa.string()), counts[3],
                 pa.array([joined(found) for found in spans], pa.string())],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "n_random", "spans"])

    return documents.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, n_random long, spans string")
