"""Which documents are linked, and the components of the links, from banded signatures.

No group is ever paired with itself. Each bucket of equal band hashes first offers only pairs of its members with its
smallest one. Once those that hold have joined documents into components, only buckets whose other members still lie in
different components are looked at again: their members outside the largest component against all members, in blocks of
bounded size. A block is verified where it stands, by signatures and then by full sets, and gives only the links that join what
it has not joined yet, fewer than it has members. A link within a bucket is lost only if its signatures differ by six standard
deviations more than they should.

Null ids are never linked. Rows that share an id are one document, linked by any of their texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import cut, distinct_rows

# Elements that the sets of a block have, about; a block has one set at least.
BLOCK_ELEMENTS = 1 << 17
MOST_ROUNDS = 50


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``component`` (its smallest node) of every node of the edges ``a``, ``b``.

    Alternates joining every node's larger and smaller neighbours to its smallest one, until nothing changes. Rounds grow
    with the logarithm of the nodes; each is cut from the one before. Empty edges give no rows.
    """
    edges = edges.filter(F.col("a") != F.col("b"))
    edges = cut(distinct_rows(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))))
    before = None
    for _ in range(MOST_ROUNDS):
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state.n == 0 or state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                distinct_rows(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))))
        before = state
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        smallest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(smallest, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut(distinct_rows(large.filter("u > v")))
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(smallest, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(distinct_rows(small.unionByName(smallest.select("u", F.col("m").alias("v")))))
    raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")


def _common(own: np.ndarray, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """How many elements each of the consecutive sets has in common with the sorted ``own``."""
    hit = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
    return np.add.reduceat(hit, np.r_[0, np.cumsum(sizes)][:-1], dtype=np.int64)


def _joining(percent: int, least: float):
    """Links between a block of members and a block of others that join labels not joined before, verified on full sets."""
    def parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
        rows = column.flatten()
        sigs = np.stack([np.frombuffer(sig, np.uint8) for sig in rows.field("sig").to_pylist()])
        lists = rows.field("members")
        flat, ends = np.asarray(lists.flatten()), np.r_[0, np.cumsum(np.asarray(lists.value_lengths()))]
        sets = [np.sort(flat[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        return np.asarray(rows.field("node")), np.asarray(rows.field("label")), sigs, sets

    def block(others: pa.Array, members: pa.Array) -> list[tuple[int, int]]:
        nodes, labels, sigs, sets = parts(members)
        q_nodes, q_labels, q_sigs, q_sets = parts(others)
        known, place = np.unique(np.r_[labels, q_labels], return_inverse=True)
        group, sizes = np.arange(len(known)), np.array([len(s) for s in sets])
        out = []
        for i, (node, sig, own) in enumerate(zip(q_nodes, q_sigs, q_sets, strict=True)):
            mine, theirs = place[len(labels) + i], place[: len(labels)]
            near = np.flatnonzero((group[theirs] != group[mine]) & ((sigs == sig).mean(axis=1) >= least))
            if not len(near):
                continue
            common = _common(own, np.concatenate([sets[j] for j in near]), sizes[near])
            for j in near[100 * common >= percent * (len(own) + sizes[near] - common)]:
                if group[theirs[j]] != group[mine]:
                    out.append((int(node), int(nodes[j])))
                    group[group == group[theirs[j]]] = group[mine]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                found = block(row.column("others"), row.column("members"))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([min(p) for p in found], pa.int64()), pa.array([max(p) for p in found], pa.int64())], ["a", "b"])

    return run


def verified(pairs: DataFrame, sets_of: Callable[[DataFrame], DataFrame], percent: int) -> DataFrame:
    """Of pairs ``a``, ``b`` those with 100 * intersection >= percent * union of their full sets."""
    ids = cut(distinct_rows(pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id")))))
    sets = sets_of(ids)
    both = (
        pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("members").alias("left")), "a")
        .join(sets.select(F.col("doc_id").alias("b"), F.col("members").alias("right")), "b")
        .select("a", "b", F.size("left").alias("l"), F.size("right").alias("r"),
                F.size(F.array_intersect("left", "right")).alias("common"))
    )
    linked = both.filter(F.lit(100).cast("long") * F.col("common") >= percent * (F.col("l") + F.col("r") - F.col("common")))
    return distinct_rows(linked.filter("common > 0").select("a", "b"))


def link_components(
    sketches: DataFrame, sets_of: Callable[[DataFrame], DataFrame], percent: int, coordinates: int,
) -> DataFrame:
    """``node``, ``component`` of every linked node.

    ``sketches`` has ``node``, ``bands`` (an array of hashes, each salted by its band) and ``sig`` (a byte of each
    coordinate), is cut, and has a row for each distinct text. ``sets_of`` gives ``doc_id``, ``members`` (the distinct elements
    of the whole text as numbers) for a table of ``doc_id``.
    """
    rows = distinct_rows(sketches.select("node", F.explode("bands").alias("key")))
    buckets = rows.groupBy("key").agg(F.min("node").alias("center"), F.count("*").alias("n")).filter("n > 1")
    # Cut, so that the join stands between two plain shuffles, whose large buckets Spark can split.
    members = cut(rows.join(cut(buckets.drop("n")), "key").filter("node != center"))
    star = cut(distinct_rows(members.select(F.col("center").alias("a"), F.col("node").alias("b"))))
    links = cut(verified(star, sets_of, percent))
    found = cut(components(links))

    labelled = members.join(found, "node", "left").select("key", "node", F.coalesce("component", "node").alias("label"))
    open_keys = labelled.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low != high")
    labelled = cut(labelled.join(open_keys.select("key"), "key", "left_semi"))
    if labelled.isEmpty():
        return found
    counts = labelled.groupBy("key", "label").agg(F.count("*").alias("n"))
    main = counts.groupBy("key").agg(F.max_by("label", F.struct("n", "label")).alias("main"))
    nodes = cut(distinct_rows(labelled.select(F.col("node").alias("doc_id"))))
    sets = cut(sets_of(nodes).select(F.col("doc_id").alias("node"), "members"))
    sized_nodes = sets.select("node", F.size("members").alias("size"))
    placed = cut(labelled.join(main, "key").join(sized_nodes, "node"))

    def blocks(df: DataFrame, name: str) -> DataFrame:
        counts = df.groupBy("key").agg(F.ceil(F.sum("size") / BLOCK_ELEMENTS).alias("blocks"))
        block = F.pmod(F.xxhash64("node", F.lit(name)), F.col("blocks"))
        whole = df.join(counts, "key").select("key", "node", "label", block.alias("block"))
        whole = whole.join(sketches.select("node", "sig"), "node").join(sets, "node")
        return whole.groupBy("key", "block").agg(
            F.collect_list(F.struct("node", "label", "sig", "members")).alias(name)).drop("block")

    similarity = percent / 100
    least = similarity - 6 * (similarity * (1 - similarity) / coordinates) ** 0.5
    pairs = (
        blocks(placed.filter("label != main"), "others").join(blocks(placed, "members"), "key").select("others", "members")
        .mapInArrow(_joining(percent, least), "a long, b long")
    )
    return components(links.unionByName(cut(distinct_rows(pairs))))
