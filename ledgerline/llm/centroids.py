"""Centroid clustering of whole-number vectors, with heaps of bounds that expire.

A vector remembers, with its cluster, the gap between a lower bound of its distance to any other centroid and an upper bound of
that to its own. When centroids move, a gap shrinks by at most the way of its own centroid and the longest way of another; that
sum is the cluster's drift of the round, and accumulates. The gap is kept with the drift at that time added, so it stays as it is
while the drift grows, and has expired once the drift has reached it. In every task a cluster's vectors are in a heap by that
number: the expired ones are popped, and only they are measured against all centroids; the rest is not looked at.

Assignment is by exact squared distances of whole numbers. Bounds are square roots in floating point; they are moved by
``SLACK`` to the safe side, and a gap of 0 has expired, so that ties are always decided exactly, for the smaller number.

A round reads the vectors and their state, and writes them again to the folder that all executors share; new centroids come from
the sums over the vectors that moved. The driver holds the centroids and such sums, a row for each cluster. Batches bound what a
task holds, so one large cluster, or one vector repeated without end, is spread like any other rows.

Defined cases: vectors that are NULL, have another length, or hold a NULL, NaN or infinite component are left out; a component of
``LIMIT`` or more after scaling is an error, since squared distances would exceed a long; repeated rows are vectors like others;
a NULL vec_id is kept, and chosen as a first centroid only if ids run out; equal hashes go by the vector; fewer vectors than
clusters make fewer clusters; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import Scratch, sized

COMPONENTS, SCALE = 64, 256
CLUSTERS, ROUNDS, SEED = 40, 5, 2
LIMIT = 2**27
SLACK = 1e-9
# Below this all sums of a distance are whole numbers that floating point holds exactly.
EXACT = 2**21

STATE = "vec_id long, vector array<int>, cluster int, was int, gap double, looked boolean"
FOUND = "vec_id long, cluster int, distance long"


@dataclass
class Centroids:
    """Where the centroids are, and how far each cluster's gaps have drifted."""

    places: np.ndarray
    drift: np.ndarray

    def moved(self, places: np.ndarray) -> Centroids:
        way = np.sqrt(((places - self.places) ** 2).sum(axis=1).astype(np.float64)) * (1 + SLACK)
        longest = np.array([np.delete(way, c).max(initial=0.0) for c in range(len(way))])
        return Centroids(places, self.drift + (way + longest) * (1 + SLACK))


def distances(vectors: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Exact squared distances of every vector to every place."""
    if max(np.abs(vectors).max(initial=0), np.abs(places).max(initial=0)) < EXACT:
        v, p = vectors.astype(np.float64), places.astype(np.float64)
        return ((v * v).sum(axis=1)[:, None] - 2 * (v @ p.T) + (p * p).sum(axis=1)).astype(np.int64)
    return np.stack([((vectors - place) ** 2).sum(axis=1) for place in places], axis=1)


def expired(cluster: np.ndarray, gap: np.ndarray, drift: np.ndarray) -> np.ndarray:
    """The rows whose gap the drift of their cluster has reached, popped from the clusters' heaps; also rows without a cluster."""
    rows = np.flatnonzero(cluster < 0).tolist()
    for c in range(len(drift)):
        members = np.flatnonzero(cluster == c)
        heap = list(zip(gap[members].tolist(), members.tolist(), strict=True))
        heapq.heapify(heap)
        while heap and heap[0][0] <= drift[c]:
            rows.append(heapq.heappop(heap)[1])
    return np.array(rows, dtype=np.int64)


def assigned(vectors: np.ndarray, cluster: np.ndarray, gap: np.ndarray,
             centroids: Centroids) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest centroid of every vector, the gaps, and the rows that had to be measured."""
    rows = expired(cluster, gap, centroids.drift)
    if not len(rows):
        return cluster, gap, rows
    far = distances(vectors[rows], centroids.places)
    nearest = far.argmin(axis=1)
    upper = np.sqrt(far[np.arange(len(rows)), nearest].astype(np.float64))
    far[np.arange(len(rows)), nearest] = np.iinfo(np.int64).max
    lower = np.sqrt(far.min(axis=1).astype(np.float64))
    cluster, gap = cluster.copy(), gap.copy()
    cluster[rows] = nearest
    gap[rows] = lower - upper - SLACK * (lower + upper) + centroids.drift[nearest]
    return cluster, gap, rows


def whole_vectors(embeddings: DataFrame) -> DataFrame:
    """``vec_id`` and ``vector``, of whole numbers, of the rows that have one."""
    x = F.col("embedding")
    real = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf")))

    def whole(e):
        number = e.cast("double") * SCALE
        too_far = F.raise_error(F.lit(f"a component of {LIMIT} or more after scaling: squared distances exceed a long"))
        return F.when(F.abs(number) < LIMIT, F.floor(number).cast("int")).otherwise(too_far.cast("int"))

    return embeddings.filter((F.size(x) == COMPONENTS) & real).select("vec_id", F.transform(x, whole).alias("vector"))


def first_places(vectors: DataFrame, clusters: int, seed: int) -> np.ndarray:
    """The vectors with the smallest hashes of their ids; the driver holds ``clusters`` of them."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.orderBy(name.asc_nulls_last(), "vector").limit(clusters).collect()
    return np.array([row.vector for row in rows], dtype=np.int64).reshape(len(rows), COMPONENTS)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.int64).reshape(len(column), -1)


def _round(centroids: Centroids, last: bool):
    """One assignment over batches of the state."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            vectors, was = _matrix(batch.column("vector")), np.asarray(batch.column("cluster"))
            cluster, gap, rows = assigned(vectors, was, np.asarray(batch.column("gap")), centroids)
            if last:
                distance = ((vectors - centroids.places[cluster]) ** 2).sum(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(cluster, pa.int32()), pa.array(distance)],
                                                 ["vec_id", "cluster", "distance"])
                continue
            looked = np.zeros(batch.num_rows, bool)
            looked[rows] = True
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("vector"), pa.array(cluster, pa.int32()), pa.array(was, pa.int32()),
                 pa.array(gap), pa.array(looked)], ["vec_id", "vector", "cluster", "was", "gap", "looked"])

    return run


def _changes(state: DataFrame, clusters: int) -> tuple[np.ndarray, list[list[int]]]:
    """What the moved vectors add to each cluster's count and sums; a row for each cluster comes to the driver."""
    moves = F.explode(F.array(F.struct(F.col("cluster").alias("c"), F.lit(1).cast("long").alias("sign")),
                              F.struct(F.col("was").alias("c"), F.lit(-1).cast("long").alias("sign"))))
    moved = state.filter("cluster != was").select(moves.alias("move"), "vector").filter("move.c >= 0")
    sums = [F.sum(F.col("vector")[i] * F.col("move.sign")).alias(f"s{i}") for i in range(COMPONENTS)]
    counts, added = [0] * clusters, [[0] * COMPONENTS for _ in range(clusters)]
    for row in moved.groupBy("move.c").agg(F.sum("move.sign").alias("n"), *sums).collect():
        counts[row.c], added[row.c] = row.n, list(row[2:])
    return counts, added


def clustered(embeddings: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """``vec_id``, ``cluster``, ``distance``, ``cluster_inertia``, ``inertia``, ``centroid_sha256`` of every whole vector."""
    spark = embeddings.sparkSession
    scratch = Scratch(spark, "clusters")
    vectors = whole_vectors(embeddings)
    places = first_places(vectors, clusters, seed)
    if not len(places):
        nothing = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        return spark.createDataFrame([], nothing)
    centroids = Centroids(places, np.zeros(len(places)))
    counts, sums = [0] * len(places), [[0] * COMPONENTS for _ in places]
    state = vectors.withColumn("cluster", F.lit(-1)).withColumn("gap", F.lit(0.0))
    for _ in range(rounds):
        state = scratch.replaced(state.select("vec_id", "vector", "cluster", "gap").mapInArrow(_round(centroids, False), STATE))
        more, added = _changes(state, len(places))
        counts = [a + b for a, b in zip(counts, more, strict=True)]
        sums = [[a + b for a, b in zip(old, new, strict=True)] for old, new in zip(sums, added, strict=True)]
        moved = [[s // n for s in total] if n else old for n, total, old in
                 zip(counts, sums, centroids.places.tolist(), strict=True)]
        centroids = centroids.moved(np.array(moved, dtype=np.int64))
    found = scratch.replaced(state.select("vec_id", "vector", "cluster", "gap").mapInArrow(_round(centroids, True), FOUND))
    inertia = {row.cluster: row.inertia for row in
               found.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}
    names = [hashlib.sha256(",".join(map(str, place)).encode()).hexdigest() for place in centroids.places.tolist()]
    told = [(c, own, sum(inertia.values()), names[c]) for c, own in sorted(inertia.items())]
    of_cluster = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(sized(of_cluster, clusters), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
