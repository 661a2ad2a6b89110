"""Centroid clustering against plain rounds over all vectors."""

import hashlib
import math
import random

import numpy as np
import pytest

from ledgerline.llm import centroids
from ledgerline.llm.common import ship

SCHEMA = "vec_id long, embedding array<float>, cluster string, distance int, vector int"


def brute(rows, clusters=40, rounds=5, seed=2):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows
            if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    places = [v for _, v in order[:clusters]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for r in range(rounds + 1):
        near = [min((far(v, p), c) for c, p in enumerate(places)) for _, v in kept]
        if r < rounds:
            for c in range(len(places)):
                own = [v for (_, v), (_, n) in zip(kept, near, strict=True) if n == c]
                if own:
                    places[c] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    sums = [sum(d for d, n in near if n == c) for c in range(len(places))]
    names = [hashlib.sha256(",".join(map(str, p)).encode()).hexdigest() for p in places]
    return [(i, c, d, sums[c], sum(sums), names[c]) for (i, _), (d, c) in zip(kept, near, strict=True)]


def found(spark, rows, **options):
    ship(spark)
    df = spark.createDataFrame([(i, v, "x", 1, 2) for i, v in rows], SCHEMA)
    return [tuple(r) for r in centroids.clustered(df, **options).collect()]


def vectors(count, seed, spread=3):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(5, 64))
    return [[float(np.float32(x)) for x in middles[i % 5] + rng.normal(size=64) / spread] for i in range(count)]


@pytest.fixture(scope="module")
def rows():
    v = vectors(90, 1)
    odd = [None, [], v[0][:63], v[0] + [0.0], [*v[0][:63], None], [*v[0][:63], math.nan], [*v[0][:63], math.inf], [0.0] * 64]
    return list(enumerate(v)) + [(200 + i, x) for i, x in enumerate(odd)] + [(7, v[7]), (7, v[7]), (None, v[3])] + [(300 + i, v[1]) for i in range(40)]


def test_equal_to_plain_rounds(spark, rows):
    assert sorted(map(repr, found(spark, rows))) == sorted(map(repr, brute(rows)))
    assert sorted(map(repr, found(spark, rows, clusters=3, rounds=2))) == sorted(map(repr, brute(rows, 3, 2)))


def test_few_and_no_vectors(spark, rows):
    assert found(spark, []) == [] and found(spark, [(1, None)]) == []
    assert found(spark, rows[:1]) == brute(rows[:1])
    assert sorted(found(spark, rows[:4])) == sorted(brute(rows[:4]))


def test_many_ties_go_to_the_smaller_number(spark):
    rng = random.Random(3)
    grid = [(i, [float(rng.choice((0, 1)))] * 2 + [0.0] * 62) for i in range(60)]
    assert sorted(found(spark, grid)) == sorted(brute(grid))


def test_components_too_large_are_an_error(spark):
    with pytest.raises(Exception, match="exceed a long"):
        found(spark, [(1, [1e30] * 64)])


def test_bounds_skip_most_vectors_and_never_change_the_result():
    whole = np.floor(256 * np.array(vectors(3000, 5, spread=6))).astype(np.int64)
    places, cluster, gap = whole[:5].copy(), np.full(3000, -1), np.zeros(3000)
    now, looked = centroids.Centroids(places, np.zeros(5)), []
    for _ in range(8):
        cluster, gap, rows = centroids.assigned(whole, cluster, gap, now)
        looked.append(len(rows))
        assert (cluster == ((whole[:, None] - now.places) ** 2).sum(axis=2).argmin(axis=1)).all()
        now = now.moved(np.array([whole[cluster == c].sum(axis=0) // max((cluster == c).sum(), 1) for c in range(5)]))
    assert looked[0] == 3000 and looked[1:] == [0] * 7  # one centroid in each of five groups far apart: no gap expires
    places = whole[:8].copy()  # groups with two centroids stay close calls
    now, cluster, gap, looked = centroids.Centroids(places, np.zeros(8)), np.full(3000, -1), np.zeros(3000), []
    for _ in range(8):
        cluster, gap, rows = centroids.assigned(whole, cluster, gap, now)
        looked.append(len(rows))
        assert (cluster == ((whole[:, None] - now.places) ** 2).sum(axis=2).argmin(axis=1)).all()
        now = now.moved(np.array([whole[cluster == c].sum(axis=0) // max((cluster == c).sum(), 1) for c in range(8)]))
    assert looked[0] == 3000 and max(looked[1:]) < 3000


def test_distances_are_exact_for_large_components():
    rng = np.random.default_rng(2)
    for size in (2**8, 2**20, 2**26):
        v, p = (rng.integers(-size, size, (n, 64)) for n in (20, 5))
        want = [[sum((int(x) - int(y)) ** 2 for x, y in zip(a, b, strict=True)) for b in p] for a in v]
        assert centroids.distances(v, p).tolist() == want
