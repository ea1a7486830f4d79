"""Clusters against a plain version; the query itself is compared with its SQL."""

import hashlib
import math

import numpy as np
import pytest
from wikimill.llm import centroids


def plain(rows, how):
    kept = [(i, [math.floor(how.scale * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == how.dim and all(x is not None and math.isfinite(x) for x in v)]
    seeds = sorted((hashlib.sha256(f"{how.seed}:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)
    at = [v for _, v in seeds[:how.k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(at))

    for _ in range(how.rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        for j, vs in groups.items():
            at[j] = [sum(x) // len(vs) for x in zip(*vs, strict=True)]
    found = [(i, *near(v)) for i, v in kept]
    total = {}
    for _, d, j in found:
        total[j] = total.get(j, 0) + d
    return sorted((str(i), j, d, total[j], sum(total.values()), hashlib.sha256(",".join(map(str, at[j])).encode()).hexdigest()) for i, d, j in found)


def rows_of(df):
    return sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect())


SCHEMA = "V string, vec_id long, embedding array<float>, cluster string, pivot int, digest string"


def frame(spark, rows):
    return spark.createDataFrame([("x", i, v, "x", 1, "x") for i, v in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("n", [0, 3, 40, 400])
def test_equals_the_plain_version(spark, n):
    rng = np.random.default_rng(n)
    how = centroids.Clustering(k=5, dim=3, rounds=4, pivots=3)
    rows = [(i, (rng.normal(size=3) * rng.choice([0.02, 1, 50])).round(2).tolist()) for i in range(n)]
    assert rows_of(centroids.cluster_vectors(frame(spark, rows), how)) == plain(frame(spark, rows).select("vec_id", "embedding").collect(), how)


def test_odd_rows_ties_and_copies(spark):
    how = centroids.Clustering(k=4, dim=2, pivots=4)
    rows = [(1, None), (2, []), (3, [1.0]), (4, [1.0, None]), (5, [float("nan"), 0.0]), (6, [float("inf"), 0.0]), (None, [0.5, -0.5]), (None, [0.5, -0.5])]
    rows += [(7, [1.0, 1.0])] * 30 + [(i, [float(i % 3), float(i % 2)]) for i in range(8, 40)] + [(50, [1e6, -1e6])]
    assert rows_of(centroids.cluster_vectors(frame(spark, rows), how)) == plain(rows, how)
    assert rows_of(centroids.cluster_vectors(frame(spark, rows[:6]), how)) == []
    same = [(i, [0.25, 0.25]) for i in range(20)]
    assert rows_of(centroids.cluster_vectors(frame(spark, same), how)) == plain(same, how)


def test_bounds_never_pass_the_distance_and_spare_work():
    rng = np.random.default_rng(1)
    heart = rng.integers(-2000, 2000, (6, 8))
    v = np.concatenate([h + rng.integers(-30, 30, (200, 8)) for h in heart])
    pivots = centroids.Pivots(heart[:4])
    at = heart + rng.integers(-5, 5, heart.shape)
    far = centroids.squared(v, pivots.at)
    low, true = pivots.bounds(far, centroids.squared(at, pivots.at)), centroids.squared(v, at)
    assert (low <= true).all()
    cluster, distance, work = centroids.nearest(v, far, pivots, at)
    assert (cluster == true.argmin(1)).all() and (distance == true.min(1)).all()
    assert work < 0.5 * true.size


def test_components_too_large_raise(spark):
    with pytest.raises(Exception, match="squared distances"):
        centroids.cluster_vectors(frame(spark, [(1, [1e12] * 64)])).collect()
