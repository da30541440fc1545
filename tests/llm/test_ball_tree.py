import hashlib
import math

import numpy as np
import pytest

from palimpsest.llm import ball_tree as b


def plain(rows, k, rounds, dims, scale, seed=1):
    """Each vector against each centroid, in Python's own whole numbers."""
    kept = [(i, [math.floor(scale * float(c)) for c in e]) for i, e in rows if e is not None and len(e) == dims and all(c is not None and math.isfinite(c) for c in e)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    centroids = [x for _, x in sorted(kept, key=key)[:k]]

    def nearest(x):
        return min((sum((p - q) ** 2 for p, q in zip(x, c, strict=True)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        groups = {}
        for _, x in kept:
            groups.setdefault(nearest(x)[1], []).append(x)
        centroids = [[sum(c) // len(groups[j]) for c in zip(*groups[j], strict=True)] if j in groups else was for j, was in enumerate(centroids)]
    return [(i, nearest(x)[1], nearest(x)[0]) for i, x in kept], centroids


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    middles = rng.normal(size=(6, 8)) * 3
    x = [(i, (middles[i % 6] + rng.normal(size=8) * 0.2).tolist()) for i in range(2500)]
    x += [(9000 + i, [0.5] * 8) for i in range(700)]  # a hot vector
    x += [(5, x[5][1]), (5, x[5][1]), (None, [0.25] * 8), (None, [0.25] * 8), (7001, None), (7002, []), (7003, [1.0] * 7), (7004, [None] + [1.0] * 7), (7005, [float("nan")] + [1.0] * 7), (7006, [float("-inf")] + [1.0] * 7)]
    return x


SCHEMA = "vec_id long, embedding array<float>"


def test_against_plain(spark, rows):
    single = [(i, None if e is None else [None if c is None else float(np.float32(c)) for c in e]) for i, e in rows]
    for k, rounds, scale in ((5, 3, 64), (16, 2, 64), (3, 1, 1)):
        got, centroids = b.cluster(spark.createDataFrame(rows, SCHEMA).repartition(3), k=k, rounds=rounds, dims=8, scale=scale)
        want, other = plain(single, k, rounds, 8, scale)
        assert centroids.tolist() == other
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_balls_go_whole(rows):
    x = np.floor(np.array([e for i, e in rows[:1024]]) * 64).astype(np.int64)
    order, tree = b.build(x)
    centroids, x = x[:6], x[order]  # one of each cluster
    assert sorted(order.tolist()) == list(range(1024)) and (tree["sums"][0] == x.sum(0)).all()
    for k in range(len(tree["start"])):
        mine = x[tree["start"][k] : tree["end"][k]]
        assert (tree["sums"][k] == mine.sum(0)).all() and tree["radius"][k] >= np.sqrt(((mine - mine.mean(0)) ** 2).sum(1).max())
    whole, places, nearest = b.descend(tree, x, centroids)
    want = b.exact(x, centroids).argmin(1)
    held = np.concatenate([np.arange(tree["start"][n], tree["end"][n]) for n, _ in whole])
    assert sorted([*held.tolist(), *places.tolist()]) == list(range(1024)) and len(held) > 512
    assert all((want[tree["start"][n] : tree["end"][n]] == c).all() for n, c in whole) and (want[places] == nearest).all()


def test_equal_distances_go_to_the_smaller_number():
    x = np.zeros((100, 2), np.int64)
    order, tree = b.build(x)
    whole, places, nearest = b.descend(tree, x, np.array([[5, 0], [0, 5], [-5, 0]]))
    assert not whole and len(places) == 100 and not nearest.any()


def test_odd_tables(spark, rows):
    few = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 4.0])], SCHEMA)
    got, centroids = b.cluster(few, k=16, dims=2)
    assert got.count() == 2 and len(centroids) == 2 and b.with_inertia(got, centroids).first().inertia == 0
    got, centroids = b.cluster(few.limit(0), dims=2)
    assert b.with_inertia(got, centroids).collect() == [] and b.cluster(few, dims=3)[0].collect() == []
    clashing = few.selectExpr("*", "'x' as cluster", "'x' as distance", "'x' as ids", "'x' as points")
    assert b.cluster(clashing, k=2, dims=2)[0].columns == ["vec_id", "cluster", "distance"]
    with pytest.raises(Exception, match="fit a long"):
        b.cluster(spark.createDataFrame([(1, [1e30, 0.0])], SCHEMA), dims=2)[0].collect()
    with pytest.raises(ValueError, match="no column"):
        b.cluster(few.drop("vec_id"))
