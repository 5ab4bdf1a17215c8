"""Centroid clustering against plain rounds: exact distances, ties, repeats, odd vectors, many trees."""

import hashlib
import random

import numpy as np
import pytest

from sparkweft.llm import balltree

COLUMNS = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def plain(rows, dim=64, k=16, rounds=3):
    """Python integers all the way."""
    kept = [(i, [int(np.floor(64 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    if not kept:
        return []
    key = lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1])
    centroids = [v for _, v in sorted(kept, key=lambda r: key(r) if r[0] is not None else (True, "", r[1]))[:k]]
    away = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda v: min((away(v, c), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        of = [nearest(v)[1] for _, v in kept]
        for j in range(len(centroids)):
            mine = [v for (_, v), c in zip(kept, of, strict=True) if c == j]
            if mine:
                centroids[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    out = [(i, *nearest(v)[::-1]) for i, v in kept]
    total = sum(d for *_, d in out)
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return [(i, c, d, sum(y for _, x, y in out if x == c), total, digest[c]) for i, c, d in out]


def same(df, rows, **x):
    assert df.columns == COLUMNS
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, plain(rows, **x)))


def test_against_plain(spark):
    rnd = random.Random(5)
    base = [[rnd.gauss(0, 1) for _ in range(64)] for _ in range(40)]
    near = lambda v, s: [x + rnd.gauss(0, s) for x in v]
    rows = [(i, near(base[i % 40], 0.05)) for i in range(300)]
    rows += [(300 + i, base[0]) for i in range(150)]  # copies: a third of all
    rows += [(7, base[1]), (7, base[1]), (None, base[2]), (None, base[2]), (None, base[3])]
    rows += [(600, None), (601, []), (602, [1.0] * 63), (603, [1.0] * 63 + [None]), (604, [float("nan")] * 64), (605, [float("inf")] + [0.0] * 63), (606, [0.0] * 64), (607, [-0.001] * 64), (608, [16000.0] * 64), (609, [-16000.0] * 64)]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id bigint, embedding array<double>, cluster int, id string").repartition(3)
    same(balltree.cluster(df), rows)
    same(balltree.cluster(df, tree_bytes=1), rows)
    same(balltree.cluster(df, k=40, rounds=1), rows, k=40, rounds=1)


def test_ties_and_few_vectors(spark):
    """On a grid most distances are tied; equal centroids leave the later one empty."""
    rows = [(i, [float(i % 3), float(i // 3 % 3)]) for i in range(90)]
    df = spark.createDataFrame(rows, "vec_id int, embedding array<float>")
    same(balltree.cluster(df, dim=2), rows, dim=2)
    for n in (0, 1, 5):
        same(balltree.cluster(df.where(df.vec_id < n), dim=2), rows[:n], dim=2)
    assert balltree.cluster(df).count() == 0


def test_whole_balls_are_assigned():
    """Well apart, no leaf is looked at; a tree's balls add up to its points."""
    rnd = np.random.default_rng(1)
    points = np.concatenate([rnd.integers(-20, 20, (200, 8)) + 5000 * c for c in range(4)])
    tree, order = balltree.Tree.grow(points)
    assert sorted(order) == list(range(800)) and (tree.points == points[order]).all()
    for low, n, radius, sums in zip(tree.first, tree.count, tree.radius, tree.sums, strict=True):
        mine = tree.points[low : low + n]
        assert (mine.sum(axis=0) == sums).all() and (np.sqrt(balltree.squared(mine, (sums // n)[None, :])) <= radius).all()
    found = list(tree.assigned(np.array([[5000 * c] * 8 for c in range(4)])))
    assert all(isinstance(c, int) for _, c in found) and sum(tree.count[b] for b, _ in found) == 800 and len(found) < 16


def test_distances_are_exact_beyond_doubles():
    most = balltree.LARGEST
    a, b = np.array([[most, most - 1, -most]]), np.array([[-most, most, most - 3], [most, most, most]])
    assert balltree.squared(a, b).tolist() == [[sum((int(x) - int(y)) ** 2 for x, y in zip(a[0], c, strict=True)) for c in b]]


def test_too_large_is_refused(spark):
    df = spark.createDataFrame([(1, [1e30] * 64)], "vec_id bigint, embedding array<double>")
    with pytest.raises(Exception, match="beyond"):
        balltree.cluster(df).collect()
    with pytest.raises(ValueError, match="beyond"):
        balltree.cluster(df, k=1 << 20)
