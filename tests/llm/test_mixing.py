"""Mixing against a plain solution: sizes, targets, rates, whole copies, hot groups, odd rows, reruns."""

import collections
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from sparkweft.llm import mixing

SCHEMA = "doc_id bigint, text string, source string, size int, no string"


def sizes_of(rows):
    return [(k, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for k, t, s in rows]


def plain_targets(total_of, weights=(5, 2, 1), percent=150, most=2):
    order = sorted(total_of, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, capped = sum(total_of.values()) * percent / 100, set()
    while True:
        share = (left - sum(most * total_of[s] for s in capped)) / (sum(w for s, w in weight.items() if s not in capped) or 1)
        above = {s for s in order if s not in capped and weight[s] * share > most * total_of[s]}
        if not above:
            return {s: most * total_of[s] if s in capped else weight[s] * share for s in order}
        capped |= above


def plain_rates(sizes, target, most=2):
    """Halving the bracket alone."""
    words = lambda lam: sum(z * min(most, math.exp(min(lam * z, 700))) for z in sizes)
    low, high = -50.0, 50.0
    for _ in range(300):
        middle = (low + high) / 2
        low, high = (middle, high) if words(middle) < target else (low, middle)
    return low


def check(spark, rows, near=None, **x):
    df = spark.createDataFrame([(*r[:2], r[2], 9, "x") for r in rows], SCHEMA).repartition(4)
    out = mixing.mix(df, **x)
    assert out.columns == ["doc_id", "size", "source_size", "target", "rate", "copies", "taken"]
    got, sized, most = out.collect(), sizes_of(rows), x.get("most", 2)
    total = collections.Counter()
    for _, s, z in sized:
        total[s] += z
    want = plain_targets(total, **x)
    source = collections.defaultdict(set)
    for k, s, z in sized:
        source[k, z].add(s)
    assert sorted((str(r.doc_id), r.size) for r in got) == sorted((str(k), z) for k, _, z in sized)
    taken, least = collections.Counter(), {s: min([z for _, t, z in sized if t == s and z] or [0]) for s in total}
    for r in got:
        s = next(t for t in source[r.doc_id, r.size] if r.source_size == total[t])
        assert r.target == pytest.approx(want[s], rel=1e-9) and r.taken == r.copies * r.size and 0 <= r.copies <= most
        taken[s] += r.taken
    for s in total:
        assert abs(taken[s] - want[s]) <= (near or max(least[s], 1) + 0.002 * want[s]), (s, taken[s], want[s])
    return got, want


def test_against_plain(spark):
    rnd = random.Random(2)
    rows = [(i, " ".join(["w"] * max(1, int(rnd.lognormvariate(3, 1)))), f"s{i % 7}") for i in range(700)]
    rows += [(1000 + i, "same words\tin\n all of these", "hot") for i in range(3000)]
    rows += [(None, "no id", "hot")] * 900 + [(5000, "equal rows", "s1")] * 40
    rows += [(6000, None, "s2"), (6001, "", "s2"), (6002, " \n\t", None), (6003, "a null source", None), (6004, " x y", None), (6005, None, "empty"), (6006, "é", "Z"), (6007, "w " * 9000, "\U0001f600")]
    got, want = check(spark, rows, near=12)
    of = collections.defaultdict(list)
    for k, s, z in sizes_of(rows):
        of[s].append(z)
    source = {k: s for k, _, s in rows}
    for s in ("s0", "s3", "s4"):
        if want[s] < 2 * sum(of[s]):
            lam = plain_rates(of[s], want[s])
            assert all(r.rate == pytest.approx(min(2, math.exp(lam * r.size)), rel=1e-3) for r in got if source[r.doc_id] == s and r.size)
    again, _ = check(spark, rows[::-1], near=12)
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    assert len({r.copies for r in got if r.doc_id and 1000 <= r.doc_id < 4000}) == 2


@pytest.mark.parametrize("x", [{}, {"percent": 1}, {"percent": 60, "weights": (1,)}, {"percent": 250}, {"percent": 199.9}, {"weights": (1000, 1), "most": 5}])
def test_other_shares(spark, x):
    rnd = random.Random(4)
    rows = [(i, "w " * rnd.choice([1, 2, 3, 5, 8, 40, 400]), rnd.choice("abcd")) for i in range(600)]
    check(spark, rows, **x)


def test_few_rows(spark):
    for rows in ([], [(1, None, None)], [(1, "", "a"), (2, None, "b")], [(1, "one", "a")], [(1, "one", "a"), (1, "one", "a")]):
        df = spark.createDataFrame([(*r, 9, "x") for r in rows], SCHEMA)
        got = mixing.mix(df).collect()
        assert len(got) == len(rows) and sum(r.taken for r in got) in (0, 1, 2, 3)


def test_only_functions(spark):
    """Neither the plan nor any table written on the way has Python in it."""
    df = spark.createDataFrame([(1, "a b c", "s", 1, "y"), (2, "d", "t", 1, "y")], SCHEMA)
    plan = mixing.mix(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_classes_are_bounded(spark):
    top = lambda z: spark.range(1).select(mixing.size_class(F.lit(z)).alias("c")).first().c
    assert [top(z) for z in (0, 1, 4095, 4096, 4097, 8191, 8193, 1 << 40)] == [0, 1, 4095, 4096, 4096, 8190, 8192, 1 << 40]


def test_numbers_and_repeats(spark):
    names = [None, "", "a", "B", "\ue000", "\U0001f600", "é", *(f"s{i:03}" for i in range(90))]
    got = dict(map(tuple, mixing.numbered(spark.createDataFrame([(x,) for x in names], "s string").repartition(5), "s", "no").collect()))
    assert [x for x, _ in sorted(got.items(), key=lambda r: r[1])] == sorted(names[1:], key=lambda x: x.encode()) + [None]
    docs = spark.createDataFrame([(1, "a", 7), (2, "b", 7), (3, "c", 7)], "doc_id bigint, text string, copy int")
    mixed = spark.createDataFrame([(1, 2), (2, 0), (3, 1)], "doc_id bigint, copies bigint")
    assert sorted(map(tuple, mixing.repeated(docs, mixed).collect())) == [(1, "a", 1), (1, "a", 2), (3, "c", 1)]
