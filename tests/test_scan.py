"""Segmented scans against windows and plain loops, with nine tenths of the rows under one key."""

import collections
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkweft.functions.scalars import ends_body
from sparkweft.operators import scan, sequence


@pytest.fixture(scope="module")
def skewed(spark):
    rnd = random.Random(7)
    rows = [(rnd.choice([None, 2, 3, 4, 5]) if rnd.random() < 0.1 else 1, i, rnd.choice("aab") if i % 2000 > 700 else "a", rnd.choice("∑∫=xxxx")) for i in range(6000)]
    rows += [(9, 7000, None, "∑"), (9, 7001, None, "="), (10, 7002, "a", "=")]
    return spark.createDataFrame([(*r, "kept", 5, 6) for r in rows], "u int, s int, k string, x string, _run string, _range int, _item int").repartition(6).cache()


def same(a, b):
    assert sorted(map(repr, map(tuple, a.select(sorted(a.columns)).collect()))) == sorted(map(repr, map(tuple, b.select(sorted(b.columns)).collect())))


def test_ranges_are_even(skewed):
    ranges = scan.Ranges(skewed, ["u"], ["s"])
    sizes = [r["count"] for r in ranges.rows.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert sum(sizes) == skewed.count() and max(sizes) <= 2 * sum(sizes) / 8
    rows = ranges.rows.withColumn("n", F.row_number().over(ranges.within)).withColumn("l", F.lag("k").over(ranges.within))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "passthrough" in plan


def test_list_restart(skewed):
    w = Window.partitionBy("u").orderBy("s")
    new = F.when((F.row_number().over(w) > 1) & F.lag("k").over(w).eqNullSafe(F.col("k")), 0).otherwise(1)
    runs = skewed.withColumn("_n", new).withColumn("list_id", (F.sum("_n").over(w) + 99).cast("bigint")).drop("_n")
    want = runs.withColumn("item", F.row_number().over(Window.partitionBy("u", "list_id").orderBy("s")))
    same(sequence.restart_lists(skewed, "u", "s", "k"), want)
    one = skewed.withColumn("k", F.lit("a"))  # a run over all ranges
    assert sequence.restart_lists(one, "u", "s", "k").where("u = 1").agg(F.max("item"), F.max("list_id")).first() == (one.where("u = 1").count(), 100)


def test_operator_bodies(skewed):
    rows = collections.defaultdict(list)
    for r in skewed.collect():
        rows[r.u].append((r.s, r.x))
    want = {}
    for mine in rows.values():
        mine.sort()
        for i, (s, x) in enumerate(mine):
            if x in "∑∫":
                stop = next((j for j in range(i + 1, len(mine)) if mine[j][1] == "="), len(mine))
                want[s] = mine[stop - 1][0] if stop > i + 1 else None
    got = sequence.operator_bodies(skewed, "u", "s", "x").collect()
    assert {r.s: r.body_end for r in got} == want and len(got) == len(want)
    rare = skewed.withColumn("x", F.when(F.col("s") % 4000 == 0, "=").otherwise("∑"))
    last = {u: max(s for s, _ in mine) for u, mine in rows.items()}
    for r in sequence.operator_bodies(rare, "u", "s", "x").where("u = 1 AND s > 4000").collect():
        assert r.body_end == (last[1] if r.s < last[1] else None)


def test_numbers_flags_and_bodies(skewed):
    w = Window.partitionBy("u", "k").orderBy("s")
    same(sequence.number_kinds(skewed, "u", "s", "k"), skewed.withColumn("number", F.row_number().over(w)))
    taken = F.col("x") == "="
    want = skewed.withColumn("number", F.when(taken, F.sum(F.when(taken, 1).otherwise(0)).over(w)).cast("int"))
    same(sequence.number_kinds(skewed, "u", "s", "k", counted=taken), want)
    kinds = skewed.withColumn("k", F.when(F.col("s") % 1500 == 0, "h1").when(F.col("s") % 3100 == 0, "page_break").otherwise("text"))
    before = Window.partitionBy("u").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("k") != "text", F.col("k")), ignorenulls=True).over(before)
    same(sequence.break_flags(kinds, "u", "s", "k"), kinds.withColumn("breaks", (F.col("k") == "h1") & F.coalesce(last == "h1", F.lit(False))))
    marks = skewed.withColumn("k", F.when(F.col("s") % 1900 == 0, "---").otherwise("t"))
    upto = F.sum(F.when(F.col("k") == "---", 1).otherwise(0)).over(Window.partitionBy("u").orderBy("s"))
    same(sequence.body_lines(marks, "u", "s", "k"), marks.withColumn("_m", upto).where("_m = 2 AND k <> '---'").drop("_m"))


def test_running_and_rolling_sums(spark, skewed):
    w = Window.partitionBy("u").orderBy(F.col("s") % 50)
    peers = scan.running_sums(skewed.withColumn("t", F.col("s") % 50), ["u"], ["t"], {"n": F.lit(1), "r": F.col("s")}, peers=True)
    same(peers, skewed.withColumn("t", F.col("s") % 50).withColumn("n", F.sum(F.lit(1)).over(w)).withColumn("r", F.sum("s").over(w)))
    at = skewed.groupBy("u", F.floor(F.col("s") / 3).alias("b")).agg(F.count("*").alias("n"), F.count_if(F.col("x") == "=").alias("bad"))
    got = scan.rolling_sums(at, ["u"], "b", ["n", "bad"], {"short": 4, "long": 100, "none": 0})
    spans = {name: Window.partitionBy("u").orderBy("b").rangeBetween(-span, 0) for name, span in {"short": 4, "long": 100, "none": 0}.items()}
    same(got, at.select("u", "b", *(F.sum(v).over(f).alias(f"{v}_{name}") for name, f in spans.items() for v in ("n", "bad"))))


def test_empty(spark, skewed):
    none = skewed.limit(0)
    assert sequence.restart_lists(none, "u", "s", "k").count() == 0 and sequence.operator_bodies(none, "u", "s", "x").count() == 0
    assert sequence.number_kinds(none, "u", "s", "k").count() == 0


def test_relations_end_bodies(spark):
    assert [r[0] for r in spark.createDataFrame([("=",), ("x",), (None,)], "x string").select(ends_body(F.col("x"))).collect()] == [True, False, False]
