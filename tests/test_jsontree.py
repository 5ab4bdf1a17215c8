"""Relational deep merge against the plain one: random trees, conflicts, depth, odd texts."""

import json
import random

import pytest
from pyspark.sql import functions as F

from sparkweft.operators import jsontree, merge

NAMES = ["a", "b", "a.b", "é", "\u0000", '"', "\\", "", "\ud800", "a\u0001", "\U0001f600"]


def tree(rnd, depth):
    if depth == 0 or rnd.random() < 0.25:
        return rnd.choice([1, 1.0, True, None, "x", "é\n", [], [1, {"a": {}}], {}, ["x", "y"], "\ud800", 10**30, 1.5e-7])
    return {rnd.choice(NAMES): tree(rnd, depth - 1) for _ in range(rnd.randint(0, 4))}


def table(spark, docs):
    return spark.createDataFrame(list(enumerate(docs)), "k int, doc string")


@pytest.mark.parametrize("union", [(), (("a", "b"), ("a",), ("a.b",))])
def test_random_trees(spark, union):
    rnd = random.Random(3)
    pairs = [({rnd.choice(NAMES): tree(rnd, 4) for _ in range(4)}, {rnd.choice(NAMES): tree(rnd, 4) for _ in range(3)}) for _ in range(400)]
    b, o = (table(spark, [json.dumps(p[i], indent=rnd.choice([None, 2])) for p in pairs]) for i in (0, 1))
    got = {r.k: r for r in jsontree.merge_documents(b, o, "k", "doc", union).collect()}
    assert len(got) == len(pairs)
    for k, (x, y) in enumerate(pairs):
        want = merge.merge_values(x, y, frozenset(union), "host")
        assert json.loads(got[k].doc) == want and repr(json.loads(got[k].doc, object_pairs_hook=sorted_pairs)) == repr(json.loads(json.dumps(want), object_pairs_hook=sorted_pairs))
        if not union:
            assert got[k].outcome == ("current" if repr(json.loads(json.dumps(want), object_pairs_hook=sorted_pairs)) == repr(json.loads(json.dumps(x), object_pairs_hook=sorted_pairs)) else "merged")


def sorted_pairs(pairs):
    return dict(sorted(pairs))


def test_depth(spark):
    """5,000 levels, both sides at the bottom, and a cut half-way down."""
    deep = lambda n, inner: '{"a":' * n + inner + "}" * n
    b = table(spark, [deep(5000, '{"x":1}'), deep(5000, '{"x":1}'), deep(5000, "1")])
    o = table(spark, [deep(5000, '{"y":2}'), deep(2500, "7"), deep(10, "{}")])
    got = {r.k: (r.doc, r.outcome) for r in jsontree.merge_documents(b, o, "k", "doc").collect()}
    assert got == {0: (deep(5000, '{"x":1,"y":2}'), "merged"), 1: (deep(2500, "7"), "merged"), 2: (deep(5000, "1"), "current")}
    same = spark.createDataFrame([(deep(5000, '{"x":1}'), deep(5000, '{"y":2}')), (deep(100_000, "1"), "{}")], "b string, o string").select(merge.merge_outcome(F.col("b"), F.col("o")).alias("m")).collect()
    assert same[0].m.doc.replace(" ", "") == deep(5000, '{"x":1,"y":2}') and same[1].m.outcome == "rejected"


def test_odd_texts(spark):
    texts = [None, "", " \n", "{}", "[]", "1", "{", '{"a":1,}', '{"a" 1}', '{"a":1}x', '{"a":NaN}', '{"a":01}', '{"a":1}{}', '{"a":1,"a":2}', '{"a":[1,}', '{"a":[1 2]}', '{"a":"\n"}', '{"a":"\\x"}', '{"a":tru}', '{"a":truex}', '{1:2}', ' { "a" : [ ] } ', '{"a":1e400}', "]", "{]"]
    got = {r.k: (r.doc, r.outcome) for r in jsontree.merge_documents(table(spark, texts), table(spark, ["{}"] * len(texts)), "k", "doc").collect()}
    good = {None: "{}", "": "{}", " \n": "{}", "{}": "{}", ' { "a" : [ ] } ': '{"a":[ ]}', '{"a":1e400}': '{"a":1e400}'}
    assert got == {i: (good[t], "current") if t in good else (None, "rejected") for i, t in enumerate(texts)}
    again = {r.k: r.outcome for r in jsontree.merge_documents(table(spark, ["{}"] * len(texts)), table(spark, texts), "k", "doc").collect()}
    assert {i for i, o in again.items() if o == "rejected"} == {i for i, t in enumerate(texts) if t not in good}


def test_one_side_only(spark):
    b, o = table(spark, ['{"a":1}', '{"b":{}}']), table(spark, [None, '{"b":1}', '{"c":{"d":[]}}'])
    got = {r.k: (r.doc, r.outcome) for r in jsontree.merge_documents(b, o, "k", "doc").collect()}
    assert got == {0: ('{"a":1}', "current"), 1: ('{"b":1}', "merged"), 2: ('{"c":{"d":[]}}', "merged")}
    assert jsontree.merge_documents(b.limit(0), o.limit(0), "k", "doc").count() == 0


def test_texts_are_read_once_for_a_pair(spark):
    """Keys with the same two texts share a merge, no text is read in two branches of the plan, and every key has its row."""
    b = spark.range(900).select("id", F.when(F.col("id") % 3 == 0, '{"a":{"x":1}}').when(F.col("id") % 3 == 1, " ").alias("doc"))
    o = spark.range(300, 1200).select("id", F.when(F.col("id") % 2 == 0, '{"a":2}').otherwise("[").alias("doc"))
    out = jsontree.merge_documents(b, o, "id", "doc")
    assert out._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    (read,) = [f for f in out.inputFiles() if "/pairs-" in f][:1]
    assert spark.read.parquet(read.rsplit("/", 1)[0]).count() == 9  # "", " " and the object with "", {"a":2} and "["
    got = {r.id: (r.doc, r.outcome) for r in out.collect()}
    assert len(got) == 1200
    for i in range(1200):
        has, over = i < 900 and i % 3 == 0, i >= 300
        want = (None, "rejected") if over and i % 2 else ('{"a":2}', "merged") if over else ('{"a":{"x":1}}', "current") if has else ("{}", "current")
        assert got[i] == want


def test_what_cannot_be_written_is_rejected(spark):
    for text in ('{"a":NaN}', '{"a":1e400}', '{"a":-Infinity}'):
        assert spark.range(1).select(merge.merge_outcome(F.lit(text), F.lit("{}")).alias("m")).first().m.outcome == "rejected"


def test_rows_with_both_texts(spark):
    """Every row has its merge, with repeated and missing keys, and no shuffle of the rows; columns may be named like the operator's own."""
    rows = spark.range(0, 3000, 1, 4).select(F.when(F.col("id") % 10 > 0, F.col("id") % 7).alias("base"), F.when(F.col("id") % 2 == 0, '{"a":{"x":1}}').alias("b"), F.when(F.col("id") % 3 == 0, '{"a":2}').when(F.col("id") % 3 == 1, "[").alias("pair"), "id")
    out = jsontree.merge_texts(rows, F.col("b"), F.col("pair"), ["base", "id"])
    assert "Exchange hash" not in out._jdf.queryExecution().toString() and out.columns == ["base", "id", "doc", "outcome"]
    got = {r.id: r for r in out.collect()}
    assert len(got) == out.count() == 3000
    for i, r in got.items():
        want = (None, "rejected") if i % 3 == 1 else ('{"a":2}', "merged") if i % 3 == 0 else ('{"a":{"x":1}}', "current") if i % 2 == 0 else ("{}", "current")
        assert (r.base, r.doc, r.outcome) == (i % 7 if i % 10 else None, *want)


def test_many_pairs_are_joined_by_their_texts(spark):
    """The same without a broadcast, and with a pair that nearly all rows have."""
    rows = spark.range(2000).select("id", F.concat(F.lit('{"k":'), F.greatest("id", F.lit(1900)).cast("string"), F.lit("}")).alias("b"))
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = {r.id: (r.doc, r.outcome) for r in jsontree.merge_texts(rows, F.col("b"), F.lit('{"n":[]}'), ["id"]).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert got == {i: (f'{{"k":{max(i, 1900)},"n":[]}}', "merged") for i in range(2000)}


def test_literal_with_repeated_ids(spark, tmp_path):
    """The query keeps rows with equal, negative and missing ids, as its SQL does."""
    import duckdb

    from sparkweft.plans import reference

    ids = [*range(9), *range(6), -1, -2, -3, None]
    spark.createDataFrame([(i, f'{{"k": {k}}}') for k, i in enumerate(ids)], "event_id bigint, props string").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    want = duckdb.sql(reference.ORACLES["json_literal"].replace("FROM events", f"FROM '{tmp_path}/events.parquet/*.parquet'")).fetchall()
    got = [tuple(r) for r in reference.QUERIES["json_literal"](spark, str(tmp_path)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and len(got) == len(ids)
