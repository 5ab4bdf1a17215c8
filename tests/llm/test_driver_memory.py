"""What the driver holds: the training matrix of language ID, plans and shuffles of jobs of many steps."""

import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from sparkweft.llm import common, langid, linededup, simhash


def test_training_rows_are_held_as_one_matrix(spark, monkeypatch):
    rows = 2000
    docs = spark.range(rows).select(F.col("id").alias("doc_id"), F.concat(F.lit("some words "), F.sha2(F.col("id").cast("string"), 256)).alias("text"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("lang"))
    seen = {}

    def fit(x, labels):
        seen.update(peak=tracemalloc.get_traced_memory()[1], x=x, labels=labels)

    monkeypatch.setattr(langid, "fit", fit)
    tracemalloc.start()
    try:
        langid.train(docs)
    finally:
        tracemalloc.stop()
    assert seen["x"].dtype == np.float32 and len(seen["x"]) == len(seen["labels"]) > 1800
    assert seen["peak"] < 1.4 * seen["x"].nbytes + 8e6  # twice that and more when rows were joined, ordered and widened as copies


def test_confirmations_read_distinct_sets_from_a_table(spark, monkeypatch):
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(words), " ".join([*words[:-1], "end"]), " ".join(words), "quite another text of a few words"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    given = []

    def maybe_in(rows, column, keys, key, flag, real=common.maybe_in):
        if column == "n":
            given.append(rows._jdf.queryExecution().optimizedPlan().toString())
        return real(rows, column, keys, key, flag)

    monkeypatch.setattr(common, "maybe_in", maybe_in)
    monkeypatch.setattr(simhash, "fingerprint", lambda h, lanes: bytes(8 * lanes))  # all meet in one block
    got = {r.doc_id: r.component_id for r in simhash.near_components(docs).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3}
    assert given and not any("Join" in p or "Union" in p for p in given)


def test_every_written_step_lets_go(spark, monkeypatch):
    steps = []
    monkeypatch.setattr(common, "let_go", lambda s: steps.append(s))
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "a bigint, b bigint")
    roots = common.connected_components(edges, few=4)
    assert {r.root for r in roots.collect()} == {roots.first().root} and len(steps) > 3
    steps.clear()
    docs = spark.createDataFrame([(i, "a line that is long enough to be a key of forty") for i in range(6)], "doc_id bigint, text string")
    kept = {r.doc_id: r.n_dropped for r in linededup.dedup_lines(docs).collect()}
    assert kept == {i: int(i < 5) for i in range(6)} and len(steps) > 4
