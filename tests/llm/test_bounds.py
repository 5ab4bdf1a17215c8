"""Bounds of samples, names of columns, plans, and the pipeline against a plain run."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import DATA, TEXTS, docs_of, plain_line_dedup, plain_tiles

from sparkweft.llm import ann, chat, common, decontam, langid, linededup, queries, simhash, warc


def test_language_sample_is_bounded(spark, monkeypatch):
    """Rows without id, rows of one id and equal rows come to the driver no more often than others."""
    seen = []
    real = langid.fit
    monkeypatch.setattr(langid, "fit", lambda x, labels: seen.append(labels) or real(x, labels))
    for rows in ([(None, f"text number {i}", "ab"[i % 2]) for i in range(3000)], [(7, f"text {i // 3}", "ab"[i % 2]) for i in range(3000)], [(None, "the same text", "a")] * 3000):
        langid.train(spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(4), per_language=50)
        counts = {v: seen[-1].count(v) for v in set(seen[-1])}
        assert max(counts.values()) <= 50 and (rows[0][1] == "the same text" or min(counts.values()) == 50)


def test_nearest_samples_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(ann, "PART_SAMPLE", 100)
    monkeypatch.setattr(ann, "LEAF_ROWS", 4)
    sizes = []
    real = ann.learn
    monkeypatch.setattr(ann, "learn", lambda x, *a: sizes.append(len(x)) or real(x, *a))
    rng = np.random.default_rng(0)
    rows = [(1 if i % 2 else i, [float(x) for x in rng.normal(size=8)]) for i in range(2000)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = ann.search(df, F.expr("vec_id % 20 = 0"), k=5).collect()
    assert len(got) == 5 * sum(1 for k, _ in rows if k % 20 == 0) and sizes[0] == 2000


def test_language_decoding_against_plain(spark):
    """Loss-weighted decoding, bit by bit and language by language."""
    d = spark.read.parquet(f"{DATA}/documents.parquet")
    model = langid.train(d)
    got = {r.doc_id: r for r in langid.predict(d, model, ["doc_id"]).collect()}
    for r in d.where("doc_id % 9 = 0").collect():
        x = langid.features((r.text or "").encode())
        out = [float(sum(float(a) * float(b) for a, b in zip(x, model.weights[:, j], strict=True)) + float(model.bias[j])) for j in range(model.code.shape[1])]
        loss = [sum(float(model.trust[i, j]) * math.log1p(math.exp(-int(model.code[i, j]) * out[j])) for j in range(len(out))) for i in range(len(model.languages))]
        share = [math.exp(-v) / sum(math.exp(-w) for w in loss) for v in loss]
        best = max(range(len(share)), key=share.__getitem__)
        assert got[r.doc_id].lang_pred == model.languages[best] and got[r.doc_id].score == pytest.approx(share[best], rel=1e-3)
        assert got[r.doc_id].ambiguous == (got[r.doc_id].score < langid.AMBIGUOUS)


def test_columns_named_like_the_own(spark):
    line = "a line of more than forty characters that all hold"
    names = ["__may", "__lines", "__key", "__doc", "__mark", "__gone", "__bucket", "__bits", "__MAY_1", "h1", "pos", "mark", "last"]
    df = spark.createDataFrame([(i, f"{line}\nown {i}", *names) for i in range(6)], f"doc_id bigint, text string, {', '.join(f'`{n}` string' for n in names)}")
    got = linededup.dedup_lines(df)
    assert got.columns == [*df.columns, "n_lines", "n_dropped"]
    assert all([r[n] for n in names] == names and r.text == (f"{line}\nown 5" if r.doc_id == 5 else f"own {r.doc_id}") for r in got.collect())
    model = langid.train(spark.createDataFrame([(1, "der Hund", "de"), (2, "the dog", "en")], "doc_id int, text string, lang string"))
    odd = spark.createDataFrame([(1, "der Hund", "x", "y")], "doc_id int, text string, __text string, __text_1 string")
    for keep in (["__text", "doc_id"], ["__text", "__text_1"], ["__text", "text", "doc_id"]):
        told = langid.predict(odd, model, keep)
        assert told.columns == [*keep, "lang_pred", "score", "ambiguous"] and told.first()["__text"] == "x"


def test_runs_leave_no_table(spark, monkeypatch):
    before = spark.sql("SHOW TABLES").count()
    real, calls = linededup.Runs._put, []

    def fails(self, table, level):
        calls.append(table)
        if len(calls) == 2:
            raise OSError("lost")
        return real(self, table, level)

    monkeypatch.setattr(linededup.Runs, "_put", fails)
    with pytest.raises(OSError, match="lost"):
        linededup.dedup_lines(docs_of(spark, [(i, f"line {i} of more than forty characters, all in all") for i in range(50)]))
    assert spark.sql("SHOW TABLES").count() == before


def test_rejoining_moves_no_archive(spark, monkeypatch):
    """No exchange by file or by split carries texts, and a payload of many marks over many splits comes back."""
    inner = "".join(f"WARC/1.0\r\nContent-Length: {i % 50}\r\n\r\nbody {i}\r\n\r\n" for i in range(3000))
    pages = spark.createDataFrame([(1, "u", inner), (2, "v", "plain"), (3, "w", "x" * 300_000 + inner)], "page_id bigint, url string, html string").coalesce(1)
    path = common.fresh_path(spark, "w")
    warc.write_archives(pages, path)
    plans = []
    real = warc._rejoined
    monkeypatch.setattr(warc, "_rejoined", lambda *a: plans.append(real(*a)) or plans[-1])
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = {r.page_id: (r.payload_bytes, r.verified) for r in warc.records(spark, path).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == {r.page_id: (len(r.html), True) for r in pages.collect()}
    text = plans[0]._jdf.queryExecution().explainString(plans[0].sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    for node in re.split(r"\n\n+", text):
        if re.search(r"^\(\d+\) (Exchange|Window|Sort)\b", node) and "value#" in node:
            raise AssertionError(node)


def near_roots(rows):
    """doc_id of the smallest id of each row's near copies, by all pairs that share a shingle."""
    sets = [frozenset(np.unique(simhash.shingle_hashes((t or "").encode(), 5)).tolist()) for _, t in rows]
    root, where, met = list(range(len(rows))), {}, {}
    for i, x in enumerate(sets):
        for y in x:
            for j in where.setdefault(y, []):
                met[i, j] = met.get((i, j), 0) + 1
            where[y].append(i)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = [p for p, both in met.items() if 5 * both >= 4 * (len(sets[p[0]]) + len(sets[p[1]]) - both)]
    for i, j in links + [(i, sets.index(x)) for i, x in enumerate(sets) if not x]:
        p, q = find(i), find(j)
        root[max(p, q)] = min(p, q)
    return [rows[find(i)][0] for i in range(len(rows))]


def test_pipeline_against_plain(spark):
    """All five stages on whole small tables, every one but the classifier in plain Python."""
    from tokenizers import Tokenizer

    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = langid.train(docs.where(~langid.held_out()))
    told = langid.predict(docs, model, ["doc_id", "text"]).collect()
    rows = [(r.doc_id, r.text) for r in told if r.lang_pred != "und" and not r.ambiguous]
    rows = sorted((k, t) for k, _, _, t in plain_line_dedup(rows, 40, 5))
    rows = [r for r, first in zip(rows, near_roots(rows), strict=True) if r[0] == first]
    items = [decontam.words(r.text.encode()) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]

    def leaks(text):
        doc = decontam.words(text.encode())
        five = {*zip(*[doc[s:] for s in range(5)], strict=False)}
        return any(five & {*zip(*[x[s:] for s in range(5)], strict=False)} and 2 * sum(plain_tiles(doc, x, 5)) >= len(x) for x in items)

    rows = [(k, t) for k, t in rows if not leaks(t)]
    tok = Tokenizer.from_file(queries.vocabulary("word_bpe_49k.json"))
    want = {k: tok.encode(t, add_special_tokens=False).ids for k, t in rows}
    got = pipeline.run(spark, DATA)
    ids = next(c for c, kind in got.dtypes if kind.startswith("array<"))
    assert {r.doc_id: list(r[ids]) for r in got.collect()} == want and 0 < len(want) < docs.count()


def test_texts_with_odd_rows_pass(spark):
    model = langid.train(docs_of(spark, TEXTS).withColumn("lang", F.lit("en")))
    assert langid.predict(docs_of(spark, TEXTS), model, ["doc_id"]).count() == len(TEXTS)


def test_chat_ties(spark):
    """Two rows of one turn go by role, then text; the formatted text is as long as its turns say."""
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "assistant", "z"), (1, 0, "user", None), (1, 0, "user", "a")]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    r = chat.format_conversations(df).first()
    assert chat.read_turns(r.formatted) == [("assistant", "z"), ("user", ""), ("user", "a"), ("user", "a"), ("user", "b")]
    assert chat.read_back(chat.format_conversations(df)).first().formatted_chars == len(r.formatted)


def test_nearest_repeated_ids(spark):
    """Rows that share an id are candidates each, but never for a query of that id."""
    df = spark.createDataFrame([(20, [1.0, 0.0]), (20, [0.9, 0.0]), (1, [0.5, 0.0]), (1, [0.5, 0.0]), (2, [-1.0, 0.0])], "vec_id bigint, embedding array<double>")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in ann.search(df, F.expr("vec_id % 20 = 0"), k=20).collect())
    assert {x[2] for x in got} == {1, 2} and [x[3] for x in got if x[2] == 1][:2] == [0.5, 0.5]


def test_all_sql_of_the_subpackage(spark):
    import os

    import duckdb

    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DATA}/{f}'")
    for name, sql in queries.ORACLES.items():
        df = queries.QUERIES[name](spark, DATA)
        want = c.sql(sql)
        cols = sorted(df.columns)
        assert cols == sorted(want.columns), name
        at = [want.columns.index(x) for x in cols]
        assert sorted(repr(tuple(r[x] for x in cols)) for r in df.collect()) == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall()), name


def test_near_dedup_lets_go_of_its_steps(spark):
    """The driver collects the handles of shuffles and broadcasts while steps are written, not only when its heap is full."""
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    whole = lambda: sum(b.getCollectionCount() for b in beans if re.search("Old|MarkSweep", b.getName()))
    before = whole()
    got = simhash.near_components(docs_of(spark, [(i, f"a b c d e f {i // 2}") for i in range(6)])).collect()
    assert whole() - before >= 10 and {r.doc_id: r.component_id for r in got} == {i: i // 2 * 2 for i in range(6)}
