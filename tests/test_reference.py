"""Hand cases and properties of the core operators, and every query against its SQL on small tables."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from sparkweft.functions import scalars as S
from sparkweft.operators import merge, report, sequence, sync, textops
from sparkweft.plans import reference
from sparkweft.sources import jsondocs, manifest
from sparkweft.streaming.tally import windowed_tally

DATA = "/root/testdata/sf0.001"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DATA}/{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return v.replace(tzinfo=None).isoformat() if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", sorted(reference.ORACLES))
def test_query_against_sql(spark, duck, name):
    df = reference.QUERIES[name](spark, DATA)
    got = duck.sql(reference.ORACLES[name])
    cols = sorted(df.columns)
    assert cols == sorted(got.columns)
    at = [got.columns.index(c) for c in cols]
    assert sorted(repr(tuple(plain(r[c]) for c in cols)) for r in df.collect()) == sorted(repr(tuple(plain(r[i]) for i in at)) for r in got.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() == 200
    assert set(reference.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize(
    ("base", "overlay", "union", "want"),
    [
        ('{"a":1}', '{"a":null}', [], {"a": None}),
        ('{"a":{"x":1}}', '{"a":5}', [], {"a": 5}),
        ('{"a":{"x":1}}', '{"a":{}}', [], {"a": {"x": 1}}),
        ('{"a":5}', '{"a":{}}', [], {"a": {}}),
        ('{"l":[1]}', '{"l":[2]}', [], {"l": [2]}),
        ('{"l":[1,2]}', '{"l":[3,1]}', ["l"], {"l": [3, 1, 2]}),
        ('{"p":{"l":[true,1.0,"1",{"a":1.0}]}}', '{"p":{"l":[1,{"a":1}]}}', ["p.l"], {"p": {"l": [1, {"a": 1}, "1"]}}),
        ('{"p.l":[1],"p":{"l":[1]}}', '{"p.l":[2],"p":{"l":[2]}}', [("p", "l")], {"p.l": [2], "p": {"l": [2, 1]}}),
        ('{"p.l":[1],"p":{"l":[1]}}', '{"p.l":[2],"p":{"l":[2]}}', [("p.l",)], {"p.l": [2, 1], "p": {"l": [2]}}),
        ("", '{"a":1}', [], {"a": 1}),
    ],
)
def test_deep_merge(spark, base, overlay, union, want):
    import json

    got = one(spark, merge.deep_merge(F.lit(base), F.lit(overlay), union))
    assert json.loads(got) == want
    again = one(spark, merge.deep_merge(F.lit(got), F.lit(overlay), union))
    assert json.loads(again) == want


def test_union_by_text(spark):
    import json

    got = one(spark, merge.deep_merge(F.lit('{"l":[true,1.0,1]}'), F.lit('{"l":[1]}'), ["l"], "text"))
    assert repr(json.loads(got)["l"]) == "[1, True, 1.0]"


def test_merge_outcome(spark):
    for base, overlay, want in [('{"a":1}', '{"a":1}', "current"), ('{"a":1}', "", "current"), ('{"a":1}', '{"a":2}', "merged"), ("", '{"a":2}', "merged"), ("x", "{}", "rejected"), ("{}", "3", "rejected")]:
        assert one(spark, merge.merge_outcome(F.lit(base), F.lit(overlay))).outcome == want


def test_deep_merge_rejects(spark):
    assert one(spark, merge.deep_merge(F.lit("[1]"), F.lit("{}"))) is None
    assert one(spark, merge.deep_merge(F.lit("{"), F.lit("{}"))) is None


def test_sanitize(spark):
    for text, want in [("a — b", "a, b"), ("1—5", "1-5"), ("", ""), (None, None), ("a — b", "a, b"), ("x –y", "x -y")]:
        assert one(spark, S.sanitize_prose(F.lit(text).cast("string"))) == want


def test_widths_and_padding(spark):
    assert one(spark, S.clamp_width(F.lit(None).cast("double"), F.lit(5.0), F.lit(25.0), F.lit(15.0))) is None
    assert one(spark, S.clamp_width(F.lit(99.0), F.lit(5.0), F.lit(25.0), F.lit(15.0))) == 17.0
    rows = F.array(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("c")))
    assert one(spark, S.pad_rows(rows)) == [["a", "b"], ["c", ""]]
    assert abs(one(spark, S.natural_width_cm(F.lit(300), F.lit(300))) - 2.54) < 1e-9
    assert [one(spark, S.combining_accent(F.lit(x))) for x in "^´`˘‾"] == ["\u0302", "\u0301", "\u0300", "\u0306", "‾"]
    assert one(spark, S.large_code(F.lit(40), F.lit(5), F.lit(9), F.lit(None).cast("int"))) == ["params"]


def test_break_flags(spark):
    rows = [(1, 0, "page_break"), (1, 1, "text"), (1, 2, "h1"), (1, 3, "text"), (1, 4, "h1"), (2, 0, "h1")]
    got = sequence.break_flags(spark.createDataFrame(rows, "d int, s int, k string"), "d", "s", "k")
    assert [r.breaks for r in got.orderBy("d", "s").collect()] == [False, False, False, False, True, False]


def test_number_and_body_rules(spark):
    rows = spark.createDataFrame([(1, i, "fig", ok) for i, ok in enumerate([True, False, None, True])], "d int, s int, k string, ok boolean")
    assert [r.number for r in sequence.number_kinds(rows, "d", "s", "k", counted=F.col("ok")).orderBy("s").collect()] == [1, None, None, 2]
    signs = spark.createDataFrame([(1, i, x) for i, x in enumerate("∑a∫b=c∏=∑")], "d int, s int, x string")
    assert [(r.s, r.body_end) for r in sequence.operator_bodies(signs, "d", "s", "x").orderBy("s").collect()] == [(0, 3), (2, 3), (6, None), (8, None)]


def test_nearest_root(spark):
    starts = spark.createDataFrame([("/a/b/c",), ("/a",), ("/",), ("/x/y",)], "p string")
    files = spark.createDataFrame([("/a/b/.git",), ("/a/Makefile",), ("/a/b/c/readme",), ("/q/.git",)], "f string")
    got = dict(map(tuple, sequence.nearest_root(starts, "p", files, F.col("f"), [".git", "Makefile"]).collect()))
    assert got == {"/a/b/c": "/a/b", "/a": "/a", "/": None, "/x/y": None}


def test_manifest_of_a_folder(spark, tmp_path):
    for name in ("agents/a.md", "agents/sub/b.md", "commands/c.md", "skills/s/one.txt", "skills/s/deep/two.txt", "readme.md"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    assert sorted(map(tuple, manifest.scan(spark, str(tmp_path)).collect())) == [("agent", "a", 1), ("command", "c", 1), ("skill", "s", 2)]


def test_nothing_selected(spark):
    none = spark.createDataFrame([], "agent string, scenario string")
    assert report.selection(none).first().outcome == "no scenarios"
    assert report.selection(none, "x").first().outcome == "no match for the filter"


def test_trailing_and_drop(spark):
    assert one(spark, textops.trim_blank_tail(F.lit("a\nb\n\n\n"))) == "a\nb"
    assert one(spark, textops.trim_blank_tail(F.lit("a\n \n"))) == "a\n "
    assert one(spark, textops.drop_lines(F.lit("x\nyz\nx"), ["^y"])) == "x\nx"


def test_body_stops_at_third_mark(spark):
    lines = [(1, i, x) for i, x in enumerate(["---", "n", "---", "a", "---", "b"])]
    assert [r.l for r in sequence.body_lines(spark.createDataFrame(lines, "d int, p int, l string"), "d", "p", "l").collect()] == ["a"]


def test_status_partitions_the_source(spark):
    src = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "d")], "k int, c string")
    dst = spark.createDataFrame([(1, "a"), (2, "x"), (3, None), (9, "z")], "k int, c string")
    assert dict(map(tuple, sync.status(src, dst, "k", "c").collect())) == {1: "identical", 2: "CHANGED", 3: "identical", 4: "NEW"}
    assert {r.k for r in sync.pull(src, dst, "k", "c").collect()} == {1, 2, 3, 4, 9}
    assert sync.has_diff(src.limit(0), dst, "k", "c").first().has_diff is False


def test_folder_fingerprint_sees_renames(spark):
    rows = lambda *x: spark.createDataFrame([("f", *r) for r in x], "d string, p string, c string")
    print_of = lambda df: sync.folder_fingerprint(df, "d", "p", "c").first().fingerprint
    assert print_of(rows(("a", "1"), ("b", "2"))) == print_of(rows(("b", "2"), ("a", "1")))
    assert print_of(rows(("a", "1"), ("b", "2"))) != print_of(rows(("c", "1"), ("b", "2")))


def test_verdicts(spark):
    text = F.lit('{"verdict": "fail", "matched": [1, 2, 13], "missed": [4], "notes": "\\"verdict\\": \\"pass\\""}')
    assert one(spark, report.matched_count(text)) == 3
    assert one(spark, report.passed_parsed(text)) is False


def test_json_documents(spark, tmp_path):
    for name, raw in {"a": '{"x":1}', "b": " ", "c": "[1]", "d": "{"}.items():
        (tmp_path / f"{name}.json").write_text(raw)
    got = {r.path[-6]: (r.doc, r.rejected) for r in jsondocs.read_documents(spark, str(tmp_path)).collect()}
    assert got["a"] == ('{"x":1}', False) and got["b"][0] == "{}" and got["c"][1] and got["d"][1]
    jsondocs.write_document(str(tmp_path / "o.json"), {"é": 1})
    assert (tmp_path / "o.json").read_text() == '{\n  "é": 1\n}\n'
    with pytest.raises(TypeError):
        jsondocs.write_document(str(tmp_path / "o.json"), {"x": object()})
    assert (tmp_path / "o.json").read_text() == '{\n  "é": 1\n}\n' and not list(tmp_path.glob("*.part"))
    assert jsondocs.literal(spark, "[1]").first().rejected and jsondocs.literal(spark, '{"a":1}').first().doc == '{"a":1}'


def test_stream_matches_batch(spark, tmp_path):
    e = spark.read.parquet(f"{DATA}/events.parquet")
    e.write.parquet(str(tmp_path / "in"))
    stream = windowed_tally(spark.readStream.schema(e.schema).parquet(str(tmp_path / "in")), "ts", "event_type", "1 hour", "10 minutes")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("tallied").start()
    q.processAllAvailable()
    q.stop()
    want = windowed_tally(e, "ts", "event_type", "1 hour", "10 minutes")
    key = lambda df: sorted((str(r.window_start), r.event_type, r.n) for r in df.collect())
    assert key(spark.table("tallied")) == key(want)
