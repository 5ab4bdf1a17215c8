"""The document sink's commit and abort, and the scenario source's filters."""

import json
import os

import pytest
from pyspark.sql import functions as F

from sparkweft.operators import report
from sparkweft.sources import docsink, scenarios


def files(root):
    return {os.path.relpath(os.path.join(d, f), root): open(os.path.join(d, f), encoding="utf-8").read() for d, _, names in os.walk(root) for f in names if not f.endswith(".crc")}


def save(df, root):
    docsink.register(df.sparkSession)
    df.write.format("json_documents").mode("append").option("root", str(root)).save()


def test_documents_are_written_and_skipped(spark, tmp_path):
    rows = [(f"g{i % 7}/d{i}.json", json.dumps({"é": i, "o": {"x": []}}), 1) for i in range(40)] + [("null.json", None, 1), ("top.json", "{}", 1)]
    df = spark.createDataFrame(rows, "path string, doc string, more int").repartition(4)
    save(df, tmp_path)
    want = {p: json.dumps(json.loads(d), indent=2, ensure_ascii=False) + "\n" for p, d, _ in rows if d}
    assert files(tmp_path) == want
    before = {p: os.stat(tmp_path / p).st_mtime_ns for p in want}
    changed = df.withColumn("doc", F.when(F.col("path") == "g3/d3.json", '{"new": 1}').otherwise(F.col("doc")))
    save(changed, tmp_path)
    after = {p: os.stat(tmp_path / p).st_mtime_ns for p in want}
    assert {p for p in want if before[p] != after[p]} == {"g3/d3.json"}
    assert files(tmp_path)["g3/d3.json"] == '{\n  "new": 1\n}\n' and not (tmp_path / docsink.WAITING).exists()


@pytest.mark.parametrize("bad", [("../out.json", "{}"), ("/abs.json", "{}"), ("a//b", "{}"), (docsink.WAITING + "/x", "{}"), ("x.json", "{"), ("x.json", '{"a":NaN}'), ("d1.json", '{"twice":1}')])
def test_a_failed_task_leaves_targets_alone(spark, tmp_path, bad):
    save(spark.createDataFrame([(f"d{i}.json", '{"old":1}') for i in range(6)], "path string, doc string"), tmp_path)
    before = files(tmp_path)
    df = spark.createDataFrame([*((f"d{i}.json", '{"new":1}') for i in range(6)), bad], "path string, doc string").repartition(3)
    with pytest.raises(Exception, match="(no path below|JSON|Expecting|Out of range|one path)"):
        save(df, tmp_path)
    assert files(tmp_path) == before and not os.path.exists(tmp_path.parent / "out.json")


def test_overwriting_all_is_refused(spark, tmp_path):
    docsink.register(spark)
    with pytest.raises(Exception, match="append"):
        spark.createDataFrame([("a", "{}")], "path string, doc string").write.format("json_documents").mode("overwrite").option("root", str(tmp_path)).save()


@pytest.fixture
def folder(tmp_path):
    for agent in ("dba", "reviewer", "security", "empty"):
        for scenario in ("b_two", "a one", "C"):
            for part in ("input.md", "rubric.md"):
                if agent == "empty" and part == "rubric.md":
                    continue
                path = tmp_path / "tests" / agent / scenario / part
                path.parent.mkdir(parents=True, exist_ok=True)
                path.write_text(f"{agent}/{scenario}/{part} é")
    (tmp_path / "tests/dba/C/last_verdict.json").write_text('{"verdict":"pass"}')
    (tmp_path / "tests/.hidden/x").mkdir(parents=True)
    (tmp_path / "tests/README.md").write_text("no agent")
    (tmp_path / "agents").mkdir()
    for agent in ("dba", "security", "empty", "untested"):
        (tmp_path / "agents" / f"{agent}.md").write_text("x")
    return tmp_path


def test_scenarios_equal_complete(spark, folder):
    """The same scenarios as the grouping of a listing of all files."""
    scenarios.register(spark)
    got = spark.read.format("scenarios").option("root", str(folder / "tests")).load()
    listing = [(a, s, f) for a, s, f in (p.split("/") for p in files(folder / "tests") if p.count("/") == 2)]
    want = report.complete(spark.createDataFrame(listing, "agent string, scenario string, part string"), ["agent", "scenario"], "part", list(scenarios.REQUIRED))
    assert sorted(map(tuple, got.select("agent", "scenario").collect())) == sorted(map(tuple, want.collect()))
    one = got.where("agent = 'dba' AND scenario = 'C'").first()
    assert (one.input, one.rubric, one.last_output, one.last_verdict) == ("dba/C/input.md é", "dba/C/rubric.md é", None, '{"verdict":"pass"}')
    known = spark.read.format("scenarios").options(root=str(folder / "tests"), agents_root=str(folder / "agents")).load()
    assert {r.agent for r in known.collect()} == {"dba", "security"}
    assert spark.read.format("scenarios").option("root", str(folder / "none")).load().count() == 0


def test_options_keep_to_folders(spark, folder, monkeypatch):
    root = str(folder / "tests")
    read = lambda **x: sorted((r.agent, r.scenario) for r in scenarios.selected(spark, root, **x).collect())
    everything = read()
    assert len(everything) == 9 and scenarios.selected(spark, root).rdd.getNumPartitions() == 4
    for x in ({"agent": "dba"}, {"scenario": "C"}, {"agent": "dba", "scenario": "a one"}, {"agent": "none"}, {"agent": "dba", "scenario": "none"}, {"agent": ".."}, {"agent": "dba/C"}, {"scenario": ".."}):
        assert read(**x) == [r for r in everything if x.get("agent", r[0]) == r[0] and x.get("scenario", r[1]) == r[1]]
    # Only that agent's folder is listed.
    listed = []
    real = scenarios.open_root

    class Watched:
        def __init__(self, system):
            self.system = system

        def __getattr__(self, name):
            return lambda *a, **k: listed.append((name, a[0])) or getattr(self.system, name)(*a, **k)

    monkeypatch.setattr(scenarios, "open_root", lambda r: (Watched(real(r)[0]), real(r)[1]))
    reader = scenarios.ScenarioReader(root, agent="dba")
    assert [len(list(reader.read(p))) for p in reader.partitions()] == [3]
    assert [a.base_dir for name, a in listed if isinstance(a, scenarios.fs.FileSelector)] == [f"{root}/dba"]


def test_filters_of_a_query_reach_the_source(spark, folder):
    key = "spark.sql.python.filterPushdown.enabled"
    spark.conf.set(key, "true")
    try:
        rows = scenarios.selected(spark, str(folder / "tests"), push=True)
        dba = rows.where((F.col("agent") == "dba") & F.col("scenario").isin("C", "b_two", "none") & F.col("input").contains("dba"))
        assert sorted(r.scenario for r in dba.collect()) == ["C", "b_two"] and dba.rdd.getNumPartitions() == 1
        plan = dba._jdf.queryExecution().executedPlan().toString()
        assert "= dba" not in plan and "Contains(input" in plan  # the first is the source's now
    finally:
        spark.conf.unset(key)
    reader = scenarios.PushingReader(str(folder / "tests"))
    left = list(reader.pushFilters([scenarios.EqualTo(("agent",), "dba"), scenarios.EqualTo(("agent",), "security"), scenarios.EqualTo(("input",), "x")]))
    assert len(left) == 1 and reader.partitions() == []
