"""Folder digests, comparisons and emptied folders against plain walks."""

import collections
import random

from pyspark.sql import functions as F

from sparkweft.operators import tree


def grown(rnd, n):
    names = ["a", "b", "c.d", "é"]
    return {"/".join([*(rnd.choice(names) for _ in range(rnd.randint(0, 5))), f"f{i}"]): rnd.choice("xyz") for i in range(n)}


def table(spark, files):
    return spark.createDataFrame(list(files.items()), "p string, c string")


def inside(files):
    """Folder -> (path below it, content), for all folders."""
    out = collections.defaultdict(set)
    for path, content in files.items():
        parts = path.split("/")
        for n in range(len(parts)):
            out["/".join(parts[:n])].add(("/".join(parts[n:]), content))
    return out


def test_digests_are_equal_only_for_equal_folders(spark):
    files = grown(random.Random(1), 200)
    files |= {f"copy/{p}": c for p, c in files.items() if p.startswith("a/")}
    got = {r.path: r for r in tree.merkle(table(spark, files), "p", "c").collect()}
    want = inside(files)
    assert {p for p, r in got.items() if r.kind == "folder"} == set(want) and len(got) == len(files) + len(want)
    for p, below in want.items():
        assert got[p].n_files == len(below) and got[p].depth == (p.count("/") + 1 if p else 0)
        for q, other in want.items():
            assert (got[p].digest == got[q].digest) == (below == other)
    assert got["copy/a"].digest == got["a"].digest
    assert tree.merkle(table(spark, {}).limit(0), "p", "c").count() == 0


def test_status_goes_down_into_what_differs(spark):
    rnd = random.Random(2)
    src = grown(rnd, 300)
    dst = {p: ("new" if i % 40 == 0 else c) for i, (p, c) in enumerate(src.items()) if i % 50 != 1}
    dst |= {"extra/deep/er/f": "x", "b/extra": "y", "null": None}
    src |= {"fresh/one/f": "x", "null": None, "kind/f": "1"}
    dst |= {"kind": "1"}
    got = {r.path: r for r in tree.tree_status(tree.merkle(table(spark, src), "p", "c"), tree.merkle(table(spark, dst), "p", "c")).collect()}
    a, b = inside(src), inside(dst)
    want = {}

    def walk(folder):
        step = lambda p: (f"{folder}/{p}" if folder else p)
        for name in {p.split("/")[0] for p, _ in a[folder] | b[folder]}:
            path = step(name)
            left, right = (x.get(path, files.get(path, "none")) for x, files in ((dict(a), src), (dict(b), dst)))
            want[path] = "NEW" if right == "none" else "EXTRA" if left == "none" else "identical" if left == right else "CHANGED"
            if want[path] == "CHANGED" and isinstance(left, set) and isinstance(right, set):
                walk(path)

    want[""] = "CHANGED"
    walk("")
    assert {p: r.status for p, r in got.items()} == want
    assert len(got) < len(src) and not any(p.startswith(("extra/", "fresh/")) for p in got)
    same = tree.merkle(table(spark, src), "p", "c")
    assert [tuple(r) for r in tree.tree_status(same, same).collect()] == [("", 0, "folder", "identical")]


def test_emptied_folders_against_a_walk(spark):
    files = grown(random.Random(3), 120)
    kept = {p for p in files if hash(p) % 9 == 0 or p.startswith("a/b")}
    folders = {*inside(files), "empty", "empty/below", "a/was/empty"}
    left = inside(dict.fromkeys(kept, "x"))
    got = dict(map(tuple, tree.emptied_folders(spark.createDataFrame([(f,) for f in folders], "f string"), "f", spark.createDataFrame([(p,) for p in kept] + [(None,)], "p string"), "p").collect()))
    assert got == {f: "left in place" if f in left else "removed" for f in folders}
    assert tree.emptied_folders(spark.createDataFrame([("x",)], "f string"), "f", spark.createDataFrame([], "p string"), "p").first().action == "removed"


def test_a_large_folder_is_combined_before_the_shuffle(spark):
    files = spark.range(20_000).select(F.concat(F.lit("hot/f"), F.col("id")).alias("p"), F.lit("c").alias("c"))
    root = {r.path: r.n_files for r in tree.merkle(files, "p", "c").where("kind = 'folder'").collect()}
    assert root == {"": 20_000, "hot": 20_000}
