"""Folder trees: digests of all folders, comparisons that go down into what differs, folders that become empty.

Files are (path, content), paths are below a root and cut by ``/``. A folder's
digest is that of its children's names and digests, rolled up from the deepest
level on. The children's digests are added up as four words, so a folder with
most of all files is combined before the shuffle.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkweft.functions.scalars import fingerprint
from sparkweft.sources.staging import written


def _parent(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_extract(path, "^(.*)/[^/]*$", 1)).otherwise("")


def _name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def _words(digest: Column) -> list[Column]:
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("bigint") for i in range(4)]


def merkle(files: DataFrame, path: str, content: str) -> DataFrame:
    """(path, parent, depth, kind, n_files, digest) of every file and folder; the root is the folder of empty path and depth 0.

    A null content is a content of its own. A path that is there twice counts
    twice. An empty table has no root. Each level is a written table.
    """
    leaf = F.when(F.col(content).isNull(), fingerprint(F.lit("null"))).otherwise(fingerprint(F.concat(F.lit("file "), F.sha2(F.col(content), 256))))
    rows = files.select(F.col(path).alias("path"), leaf.alias("digest"))
    rows = rows.select("path", _parent(F.col("path")).alias("parent"), F.size(F.split("path", "/")).alias("depth"), F.lit("file").alias("kind"), F.lit(1).cast("bigint").alias("n_files"), "digest")
    leaves = written(rows, "leaves")
    deepest = leaves.agg(F.max("depth")).first()[0]
    levels = [leaves]
    above = None
    for depth in range(deepest or 0, 0, -1):
        here = leaves.where(F.col("depth") == depth).select("path", "parent", "n_files", "digest")
        here = here if above is None else here.unionByName(above.select("path", "parent", "n_files", "digest"))
        child = fingerprint(F.concat_ws("\n", _name(F.col("path")), "digest"))
        sums = here.select("parent", "n_files", *(w.alias(f"w{i}") for i, w in enumerate(_words(child)))).groupBy("parent").agg(F.sum("n_files").alias("n_files"), *(F.sum(f"w{i}").alias(f"w{i}") for i in range(4)))
        digest = fingerprint(F.concat_ws("-", F.lit("folder"), *(F.col(f"w{i}") for i in range(4))))
        above = written(sums.select(F.col("parent").alias("path"), F.when(F.col("parent") == "", None).otherwise(_parent(F.col("parent"))).alias("parent"), F.lit(depth - 1).alias("depth"), F.lit("folder").alias("kind"), "n_files", digest.alias("digest")), "folders")
        levels.append(above)
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out


def tree_status(src: DataFrame, dst: DataFrame) -> DataFrame:
    """(path, depth, kind, status) of the source's tree against an installed one: NEW, CHANGED, EXTRA or identical.

    Both are tables of ``merkle``. Only what lies directly in a CHANGED folder is compared
    at the next level: an identical, NEW or EXTRA folder is one row for all that
    is below it, so the rows compared grow with what differs, not with the trees.
    """
    out, unequal = None, None
    side = lambda t, depth: t.where(F.col("depth") == depth).select("path", "parent", "kind", "digest")
    deepest = max((t.agg(F.max("depth")).first()[0] or 0) for t in (src, dst))
    for depth in range(deepest + 1):
        a, b = side(src, depth), side(dst, depth)
        if unequal is not None:
            a, b = (t.join(unequal, t["parent"] == unequal["at"], "left_semi") for t in (a, b))
        a = a.select("path", F.col("kind").alias("kind_a"), F.col("digest").alias("a"))
        both = a.join(b.select("path", F.col("kind").alias("kind_b"), F.col("digest").alias("b")), "path", "full_outer")
        # Where one side has a file and the other a folder, the file is what changes; what is in the folder is not compared.
        status = F.when(F.col("b").isNull(), "NEW").when(F.col("a").isNull(), "EXTRA").when(F.col("a") == F.col("b"), "identical").otherwise("CHANGED")
        down = (F.col("kind_a") == "folder") & (F.col("kind_b") == "folder")
        level = written(both.select("path", F.lit(depth).alias("depth"), F.coalesce("kind_a", "kind_b").alias("kind"), status.alias("status"), down.alias("down")), "level")
        out = level if out is None else out.unionByName(level)
        unequal = level.where("status = 'CHANGED' AND down").select(F.col("path").alias("at"))
        if unequal.isEmpty():
            break
    return out.drop("down")


def emptied_folders(folders: DataFrame, folder: str, kept: DataFrame, path: str) -> DataFrame:
    """(folder, action): removed if no kept file is left in it or below it, else left in place.

    Each kept file holds its folder, that one's folder and so on up; the
    folders so held are made distinct before they are shuffled.
    """
    parts = F.split(F.col(path), "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    held = kept.where(F.col(path).isNotNull()).select(F.explode(above).alias("_held")).distinct().withColumn("_has", F.lit(True))
    joined = folders.select(F.col(folder)).distinct().join(held, F.col(folder) == F.col("_held"), "left")
    return joined.select(folder, F.when(F.col("_has"), "left in place").otherwise("removed").alias("action"))
