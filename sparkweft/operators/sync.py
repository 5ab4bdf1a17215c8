"""Keyed comparison of a source with what is installed.

Both sides are (key, content), with a row for a key, as files have one path;
a key that a side repeats is compared with each of the other side's rows. The
joins are equi-joins on the key, so Spark picks a broadcast or a
co-partitioned merge by the sizes it measures.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkweft.functions.scalars import fingerprint


def status(src: DataFrame, dst: DataFrame, key: str, content: str) -> DataFrame:
    """NEW, CHANGED or identical for each source key; extra installed keys are not reported."""
    d = dst.select(F.col(key), F.col(content).alias("_there"), F.lit(True).alias("_has"))
    same = F.col(content).eqNullSafe(F.col("_there"))
    kind = F.when(F.col("_has").isNull(), "NEW").when(same, "identical").otherwise("CHANGED")
    return src.select(key, content).join(d, key, "left").select(key, kind.alias("status"))


def diff(src: DataFrame, dst: DataFrame, key: str, content: str) -> DataFrame:
    return status(src, dst, key, content).where("status <> 'identical'")


def has_diff(src: DataFrame, dst: DataFrame, key: str, content: str) -> DataFrame:
    kinds = status(src, dst, key, content)
    count = lambda k: F.count_if(F.col("status") == k).alias(f"n_{k.lower()}")
    return kinds.agg(F.coalesce(F.bool_or(F.col("status") != "identical"), F.lit(False)).alias("has_diff"), count("NEW"), count("CHANGED"), count("identical"))


def pull(src: DataFrame, dst: DataFrame, key: str, content: str, known_only: bool = False) -> DataFrame:
    """The source after pulling: installed content wins, and adds unknown keys unless known_only.

    known_only returns just the pulled rows.
    """
    d = dst.select(F.col(key), F.col(content).alias("_new"), F.lit(True).alias("_has"))
    joined = src.select(key, content).join(d, key, "inner" if known_only else "full_outer")
    return joined.select(key, F.when(F.col("_has"), F.col("_new")).otherwise(F.col(content)).alias(content))


def uninstall(src: DataFrame, dst: DataFrame, key: str) -> DataFrame:
    """What happens to each installed key: removed if the source has it, kept otherwise."""
    mine = src.select(key).distinct().withColumn("_mine", F.lit(True))
    return dst.select(key).join(mine, key, "left").select(key, F.when(F.col("_mine"), "removed").otherwise("kept").alias("action"))


def folder_fingerprint(files: DataFrame, folder: str, path: str, content: str) -> DataFrame:
    """One digest per folder over its paths and contents, equal only for equal folders.

    Each file's digest is cut in four words that are summed, so a folder is
    combined map-side and one that holds a third of all rows needs no task of
    its own. The path is part of the file's digest, so renames show.
    """
    digest = fingerprint(F.concat_ws("\n", F.col(path).cast("string"), F.sha2(F.col(content), 256)))
    words = [F.conv(F.substring("_d", 1 + 8 * i, 8), 16, 10).cast("bigint") for i in range(4)]
    sums = files.select(folder, digest.alias("_d")).groupBy(folder).agg(F.count("*").alias("n_files"), *(F.sum(w).alias(f"_w{i}") for i, w in enumerate(words)))
    return sums.select(folder, "n_files", fingerprint(F.concat_ws("-", *(F.col(f"_w{i}") for i in range(4)))).alias("fingerprint"))


def replacement(there: Column, new: Column) -> Column:
    """What putting a file in place means, told by digest: write if there is none, keep if it is the same, else back up and write."""
    return F.when(there.isNull(), "write").when(fingerprint(there).eqNullSafe(fingerprint(new)), "keep").otherwise("back up")


def clones(lines: DataFrame, doc: str, pos: str, line: str, width: int = 5, near: bool = False) -> DataFrame:
    """Windows of ``width`` adjacent lines that occur more than once, with their number of places.

    With ``near``, lines are alike that differ in case, white space and digits
    only. A document's lines are sorted by one task, which holds ``width`` of
    them at a time.
    """
    w = Window.partitionBy(doc).orderBy(pos)
    text = F.regexp_replace(F.regexp_replace(F.lower(F.trim(line)), r"\s+", " "), "[0-9]+", "0") if near else F.col(line)
    alike = lines.withColumn("_line", text)
    block = F.concat_ws("\n", F.col("_line"), *(F.lead("_line", i).over(w) for i in range(1, width)))
    whole = F.lead(F.lit(1), width - 1).over(w).isNotNull()
    blocks = alike.select(doc, block.alias("_b"), whole.alias("_w")).where("_w")
    return blocks.groupBy(fingerprint(F.col("_b")).alias("block")).agg(F.count("*").alias("places")).where("places > 1")
