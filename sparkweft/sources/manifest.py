"""Which files of a tree are installed, and as what."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where each kind of file lies below the root, and what its name is.
PLACES = {"agent": r"^agents/([^/]+)\.md$", "command": r"^commands/([^/]+)\.md$", "skill": r"^skills/([^/]+)/"}


def kind_and_name(path: Column) -> Column:
    """kind and name of a path below the root, null if nothing installs it."""
    kind, name = F.lit(None).cast("string"), F.lit(None).cast("string")
    for k, pattern in PLACES.items():
        kind = F.when(path.rlike(pattern), k).otherwise(kind)
        name = F.when(path.rlike(pattern), F.regexp_extract(path, pattern, 1)).otherwise(name)
    return F.struct(kind.alias("kind"), name.alias("name"))


def manifest(files: DataFrame, path: str) -> DataFrame:
    """kind, name and n_files of all that a tree's files install; a skill is a folder of any files."""
    told = files.select(kind_and_name(F.col(path)).alias("m")).where("m.kind IS NOT NULL").select("m.kind", "m.name")
    return told.groupBy("kind", "name").agg(F.count("*").alias("n_files"))


def scan(spark: SparkSession, root: str) -> DataFrame:
    """The manifest of a folder that Spark reads; only paths are read, no contents."""
    base = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    below = F.regexp_replace("path", "^.*?" + "".join("\\" + c if not c.isalnum() and c != "/" else c for c in root.split("://")[-1].rstrip("/")) + "/", "")
    return manifest(base.select(below.alias("path")), "path")
