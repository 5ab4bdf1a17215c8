"""Tables written on the way, in the folder that driver and executors share."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; only on a single machine is one made where none is set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows written and read again: what follows starts from the table, also after a lost executor."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_names(columns: list[str], *names: str) -> list[str]:
    """Names like these that are none of the columns', in any case of letters."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        i, made = 0, f"_{name}"
        while made.lower() in taken:
            i, made = i + 1, f"_{name}_{i}"
        taken.add(made.lower())
        out.append(made)
    return out
