"""JSON document scans: a missing or blank file counts as ``{}``, anything
that is not an object is set apart instead of stopping the job."""

import json
import os
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def object_text(raw: Column) -> Column:
    """The document, ``{}`` for a blank or null one, null for anything but an object.

    Duplicate keys make a document malformed here; a permissive reader would
    keep the last one silently.
    """
    blank = F.coalesce(raw.rlike(r"^\s*$"), F.lit(True))
    parsed = F.try_parse_json(raw)
    is_object = F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT<"), F.lit(False))
    return F.when(blank, F.lit("{}")).when(is_object, raw)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: path, doc (null where rejected), rejected."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return raw.select("path", object_text(F.col("value")).alias("doc")).withColumn("rejected", F.col("doc").isNull())


def literal(spark: SparkSession, text: str) -> DataFrame:
    """A document given as text: doc (null if it is no object) and rejected, one row."""
    doc = object_text(F.lit(text))
    return spark.range(1).select(doc.alias("doc")).withColumn("rejected", F.col("doc").isNull())


def write_document(path: str, doc: dict) -> None:
    """A single small document: written beside the target under a name of its own, then moved over it; nothing is left of a failed write."""
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    handle, beside = tempfile.mkstemp(dir=folder, suffix=".part")
    try:
        with open(handle, "w", encoding="utf-8") as f:
            f.write(json.dumps(doc, indent=2, ensure_ascii=False) + "\n")
        os.replace(beside, path)
    except BaseException:
        os.unlink(beside)
        raise
