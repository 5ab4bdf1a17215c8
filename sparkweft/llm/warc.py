"""WARC archives: written as text rows, read by a verified chain of boundaries.

A record is one row whose lines end in CRLF, and Spark's text writer with the
separator CRLF CRLF ends it as the format asks. Reading goes the other way:
the text reader cuts the archives at every ``WARC/1.0`` line, split by split,
so large archives are read by many tasks. Each fragment is a candidate record;
its Content-Length says where the next one must begin. Payloads may hold the
same line, so a candidate counts only if it is reached from the start of its
file. Pointer jumping finds those in a logarithmic number of steps: every
candidate's pointer is replaced by its pointer's pointer while marks spread
along them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkweft.llm import common

#: Fixed values of the format.
MAGIC, GAP = "WARC/1.0\r\n", "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
#: Payloads below this are never revisits; records of an archive file at most.
MIN_REVISIT_BYTES, FILE_RECORDS = 1000, 4096


def winners(rows: DataFrame, least: int) -> DataFrame:
    """digest, n, refers_to: the largest page_id of each payload of ``least`` bytes that several rows have.

    Payloads are told by digest and length. They are combined before the
    shuffle and written, so that the join with a payload that a third of all
    pages share can be split.
    """
    first = rows.where(F.col("n") >= least).groupBy("digest", "n").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    return common.staged(first, "winners")


def _uri(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), page_id.cast("string"), F.lit(">"))


def write_archives(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = MIN_REVISIT_BYTES) -> None:
    """A record per row: a response with the HTML, or a revisit of the page that keeps the same payload.

    Null HTML is an empty payload, a null url an empty one, control characters
    in a url are percent-encoded away. Rows may repeat a page_id, with any
    payloads: each is a record, and all that have the largest page_id of their
    payload are responses. A row without page_id is a response.
    """
    body = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), body.alias("html"), F.sha1(body.cast("binary")).alias("digest"), F.octet_length(body).alias("n"))
    rows = rows.join(winners(rows.drop("url", "html"), least), ["digest", "n"], "left").withColumn("refers_to", F.when(F.col("page_id") < F.col("refers_to"), F.col("refers_to")))
    revisit = F.col("refers_to").isNotNull()
    block = F.when(revisit, "").otherwise(F.col("html"))
    lines = [
        F.when(revisit, "WARC-Type: revisit").otherwise("WARC-Type: response"),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), r"[\x00-\x20\x7f]", "%20")),
        F.lit(f"WARC-Date: {DATE}"),
        F.concat(F.lit("WARC-Record-ID: "), F.coalesce(_uri(F.col("page_id")), F.lit("<urn:page:>"))),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), _uri(F.col("refers_to")))),
        F.when(revisit, "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
        F.lit("Content-Type: text/html"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    ]
    record = F.concat(F.lit(MAGIC), F.concat_ws("\r\n", *lines), F.lit(GAP), block)
    rows.select(record.alias("value")).write.option("lineSep", GAP).option("maxRecordsPerFile", FILE_RECORDS).text(path)


def _header(name: str, kind: str) -> Column:
    """A header's value, null if it is not there."""
    got = F.regexp_extract(F.col("header"), rf"(?im)^{name}:[ \t]*({kind})[ \t]*\r?$", 1)
    return F.nullif(got, F.lit(""))


def _fragments(spark: SparkSession, path: str) -> DataFrame:
    """What lies between ``WARC/1.0`` lines, in order of (file, split, row)."""
    text = spark.read.option("lineSep", MAGIC).text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("row"), F.octet_length("value").cast("bigint").alias("size"), "value")


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """Every fragment with its offset, the offset of its successor, its headers and, if it is whole, its payload's digest.

    Only lengths and headers are kept, so what follows does not carry payloads.
    """
    cut = _fragments(spark, path).withColumn("header", F.substring_index("value", GAP, 1))
    head = F.octet_length("header") + len(GAP)
    length = F.try_to_number(_header("Content-Length", r"\d{1,18}"), F.lit("9" * 18)).cast("bigint")
    parsed = cut.select(
        "file", "split", "row", "size", head.cast("bigint").alias("head"), length.alias("length"),
        _header("WARC-Type", r"\S+").alias("kind"),
        F.regexp_extract("header", r"(?im)^WARC-Record-ID:[ \t]*<urn:page:(-?\d+)>", 1).alias("page"),
        F.regexp_extract("header", r"(?im)^WARC-Refers-To:[ \t]*<urn:page:(-?\d+)>", 1).alias("refers"),
        F.regexp_extract("header", r"(?im)^WARC-Payload-Digest:[ \t]*sha1:([0-9a-f]+)", 1).alias("stated"),
        _header("WARC-Target-URI", r"\S*").alias("url"),
        F.when(head + length <= F.col("size"), F.sha1(F.substring(F.col("value").cast("binary"), (head + 1).cast("int"), length.cast("int")))).alias("digest"),
    )
    parsed = common.staged(parsed, "fragments")
    return _placed(parsed).drop("split", "row").withColumn("next", F.col("start") + len(MAGIC) + F.col("head") + F.col("length") + len(GAP))


def _placed(fragments: DataFrame) -> DataFrame:
    """The fragments with their offset: running sums of sizes inside a split, after the sums of the splits before it. No task sorts a whole archive."""
    length_of = F.col("size") + len(MAGIC)
    splits = fragments.groupBy("file", "split").agg(F.sum(length_of).alias("total"))
    bases = splits.select("file", "split", (F.sum("total").over(Window.partitionBy("file").orderBy("split")) - F.col("total")).alias("base"))
    inside = F.sum(length_of).over(Window.partitionBy("file", "split").orderBy("row")) - length_of
    return fragments.withColumn("inside", inside).join(bases, ["file", "split"]).withColumn("start", F.col("base") + F.col("inside") - len(MAGIC)).drop("base", "inside")


def reachable(start: np.ndarray, nxt: np.ndarray) -> np.ndarray:
    """Which of the sorted candidates are reached from offset 0, by pointer jumping."""
    n = len(start)
    at = np.searchsorted(start, nxt)
    hit = (at < n) & (start[np.minimum(at, n - 1)] == nxt) if n else np.zeros(0, bool)
    jump = np.append(np.where(hit, at, n), n)  # n: the end
    mark = np.zeros(n + 1, bool)
    mark[:-1] = start == 0
    while True:
        ahead = mark.copy()
        ahead[jump[mark]] = True
        further = jump[jump]
        if (ahead == mark).all() and (further == jump).all():
            return mark[:-1]
        mark, jump = ahead, further


def _chain(file: pd.DataFrame) -> pd.DataFrame:
    """For each fragment of a file, the start of the record that it lies in; fragments before any record go."""
    file = file.sort_values("start", kind="stable")
    start, nxt = file["start"].to_numpy(np.int64), file["next"].fillna(-1).to_numpy(np.int64)
    real = start >= 0
    mark = np.zeros(len(start), bool)
    mark[real] = reachable(start[real], nxt[real])
    place = np.maximum.accumulate(np.where(mark, np.arange(len(start)), -1))
    out = file[["file", "start"]].assign(record=start[np.maximum(place, 0)])
    return out[place >= 0]


def records(spark: SparkSession, path: str) -> DataFrame:
    """page_id, url, record_type, payload_bytes, payload_digest, refers_to, verified of each record.

    Archives that do not begin with a record give nothing; a record that is
    cut off at the end of its file is kept only as far as its length allows,
    that is, not at all. Payloads with ``WARC/1.0`` lines come as several
    fragments; those are read a second time and put together again, in one
    record's own group. A revisit has the digest that it states, and the
    length of the payload of that digest of the page that it refers to; if
    there is none, the length is null and it is not verified. One task holds
    the offsets of an archive's candidates, of 24 bytes each, never payloads.
    """
    found = common.staged(candidates(spark, path), "candidates")
    places = found.select("file", "start", "next").groupBy("file").applyInPandas(_chain, "file string, start bigint, record bigint")
    owned = common.staged(places, "chain")
    heads = common.staged(found.join(owned.where("start = record").select("file", "start"), ["file", "start"]), "records")
    broken = heads.where("digest IS NULL AND length IS NOT NULL").select("file", F.col("start").alias("record"), "head", "length")
    if not broken.isEmpty():
        whole = _rejoined(spark, path, owned, common.staged(broken, "broken"))
        heads = heads.join(whole, ["file", "start"], "left").withColumn("digest", F.coalesce("digest", "whole")).drop("whole")
    heads = heads.where("digest IS NOT NULL")
    page = F.nullif(F.col("page"), F.lit("")).cast("bigint")
    rows = heads.select(page.alias("page_id"), "url", F.col("kind").alias("record_type"), F.col("length").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.nullif(F.col("refers"), F.lit("")).cast("bigint").alias("refers_to"), F.nullif(F.col("stated"), F.lit("")).alias("stated"))
    full = rows.where("record_type <> 'revisit'").withColumn("verified", F.col("stated") == F.col("payload_digest"))
    target = common.staged(full.select(F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("stated"), F.col("payload_bytes").alias("_n")).distinct(), "targets")
    # A page may have several payloads: the one meant is that of the stated digest.
    again = rows.where("record_type = 'revisit'").join(target, ["refers_to", "stated"], "left")
    again = again.select("page_id", "url", "record_type", F.col("_n").alias("payload_bytes"), F.col("stated").alias("payload_digest"), "refers_to", "stated", F.col("_n").isNotNull().alias("verified"))
    return full.unionByName(again).drop("stated")


def _rejoined(spark: SparkSession, path: str, owned: DataFrame, broken: DataFrame) -> DataFrame:
    """file, start, whole: the digest of each payload that lies in several fragments.

    Their archives are read again. The offsets are summed up anew, from the
    sizes of fragments alone, so fragments are told by offset, however the
    first read was split. What is found is written, and the texts of these
    fragments, and no others, are joined to it by their place in a last read,
    which is cut as the one before was.
    """
    read = _fragments(spark, path).join(broken.select("file").distinct(), "file", "left_semi")
    parts = owned.join(broken, ["file", "record"])
    places = _placed(read.drop("value")).join(parts, ["file", "start"]).select("file", "split", "row", "start", "record", "head", "length")
    joined = read.select("file", "split", "row", "value").join(common.staged(places, "places"), ["file", "split", "row"]).groupBy("file", "record", "head", "length").agg(F.array_sort(F.collect_list(F.struct("start", "value"))).alias("p"))
    raw = F.array_join(F.transform("p", lambda x: x["value"]), MAGIC).cast("binary")
    sized = joined.select("file", F.col("record").alias("start"), "head", "length", raw.alias("raw")).where(F.octet_length("raw") >= F.col("head") + F.col("length"))
    return sized.select("file", "start", F.sha1(F.substring("raw", (F.col("head") + 1).cast("int"), F.col("length").cast("int"))).alias("whole"))
