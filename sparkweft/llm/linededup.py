"""Line dedup against levelled sorted runs of line hashes.

A run is a table of (hash, documents, largest doc_id), bucketed and sorted by
the hash, and no two runs hold the same hash. Each batch of documents is
merge-anti-joined with the runs: hashes that none holds become a run of their
own at level 0, the others go to a log of what the batch adds to known hashes.
When a level has ``fanout`` runs they are merged into one of the next level.
Runs and logs have the same buckets and are read in their order, so these
joins neither shuffle nor sort them: only a batch's own rows are shuffled.

Everything is DataFrame functions. A line's hash has 128 bits, two XXH64 with
different prefixes, so that lines are not taken for others at any corpus size.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweft.llm import common

#: White space that a key loses at both ends, and the letters that are lowered.
BLANK = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without white space at its ends and with A-Z lowered.

    ``lower`` also lowers other letters, so lines that hold any are lowered
    letter by letter instead.
    """
    stripped = F.btrim(line, F.lit(BLANK))
    beyond = stripped.rlike(r"[\p{IsUppercase}\p{Lt}&&[^A-Z]]")
    ascii_only = F.octet_length(stripped) == F.char_length(stripped)
    return F.when(ascii_only | ~beyond, F.lower(stripped)).otherwise(F.translate(stripped, UPPER, LOWER))


def text_lines(text: Column) -> Column:
    """Lines cut at each newline; null and empty are one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def keyed_lines(docs: DataFrame, min_chars: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, mark, pos, h1, h2) of each line whose key has at least ``min_chars`` code points; mark is a hash of the text."""
    lines = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("mark"), F.posexplode(text_lines(F.col(text_col))).alias("pos", "line"))
    keys = lines.where(F.char_length("line") >= min_chars).select("doc_id", "mark", "pos", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= min_chars)
    return keys.select("doc_id", "mark", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("#"), "key").alias("h2"))


@contextmanager
def sorted_scans(spark: SparkSession) -> Iterator[None]:
    """Within it, scans of bucketed tables tell the order of buckets that are one file."""
    key = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


@dataclass
class Runs:
    """The levelled runs of a corpus and the log of what later batches add, as bucketed tables of the session's warehouse."""

    spark: SparkSession
    buckets: int
    fanout: int = 2
    levels: list[list[str]] = field(default_factory=list)
    log: list[str] = field(default_factory=list)
    name: str = field(default_factory=lambda: f"line_runs_{uuid.uuid4().hex}")
    made: int = 0

    def _write(self, rows: DataFrame) -> str:
        self.made += 1
        table = f"{self.name}_{self.made}"
        rows.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").format("parquet").saveAsTable(table)
        common.let_go(self.spark)
        return table

    def _drop(self, tables: list[str]) -> None:
        for t in tables:
            self.spark.sql(f"DROP TABLE {t} PURGE")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.table(name)

    def names(self) -> list[str]:
        return [t for level in self.levels for t in level]

    def unknown(self, hashes: DataFrame) -> DataFrame:
        """The merge-anti-join: rows whose hash no run holds."""
        for t in self.names():
            hashes = hashes.hint("merge").join(self.table(t).select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")
        return hashes

    def add(self, counts: DataFrame) -> None:
        """Takes in a batch's (h1, h2, n_docs, last): unknown hashes as a run of level 0, known ones into the log."""
        batch = self._write(counts.repartition(self.buckets, "h1", "h2"))
        if not any(self.levels):
            self._put(batch, 0)
            return
        fresh = self._write(self.unknown(self.table(batch)))
        known = self.table(batch).hint("merge").join(self.table(fresh).select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")
        self.log.append(self._write(known))
        self._drop([batch])
        self._put(fresh, 0)

    def _put(self, table: str, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(table)
        if len(self.levels[level]) >= self.fanout:
            old, self.levels[level] = self.levels[level], []
            merged = self._write(self._merged(old))
            self._drop(old)
            self._put(merged, level + 1)

    def _merged(self, tables: list[str], how: str = "full_outer") -> DataFrame:
        out = self.table(tables[0])
        for t in tables[1:]:
            other = self.table(t).select("h1", "h2", F.col("n_docs").alias("n2"), F.col("last").alias("last2"))
            joined = out.hint("merge").join(other.hint("merge"), ["h1", "h2"], how)
            zero = F.lit(0).cast("bigint")
            out = joined.select("h1", "h2", (F.coalesce("n_docs", zero) + F.coalesce("n2", zero)).alias("n_docs"), F.greatest("last", "last2").alias("last"))
        return out

    def compact(self) -> str:
        """All runs merged into one; its name."""
        left = self.names()
        if len(left) > 1:
            merged = self._write(self._merged(left))
            self._drop(left)
            self.levels = [*([] for _ in self.levels), [merged]]
        return self.names()[0]

    def totals(self) -> DataFrame:
        """(h1, h2, n_docs, last) of every hash, over all batches."""
        return self._merged([self.compact(), *self.log], "left")

    def drop(self) -> None:
        """No table of these runs stays, also where a step before failed."""
        for i in range(1, self.made + 1):
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_{i} PURGE")
        self.levels, self.log = [], []


def batch_counts(keys: DataFrame) -> DataFrame:
    """(h1, h2, n_docs, last) of a batch; a line that a document repeats counts once."""
    once = keys.select("doc_id", "h1", "h2").distinct()
    return once.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last"))


def drops(docs: DataFrame, min_chars: int, min_docs: int, batches: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, mark, dropped: positions) of the texts that lose lines, one row for each id and text.

    The documents go through the runs in ``batches`` parts of equal expected
    size, dealt by a hash of the id. A key's documents are counted over all of
    them before anything is dropped: the last document that holds a key keeps
    its lines, and keys of fewer than ``min_docs`` documents keep all.
    """
    spark = docs.sparkSession
    part = F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int")
    path = common.fresh_path(spark, "lines")
    keyed_lines(docs, min_chars, id_col, text_col).withColumn("part", part).write.partitionBy("part").parquet(path)
    id_type = docs.schema[id_col].dataType.simpleString()
    keys = spark.read.schema(f"doc_id {id_type}, mark bigint, pos int, h1 bigint, h2 bigint, part int").parquet(path)
    runs = Runs(spark, int(spark.conf.get("spark.sql.shuffle.partitions")))
    try:
        with sorted_scans(spark):
            for i in range(batches):
                runs.add(batch_counts(keys.where(F.col("part") == i)))
            hot = common.staged(runs.totals().where(F.col("n_docs") >= min_docs).select("h1", "h2", "last"), "frequent")
    finally:
        runs.drop()
    lost = keys.select("doc_id", "mark", "pos", "h1", "h2").join(hot, ["h1", "h2"]).where(~F.col("doc_id").eqNullSafe(F.col("last")))
    gone = common.staged(lost.groupBy("doc_id", "mark").agg(F.collect_set("pos").alias("dropped")), "dropped")
    common.remove_path(spark, path)
    return gone


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, batches: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of the documents with ``text`` without the dropped lines, and n_lines, n_dropped.

    Null and empty texts are one empty line and become empty. A line that a
    document repeats goes or stays as a whole. Rows with equal doc_id count as
    one document, whose lines are those of all its rows, and each row loses
    lines of its own text only; rows with null doc_id count as one document
    that is never the last. An empty table gives an empty one. Columns of any
    name may be there besides; those named n_lines and n_dropped are replaced.

    Only documents that a map of fixed size says may lose lines are shuffled.
    """
    rest = docs.drop("n_lines", "n_dropped")
    doc_, mark_, gone_, may_, lines_, key_ = common.fresh_names(rest, "doc", "mark", "gone", "may", "lines", "key")
    lost = drops(rest, min_chars, min_docs, batches, id_col, text_col).select(F.col("doc_id").alias(doc_), F.col("mark").alias(mark_), F.col("dropped").alias(gone_))
    told = common.maybe_in(rest, id_col, lost, doc_, may_).withColumn(lines_, text_lines(F.col(text_col)))
    size = F.size(lines_).cast("bigint").alias("n_lines")
    others = [F.col(c) for c in rest.columns]
    whole = told.where(~F.col(may_)).select(*[F.coalesce(c, F.lit("")).alias(text_col) if n == text_col else c for n, c in zip(rest.columns, others, strict=True)], size, F.lit(0).cast("bigint").alias("n_dropped"))
    # The text goes on as its lines alone; they are a column of the join's, so that a line is found by its place at once.
    some = told.where(F.col(may_)).withColumn(key_, F.xxhash64(text_col)).drop(text_col, may_)
    joined = some.join(lost, some[id_col].eqNullSafe(lost[doc_]) & (F.col(key_) == F.col(mark_)), "left")
    gone = F.coalesce(gone_, F.array().cast("array<int>"))
    left = F.array_except(F.sequence(F.lit(0), F.size(lines_) - 1), gone)
    text = F.array_join(F.transform(left, lambda i: F.get(lines_, i)), "\n").alias(text_col)
    cut = joined.select(*[text if n == text_col else some[n] for n in rest.columns], size, F.size(gone).cast("bigint").alias("n_dropped"))
    return whole.unionByName(cut)
