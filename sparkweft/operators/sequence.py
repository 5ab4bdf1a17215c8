"""Counters and flags over ordered records, as segmented scans: a document that holds most of the rows is many tasks."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkweft.functions.scalars import ends_body, limit_place
from sparkweft.operators.scan import Ranges, running_sums
from sparkweft.sources.staging import free_names


def number_kinds(rows: DataFrame, doc: str, seq: str, kind: str, name: str = "number", counted: Column | None = None) -> DataFrame:
    """An own running number for each kind of block in a document.

    Rows that are not ``counted``, such as figures whose file is missing, take
    no number: theirs is null and the next row's is the next.
    """
    taken = F.lit(True) if counted is None else F.coalesce(counted, F.lit(False))
    (mine,) = free_names([*rows.columns, name], "taken")
    numbers = running_sums(rows.withColumn(mine, taken), [doc, kind], [seq], {name: F.when(F.col(mine), 1).otherwise(0)})
    return numbers.withColumn(name, F.when(F.col(mine), F.col(name)).cast("int")).drop(mine)


def number_tables(tables: DataFrame, doc: str, seq: str, n_rows: str, name: str = "number") -> DataFrame:
    """Empty tables take no number and go; those without caption take one."""
    return running_sums(tables.where(F.col(n_rows) > 0), [doc], [seq], {name: F.lit(1)}).withColumn(name, F.col(name).cast("int"))


def break_flags(rows: DataFrame, doc: str, seq: str, kind: str, profile: Column | None = None) -> DataFrame:
    """Whether a heading needs a page break before it; never where the document's ``profile`` is false.

    Only headings (h1) and page breaks touch the state, and a document starts
    as just broken; text between does not clear it.
    """
    rows = rows.drop("breaks")
    wanted, mark, last, before = free_names(rows.columns, "wanted", "mark", "last", "before")
    ranges = Ranges(rows.withColumn(wanted, F.lit(True) if profile is None else F.coalesce(profile, F.lit(True))), [doc], [seq])
    marked = ranges.rows.withColumn(mark, F.when(F.col(kind).isin("h1", "page_break"), F.col(kind)))
    states = ranges.states(marked, **{last: F.max_by(mark, F.when(F.col(mark).isNotNull(), F.col(seq)))})
    local = marked.withColumn(last, F.last(mark, ignorenulls=True).over(ranges.within.rowsBetween(Window.unboundedPreceding, -1)))
    told = ranges.carried(local, states, **{before: F.last(last, ignorenulls=True).over(ranges.before)})
    breaks = (F.col(kind) == "h1") & F.coalesce(F.coalesce(last, before) == "h1", F.lit(False)) & F.col(wanted)
    return told.select(*rows.columns, breaks.alias("breaks"))


def restart_lists(rows: DataFrame, doc: str, seq: str, kind: str) -> DataFrame:
    """Each run of equal kinds is a list with the next id from 100 on; items restart at 1. Null is a kind like any other."""
    rows = rows.drop("list_id", "item")
    run, item, ids, items = free_names(rows.columns, "run", "item", "ids", "items")
    ranges = Ranges(rows, [doc], [seq])
    w, key = ranges.within, F.struct(F.col(kind).alias("k"))
    same = (F.row_number().over(w) > 1) & F.lag(kind).over(w).eqNullSafe(F.col(kind))
    local = ranges.rows.withColumn(run, F.when(same, 0).otherwise(1)).withColumn(run, F.sum(run).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    local = local.withColumn(item, F.row_number().over(Window.partitionBy(ranges.range, doc, run).orderBy(seq)))
    states = ranges.states(local, first=F.min_by(key, seq), last=F.max_by(key, seq), runs=F.max(run), tail=F.max_by(item, seq))
    # Whether a range's first run goes on with the last one before it; a range of one run that does leaves it open.
    before = F.lag("last").over(ranges.across)
    goes_on = states.withColumn("on", before.isNotNull() & before["k"].eqNullSafe(F.col("first.k")))
    opened = F.sum(F.when(F.col("on") & (F.col("runs") == 1), 0).otherwise(1)).over(ranges.across.rowsBetween(Window.unboundedPreceding, 0))
    long = goes_on.withColumn("opened", opened).withColumn("length", F.sum("tail").over(Window.partitionBy(doc, "opened").orderBy(ranges.range)))
    on = F.col("on").cast("int")
    told = ranges.carried(local, long, **{ids: F.sum(F.col("runs") - on).over(ranges.before) - on, items: F.when(F.col("on"), F.lag("length").over(ranges.across))})
    at = F.col(item) + F.when(F.col(run) == 1, F.coalesce(items, F.lit(0))).otherwise(0)
    return told.select(*rows.columns, (F.col(run) + F.coalesce(ids, F.lit(0)) + 99).cast("bigint").alias("list_id"), at.cast("int").alias("item"))


def body_lines(lines: DataFrame, doc: str, pos: str, line: str) -> DataFrame:
    """Lines after the second ``---`` line and before a third."""
    (marks,) = free_names(lines.columns, "marks")
    counted = running_sums(lines, [doc], [pos], {marks: F.when(F.col(line) == "---", 1).otherwise(0)})
    return counted.where((F.col(marks) == 2) & (F.col(line) != "---")).drop(marks)


def ancestors(path: Column) -> Column:
    """The path and all folders above it, the root included."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    return F.transform(F.sequence(F.size(parts), F.lit(0)), lambda n: F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, n), "/")))


def nearest_root(starts: DataFrame, start: str, files: DataFrame, path: str, markers: list[str]) -> DataFrame:
    """start, root: of the folders at or above each start, the deepest that holds a marker; null if none does."""
    folder, name = F.regexp_extract(path, "^(.*)/[^/]*$", 1), F.element_at(F.split(path, "/"), -1)
    marked = files.where(name.isin(*markers)).select(F.when(folder == "", "/").otherwise(folder).alias("_at")).distinct()
    ways = starts.select(start).distinct().select(start, F.explode(ancestors(F.col(start))).alias("_at"))
    found = ways.join(marked.withColumn("_has", F.lit(True)), "_at", "left")
    return found.groupBy(start).agg(F.max_by(F.when(F.col("_has"), F.col("_at")), F.when(F.col("_has"), F.char_length("_at"))).alias("root"))


def operator_bodies(signs: DataFrame, doc: str, seq: str, sign: str) -> DataFrame:
    """The operators with limits, and the last place of each one's body, null if it is empty.

    A body goes on to the next relation or the end of the row of signs. An
    operator inside takes its own body first, which ends at the same place.
    """
    prior, following, end, stop, far, low, high, whole_end = free_names(signs.columns, "prior", "following", "end", "stop", "far", "low", "high", "whole_end")
    ranges = Ranges(signs, [doc], [seq])
    w = ranges.within
    states = ranges.states(ranges.rows, low=F.min(seq), high=F.max(seq))
    whole = Window.partitionBy(doc)
    local = ranges.rows.withColumns({prior: F.lag(seq).over(w), following: F.lead(seq).over(w), end: F.max(seq).over(Window.partitionBy(ranges.range, doc))})
    local = ranges.carried(local, states, **{low: F.lag("high").over(ranges.across), high: F.lead("low").over(ranges.across), whole_end: F.max("high").over(whole)})
    local = local.withColumns({prior: F.coalesce(prior, low), following: F.coalesce(following, high), end: F.coalesce(whole_end, end)}).drop(low, high, whole_end)
    relation = F.when(ends_body(F.col(sign)), F.struct(F.col(seq).alias("at"), F.col(prior).alias("last")))
    stops = ranges.states(local, stop=F.min(relation))
    told = local.withColumn(stop, F.min(relation).over(w.rowsBetween(1, Window.unboundedFollowing)))
    told = ranges.carried(told, stops, **{far: F.min("stop").over(ranges.after)})
    first = F.coalesce(stop, far)
    body = F.when(first["at"] == F.col(following), None).when(first.isNotNull(), first["last"]).when(F.col(following).isNotNull(), F.col(end))
    return told.where(limit_place(F.col(sign)).isNotNull()).select(*signs.columns, limit_place(F.col(sign)).alias("limits"), body.alias("body_end"))
