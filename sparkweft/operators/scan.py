"""Segmented scans: state over ordered rows of a key, also of a key that holds most of all rows.

Rows are dealt by ranges of (key, order), so that a large key is many ranges.
What a range can tell by itself are windows inside of it, which need no other
shuffle. Each range's first and last key is folded to a small state; the
states of the keys that are cut, two rows a range at most, are combined in
order and joined to the rows again.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkweft.sources.staging import free_names, written


class Ranges:
    """Rows by ranges of (by, order), as a written table: the ranges are found once and stay.

    ``within`` is the window over a key's rows in a range, ``across`` that over
    a key's states, range by range. Rows of one key and equal order are one
    range's, as for a window their order is open.
    """

    def __init__(self, rows: DataFrame, by: list[str], order: list[Column | str]):
        n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        (self.range,) = free_names(rows.columns, "range")
        self.by, self.columns = by, rows.columns
        dealt = rows.repartitionByRange(n, *by, *order).withColumn(self.range, F.spark_partition_id())
        self.rows = written(dealt, "ranges").repartitionById(n, F.col(self.range))
        self.within = Window.partitionBy(self.range, *by).orderBy(*order)
        self.across = Window.partitionBy(*by).orderBy(self.range)
        self.before = self.across.rowsBetween(Window.unboundedPreceding, -1)
        self.after = self.across.rowsBetween(1, Window.unboundedFollowing)

    def states(self, rows: DataFrame, **folds: Column) -> DataFrame:
        """(range, by, folds) of the first and of the last key of each range; other keys are whole in it."""
        key = F.struct(*self.by)
        first, last = free_names([*self.columns, *folds], "first_key", "last_key")
        ends = rows.groupBy(self.range).agg(F.min(key).alias(first), F.max(key).alias(last))
        parts = rows.groupBy(self.range, *self.by).agg(*(f.alias(n) for n, f in folds.items()))
        # As many rows as there are ranges.
        return parts.join(F.broadcast(ends), self.range).where(key.eqNullSafe(F.col(first)) | key.eqNullSafe(F.col(last))).drop(first, last)

    def carried(self, rows: DataFrame, states: DataFrame, **carry: Column) -> DataFrame:
        """The rows with what ``carry`` says over ``states``; null for keys that are in one range."""
        told = states.withColumns(carry).select(self.range, *self.by, *carry)
        names = free_names([*rows.columns, *carry], *(f"c{i}" for i in range(len(self.by) + 1)))
        told = told.withColumnsRenamed(dict(zip([self.range, *self.by], names, strict=True)))
        same = reduce(lambda a, b: a & b, (rows[c].eqNullSafe(told[n]) for c, n in zip([self.range, *self.by], names, strict=True)))
        # Two rows a range at most.
        return rows.join(F.broadcast(told), same, "left").drop(*names)


def running_sums(rows: DataFrame, by: list[str], order: list[Column | str], values: dict[str, Column], peers: bool = False) -> DataFrame:
    """The rows with sums of ``values`` over each key's rows up to each row; with ``peers`` up to all rows of equal order. Columns named like a value are replaced."""
    ranges = Ranges(rows, by, order)
    frame = ranges.within.rangeBetween if peers else ranges.within.rowsBetween
    upto = frame(Window.unboundedPreceding, Window.currentRow)
    taken = free_names([*rows.columns, *values], *(f"v{i}" for i in range(len(values))))
    local = ranges.rows.withColumns(dict(zip(taken, values.values(), strict=True)))
    states = ranges.states(local, **{t: F.sum(t) for t in taken})
    summed = local.withColumns({n: F.sum(t).over(upto) for n, t in zip(values, taken, strict=True)}).drop(*taken)
    before = dict(zip(taken, free_names([*rows.columns, *values, *taken], *(f"b{i}" for i in range(len(taken)))), strict=True))
    told = ranges.carried(summed, states, **{before[t]: F.sum(t).over(ranges.before) for t in taken})
    return told.select(*(c for c in rows.columns if c not in values), *((F.col(n) + F.coalesce(before[t], F.lit(0))).alias(n) for n, t in zip(values, taken, strict=True)))


def rolling_sums(rows: DataFrame, by: list[str], at: str, values: list[str], spans: dict[str, int]) -> DataFrame:
    """Each row of (by, at, values) with sums ``<value>_<span>`` over its key's rows from at - span on to its own at.

    ``at`` and the spans are whole numbers, (by, at) is to be unique. A value
    is added where it is and taken off when it is too old, so a sum over a
    window is a running sum over both: a key with most of the rows is many
    tasks, and no row is compared with others.
    """
    span_, out_, own_ = free_names([*rows.columns, *values], "span", "out", "own")
    each = rows.select(*by, at, *values, F.explode(F.array(*map(F.lit, spans.values()))).alias(span_))
    added = each.select(*by, span_, F.col(at), *values, F.lit(False).alias(out_))
    # At one place what is too old goes first.
    gone = each.select(*by, span_, (F.col(at) + F.col(span_) + 1).alias(at), *((-F.col(v)).alias(v) for v in values), F.lit(True).alias(out_))
    sums = running_sums(added.unionByName(gone), [*by, span_], [F.col(at), F.col(out_).desc()], {f"{v}{own_}": F.col(v) for v in values})
    held = sums.where(~F.col(out_)).groupBy(*by, at)
    return held.agg(*(F.max(F.when(F.col(span_) == width, F.col(f"{v}{own_}"))).alias(f"{v}_{name}") for name, width in spans.items() for v in values))
