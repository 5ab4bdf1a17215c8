"""Dependencies between columns, candidate keys, and what breaks the second and third normal form.

The lattice of column sets is searched level by level. All sets of a level are
grouped in one job, partial results before the shuffle, and come back as a row
a set. Whether a set determines a column shows in its classes: a class of one
row holds any dependency, so only larger ones are looked at, and a set that has
none is a key, whose supersets need no look.
"""

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkweft.sources.staging import free_names


def _level(rows: DataFrame, sets: list[tuple[str, ...]], columns: list[str]) -> dict[tuple[str, ...], tuple[bool, set[str]]]:
    """For each set: whether it is a key, and the columns that it determines."""
    n, number = free_names(columns, "n", "number")
    alike = lambda c: (F.count(c) == 0) | ((F.count(c) == F.count("*")) & F.min(c).eqNullSafe(F.max(c)))
    used = sorted({c for x in sets for c in x})
    told = {c: t for c, t in zip(columns, free_names([*columns, n, number], *(f"c{i}" for i in range(len(columns)))), strict=True)}
    each = [F.count("*").alias(n), *(alike(c).alias(t) for c, t in told.items())]
    if used:
        # The bits of grouping_id tell the set: 1 for a column that is not in it.
        groups = rows.groupingSets([[F.col(c) for c in x] for x in sets], *used).agg(F.grouping_id().alias(number), *each)
    else:
        groups = rows.agg(*each).withColumn(number, F.lit(0).cast("bigint"))
    large = F.col(n) > 1
    out = groups.groupBy(number).agg(F.max(n).alias(n), *(F.bool_and(F.when(large, F.col(t))).alias(t) for t in told.values()))
    bits = {sum(1 << (len(used) - 1 - i) for i, c in enumerate(used) if c not in x): x for x in sets}
    return {bits[r[number]]: (r[n] <= 1, {c for c, t in told.items() if r[t] is not False}) for r in out.collect()}


def dependencies(rows: DataFrame, columns: list[str] | None = None, most: int = 3) -> tuple[list[tuple[tuple[str, ...], str]], list[tuple[str, ...]]]:
    """The minimal dependencies (set, column) of sets of up to ``most`` columns, and the minimal keys among these sets.

    Null is a value like any other. The empty set determines constant columns.
    In an empty table it determines all, and is the key. What comes to the
    driver is a row for each set looked at.
    """
    columns = columns or rows.columns
    found, keys = [], []
    for size in range(min(most, len(columns)) + 1):
        small = [set(k) for k in keys]
        sets = [x for x in combinations(columns, size) if not any(k <= set(x) for k in small)]
        known = lambda x, c: any(d == c and set(y) <= set(x) for y, d in found)
        # A set of which one column follows from the others says no more than they do.
        sets = [x for x in sets if not any(known([c for c in x if c != d], d) for d in x)]
        if not sets:
            continue
        told = _level(rows, sets, columns)
        new = []
        for x in sets:
            is_key, determined = told.get(x, (True, set(columns)))
            if is_key:
                keys.append(x)
            new += [(x, c) for c in columns if c not in x and c in determined and not known(x, c)]
        found += new
    return found, keys


def normal_forms(rows: DataFrame, columns: list[str] | None = None, most: int = 3) -> DataFrame:
    """(determinant, dependent, breaks) of each minimal dependency; determinants are sorted names joined by commas.

    breaks is 2NF where part of a key determines a column that is in no key,
    3NF where another set that is no superkey does, and else null. Keys of
    more than ``most`` columns are not found, and columns that only they have count as in no key.
    """
    found, keys = dependencies(rows, columns, most)
    prime = {c for k in keys for c in k}

    def breaks(x: tuple[str, ...], c: str) -> str | None:
        if c in prime or any(set(k) <= set(x) for k in keys):
            return None
        return "2NF" if any(set(x) < set(k) for k in keys) else "3NF"

    rows_of = [(",".join(sorted(x)), c, breaks(x, c)) for x, c in found]
    return rows.sparkSession.createDataFrame(rows_of, "determinant string, dependent string, breaks string")


def holds_everywhere(rows: DataFrame, determinant: list[str], dependent: str) -> DataFrame:
    """(holds, violations) of one dependency of any set of columns; null is a value."""
    same = (F.count(dependent) == 0) | ((F.count(dependent) == F.count("*")) & F.min(dependent).eqNullSafe(F.max(dependent)))
    groups = rows.groupBy(*determinant).agg(same.alias("_same"))
    return groups.agg(F.coalesce(F.bool_and("_same"), F.lit(True)).alias("holds"), F.count_if(~F.col("_same")).alias("violations"))
