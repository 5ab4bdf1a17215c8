"""Mixing of sources to target weights by entropy balancing, with DataFrame functions only.

Documents start at a rate of 1. The rates nearest to that in relative entropy
at which each source has its target of words, none above ``most``, are the
least of ``most`` and exp(lambda * words), with one lambda a source. It solves
the convex dual: each Newton step sums words and slopes over (source, size)
classes on all tasks and moves every source's lambda at once, inside of a
bracket. Sums are of decimals, so that they do not depend on their order.

Rates become whole copies class by class: running sums of rates are rounded
from the longest class down, and what is then missing or too much is taken up
by single documents, again from the longest down. Inside a class the documents of smallest
hash get one copy more; a large class is ranked in chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkweft.llm import common

SPACE = " \t\n\x0b\x0c\r"
#: Sizes up to 2^EXACT_BITS are classes of their own, above it so many leading bits are: the source's classes are bounded.
EXACT_BITS = 12
#: Rows of a chunk in which a class is ranked, or the root of the class's rows where that is more.
CHUNK_ROWS = 1024
#: What a source may miss of its target before its copies are rounded.
RELATIVE, WORDS = 1e-6, 0.01
#: Sources of a file of the tables that have a row a source.
FILE_SOURCES = 100_000
#: Newton steps at most; every fourth halves the bracket, so far fewer suffice.
MOST_STEPS = 400
EXACT = "decimal(38,6)"


def words(text: Column) -> Column:
    """The number of runs of anything but SPACE; null has none."""
    one_each = F.regexp_replace(text, r"[^\x20\x09-\x0D]+", "w")
    return F.coalesce(F.char_length(F.translate(one_each, SPACE, "")), F.lit(0)).cast("bigint")


def size_class(size: Column) -> Column:
    """The size with all but its leading bits cleared."""
    unit = F.pow(F.lit(2), F.greatest(F.length(F.bin(size)) - EXACT_BITS, F.lit(0))).cast("bigint")
    return size - size % unit


def numbered(rows: DataFrame, column: str, name: str) -> DataFrame:
    """Running numbers from 0 in the order of the column, null last, without all rows in one task."""
    pid, before = common.fresh_names(rows, "pid", "before")
    spark = rows.sparkSession
    dealt = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), F.col(column).asc_nulls_last())
    dealt = common.staged(dealt.withColumn(pid, F.spark_partition_id()), "dealt")
    # As many rows as there are partitions.
    counts = dealt.groupBy(pid).agg(F.count("*").alias(before))
    counts = counts.withColumn(before, F.sum(before).over(Window.orderBy(pid)) - F.col(before))
    place = F.row_number().over(Window.partitionBy(pid).orderBy(F.col(column).asc_nulls_last()))
    return dealt.withColumn(name, place).join(counts, pid).withColumn(name, F.col(name) + F.col(before) - 1).drop(pid, before)


def targets(sources: DataFrame, percent: float, most: float) -> DataFrame:
    """With ``target``: the shares by ``weight`` of a total of percent of all ``source_size``, none above its ``cap``; the excess is shared again."""
    total = (sources.agg(F.sum("source_size").alias("t")).first().t or 0) * percent / 100
    level, capped = 0.0, -1
    while True:
        above = F.col("weight") * level >= F.col("cap") if capped >= 0 else F.lit(False)
        r = sources.agg(F.count_if(above).alias("n"), F.sum(F.when(above, F.col("cap")).otherwise(0.0)).alias("fixed"), F.sum(F.when(~above, F.col("weight"))).alias("open")).first()
        if r.n == capped or not r.open:
            full = not r.open
            break
        capped, level = r.n, (total - r.fixed) / r.open
    return sources.withColumn("target", F.col("cap") if full else F.least("cap", F.col("weight") * level))


def rate(size: Column, most: float) -> Column:
    """The rate of documents of that size, from their source's columns fixed, lam and mean."""
    return F.coalesce("fixed", F.least(F.lit(float(most)), F.exp(F.col("lam") * size / F.col("mean"))))


def balanced(sources: DataFrame, classes: DataFrame, most: float) -> DataFrame:
    """The sources with lam, mean and fixed, so that ``rate`` gives their classes (no, size, n) the target of words.

    A source whose target is nothing or all that it can give has a fixed rate.
    """
    fixed = F.when(F.col("target") >= F.col("cap"), float(most)).when(F.col("target") <= 0, 0.0)
    none = F.lit(None).cast("double")
    files = sources.count() // FILE_SOURCES + 1
    state = common.staged(sources.coalesce(files).withColumns({"fixed": fixed, "lam": F.lit(0.0), "low": none, "high": none, "done": fixed.isNotNull()}), "duals")
    for step in range(MOST_STEPS):
        if not state.where("NOT done").count():
            return state.drop("low", "high", "done")
        here = F.col("lam") * F.col("size") / F.col("mean")
        has = (F.col("n") * F.col("size")) * F.least(F.lit(float(most)), F.exp(here))
        slope = F.when(F.exp(here) < most, has * F.col("size") / F.col("mean")).otherwise(0.0)
        sums = classes.join(state.where("NOT done").select("no", "lam", "mean"), "no").groupBy("no").agg(F.sum(has.cast(EXACT)).cast("double").alias("has"), F.sum(slope.cast(EXACT)).cast("double").alias("slope"))
        gap, lam, reach = F.col("has") - F.col("target"), F.col("lam"), F.abs("lam") + 2
        low, high = F.when(gap < 0, lam).otherwise(F.col("low")), F.when(gap > 0, lam).otherwise(F.col("high"))
        newton = F.greatest(lam - reach, F.least(lam + reach, F.when(F.col("slope") > 0, lam - gap / F.col("slope")).otherwise(lam - F.signum(gap) * reach)))
        inside = (newton > F.coalesce("low_", F.lit(float("-inf")))) & (newton < F.coalesce("high_", F.lit(float("inf"))))
        half = (F.col("low_") + F.col("high_")) / 2
        # Both ends known and the step leaves them, or its turn has come: the middle.
        moved = F.when(half.isNotNull() & (~inside | F.lit(step % 4 == 3)), half).otherwise(newton)
        met = F.coalesce(F.abs(gap) <= RELATIVE * F.col("target") + WORDS, F.lit(False))
        told = state.join(sums, "no", "left").withColumns({"low_": low, "high_": high}).withColumns({"met": F.col("done") | met, "moved": moved})
        kept = [c for c in state.columns if c not in ("lam", "low", "high", "done")]
        state = common.staged(told.select(*kept, F.when(F.col("met"), lam).otherwise(F.col("moved")).alias("lam"), F.col("low_").alias("low"), F.col("high_").alias("high"), F.col("met").alias("done")).coalesce(files), "duals")
    raise ArithmeticError(f"the dual was not solved in {MOST_STEPS} steps")


def copies(classes: DataFrame, most: int) -> DataFrame:
    """(no, class, n, copies): what the documents of each class are taken in all.

    Running sums of rates, from the longest class down, are rounded, which
    leaves a source within about its longest document of its target; then each
    class, down to the shortest, takes up what of the rest it brings nearer to
    nothing. A source's classes are bounded by EXACT_BITS, whatever its rows.
    """
    down = Window.partitionBy("no").orderBy(F.desc("class"))
    upto = F.sum("wanted").over(down.rowsBetween(Window.unboundedPreceding, 0))
    sized = classes.withColumn("upto", upto)
    taken = F.round("upto").cast("bigint") - F.round(F.col("upto") - F.col("wanted")).cast("bigint")
    sized = sized.select("no", "class", "n", "target", (F.col("words") / F.col("n")).alias("mean"), F.when(F.col("class") > 0, taken).otherwise(0).alias("copies"))
    one = F.struct("class", "mean", "n", "copies")
    lists = sized.where("class > 0").groupBy("no", "target").agg(F.sort_array(F.collect_list(one), asc=False).alias("all"))
    left = F.aggregate("all", F.col("target"), lambda e, x: e - x["copies"] * x["mean"])
    fit = lambda e, x: F.greatest(-x["copies"].cast("double"), F.least((x["n"] * most - x["copies"]).cast("double"), F.round(e / x["mean"]))).cast("bigint")

    def step(acc, x):
        by = fit(acc["left"], x)
        some = F.concat(acc["fixes"], F.array(F.struct(x["class"].alias("class"), by.alias("by"))))
        return F.struct((acc["left"] - by * x["mean"]).alias("left"), F.when(by == 0, acc["fixes"]).otherwise(some).alias("fixes"))

    empty = F.struct(F.col("left"), F.array().cast("array<struct<class:bigint,by:bigint>>").alias("fixes"))
    fixes = lists.withColumn("left", left).select("no", F.explode(F.aggregate("all", empty, step, lambda acc: acc["fixes"])).alias("fix"))
    by = fixes.select("no", F.col("fix.class").alias("class"), F.col("fix.by").alias("by"))
    return sized.join(by, ["no", "class"], "left").select("no", "class", "n", (F.col("copies") + F.coalesce("by", F.lit(0))).alias("copies"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), percent: float = 150, most: int = 2, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``id_col``, size, source_size, target, rate, copies and taken of every document.

    Sizes are words; a null text has none. Sources are numbered by code point,
    null, a source like any other, last, and weigh ``weights`` in turn. Their
    targets share ``percent`` of all words by weight; none is above ``most``
    times its source's size, the excess goes to the others by weight. taken is
    copies times size, copies at most ``most``; an empty text has no copy. A
    source's taken words come within half its shortest text of its target, but
    for texts of over 2^EXACT_BITS words, which are told apart to 1 in 2,048, or
    where the texts that would fit are used up. Rows with equal ids are rows of
    their own, and with equal source and size too they are exchangeable. Reruns
    agree. Other columns do not matter; an empty table gives an empty one.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), words(F.col(text_col)).alias("size"))
    # Equal rows are one with their number, so that no group of them is ranked in one task.
    rows = common.staged(rows.groupBy("id", "source", "size").agg(F.count("*").alias("times")), "sizes")
    of = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("times")).alias("source_size"), F.sum("times").alias("docs"))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("no") % len(weights) + 1).cast("int"))
    sources = numbered(of, "source", "no").withColumns({"weight": weight, "cap": F.col("source_size") * float(most), "mean": F.greatest(F.col("source_size") / F.col("docs"), F.lit(1.0))})
    sources = targets(common.staged(sources, "sources"), percent, most)
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    sizes = rows.groupBy("source", "size").agg(F.sum("times").alias("n"))
    sizes = common.staged(sizes.join(sources.select("source", "no"), same(sizes, sources)).select("no", "size", "n"), "classes")
    sources = balanced(sources, sizes, most)
    rated = sizes.join(sources, "no").withColumn("rate", F.when(F.col("size") > 0, rate(F.col("size"), most)).otherwise(0.0))
    classes = rated.groupBy("no", size_class(F.col("size")).alias("class")).agg(F.first("target").alias("target"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("size")).alias("words"), F.sum((F.col("n") * F.col("rate")).cast(EXACT)).alias("wanted"))
    plan = copies(classes, most).join(sources, "no")
    rows_per = F.greatest(F.lit(float(CHUNK_ROWS)), F.sqrt("n"))
    plan = common.staged(plan.withColumn("chunks", F.ceil(F.col("n") / rows_per)), "plan")
    dealt = rows.withColumns({"h": F.xxhash64("id"), "class": size_class(F.col("size"))})
    dealt = dealt.join(plan.withColumnsRenamed({"source": "source_", "class": "class_"}), dealt["source"].eqNullSafe(F.col("source_")) & (F.col("class") == F.col("class_")))
    dealt = dealt.withColumn("chunk", F.floor(F.pmod("h", F.lit(1 << 31)) * F.col("chunks") / (1 << 31)).cast("bigint"))
    counts = dealt.where("chunks > 1").groupBy("no", "class", "chunk").agg(F.sum("times").alias("before"))
    counts = counts.withColumn("before", F.sum("before").over(Window.partitionBy("no", "class").orderBy("chunk")) - F.col("before"))
    order = Window.partitionBy("no", "class", "chunk").orderBy(F.pmod("h", F.lit(1 << 31)), "h", F.col("id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, 0)
    ranked = dealt.withColumn("upto", F.sum("times").over(order)).join(counts, ["no", "class", "chunk"], "left")
    base = F.floor(F.col("copies") / F.col("n"))
    first = F.col("upto") - F.col("times") + F.coalesce("before", F.lit(0))
    more = F.col("copies") - base * F.col("n") - first
    each = ranked.withColumns({"rate": F.when(F.col("size") > 0, rate(F.col("size"), most)).otherwise(0.0), "base": base, "more": more}).withColumn("i", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("times"))))
    each = each.withColumn("taken_copies", F.col("base") + (F.col("i") <= F.col("more")).cast("bigint"))
    return each.select(F.col("id").alias(id_col), "size", "source_size", "target", "rate", F.col("taken_copies").alias("copies"), (F.col("taken_copies") * F.col("size")).alias("taken"))


def repeated(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The documents of a mix, each as many times as it is taken, with ``copy`` from 1; ids are to be unique and not null."""
    times = mixed.select(F.col(id_col).alias("__id"), F.col("copies").alias("__copies")).where("__copies > 0")
    joined = docs.drop("copy").join(times, F.col(id_col) == F.col("__id"))
    return joined.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("__copies")))).drop("__id", "__copies")
