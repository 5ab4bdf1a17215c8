"""Deep merge of JSON documents as relations: a row for each place in a document.

The texts that meet under a key are numbered, each pair once however many
keys it has. A pair is flattened to (pair, path, depth, name, kind, value) of
both sides, what lies under an overwritten object is dropped, and the rows in
order of their paths are written as a document again. In that order all that
is in an object follows it at once, so each of these steps looks at
neighbouring rows only, at any depth.
"""

import json
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkweft.operators.merge import ordered_union_json
from sparkweft.sources.staging import free_names, written

#: The tokens of JSON.
TOKEN = re.compile(r'[ \t\n\r]*(?:([{}\[\],:])|("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][-+]?\d+)?|true|false|null)(?![\w.+-]))')
REST = re.compile(r"[ \t\n\r]*\Z")
#: Between the names of a path, which are escaped to ASCII, so that it is in none.
STEP = "\x00"
NODE = "path string, depth int, name string, kind string, value string"


def path_of(names: Iterable[str]) -> str:
    return "".join(STEP + json.dumps(n)[1:-1] for n in names)


def places(text: str | None) -> Iterator[tuple[str, int, str | None, str, str | None]]:
    """path, depth, name, kind (object, list, scalar) and value of all that is in an object; lists are values as a whole.

    Null and blank texts are an empty object. ValueError for what is no JSON
    object, or has an object that repeats a name. There is no limit of depth.
    """
    if text is None or not text.strip():
        yield "", 0, None, "object", None
        return
    # A list's entry in ``open_`` has no names; ``wanted`` is what may come next.
    open_, wanted, at, path, name, lists, began = [], "object", 0, "", None, 0, 0
    while True:
        token = TOKEN.match(text, at)
        if token is None or wanted == "end":
            if wanted == "end" and REST.match(text, at):
                return
            raise ValueError(f"no JSON object at {at}")
        at = token.end()
        sign, string, scalar = token.groups()
        done = False
        if wanted in ("key", "key or }") and string:
            plain = string.isascii() and string.isprintable() and "\\" not in string
            told, wanted = string[1:-1] if plain else json.dumps(json.loads(string))[1:-1], ":"
            if told in open_[-1][1]:
                raise ValueError(f"an object repeats a name at {at}")
            open_[-1][1].add(told)
            if not lists:
                name, path = told, open_[-1][0] + STEP + told
        elif wanted == ":" and sign == ":":
            wanted = "value"
        elif wanted in ("value", "value or ]", "object") and sign == "{":
            if not lists:
                yield path, len(open_), None if name is None else f'"{name}"', "object", None
            open_.append((path, set()))
            wanted = "key or }"
        elif wanted in ("value", "value or ]") and sign == "[":
            if not lists:
                began = token.start(1)
            open_.append((path, None))
            lists += 1
            wanted = "value or ]"
        elif wanted in ("value", "value or ]") and (string or scalar):
            if not lists:
                yield path, len(open_), f'"{name}"', "scalar", string or scalar
            done = True
        elif wanted in ("key or }", ", or end") and sign == "}" and open_[-1][1] is not None:
            path = open_.pop()[0]
            done = True
        elif wanted in ("value or ]", ", or end") and sign == "]" and open_[-1][1] is None:
            path = open_.pop()[0]
            lists -= 1
            if not lists:
                yield path, len(open_), f'"{name}"', "list", text[began:at]
            done = True
        elif wanted == ", or end" and sign == ",":
            wanted = "value" if open_[-1][1] is None else "key"
        else:
            raise ValueError(f"no JSON object at {at}")
        if done:
            wanted = ", or end" if open_ else "end"


def merged_places(base: str, overlay: str) -> list[tuple]:
    """path, depth_b, name, b, value_b, depth_o, o, value_o of what is in either object, in order of path; one row of the kind rejected if a text is none."""
    try:
        b, o = ({path: (depth, name, kind, value) for path, depth, name, kind, value in places(text)} for text in (base, overlay))
    except ValueError:
        return [("", 0, None, "rejected", None, None, None, None)]
    none = (None, None, None, None)
    rows = []
    for path in sorted(b.keys() | o.keys()):
        x, y = b.get(path, none), o.get(path, none)
        rows.append((path, x[0], x[1] or y[1], x[2], x[3], y[0], y[2], y[3]))
    return rows


def flatten(pairs: DataFrame) -> DataFrame:
    """(pair, path, ...) of every place in the two documents ``base`` and ``overlay`` of each row, joined by path."""
    names = ["pair", "path", "depth_b", "name", "b", "value_b", "depth_o", "o", "value_o"]
    kinds = [pa.int64(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string()]
    schema = pa.schema(list(zip(names, kinds, strict=True)))

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for i, base, overlay in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows += ((i, *r) for r in merged_places(base, overlay))
                for _ in range(len(rows) // 4096):
                    yield made(rows[:4096])
                    del rows[:4096]
            if rows:
                yield made(rows)

    return pairs.select("pair", "base", "overlay").mapInArrow(run, "pair bigint, path string, depth_b int, name string, b string, value_b string, depth_o int, o string, value_o string")


def merge_documents(base: DataFrame, overlay: DataFrame, key: str, doc: str, union=(), equality: str = "host") -> DataFrame:
    """(key, doc, outcome) for the documents of both sides, each of which has a row for a key.

    The overlay wins, objects merge name by name, null overwrites, lists are
    replaced, or united at a path (a tuple of names) in ``union``. A side that
    lacks a key, null and blank texts are empty objects. ``outcome`` is current if
    the overlay changes nothing that is written, merged if it does, and rejected, without doc,
    if a text is no JSON object or an object in it repeats a name. Scalars
    and lists are taken over as they are written. Names come in the order of
    their escaped forms. One task holds a document's places, as it holds a text.
    Texts that meet under many keys are merged once.
    """
    text = lambda side: F.coalesce(side[doc], F.lit(""))
    b, o = base.select(key, text(base).alias("base")), overlay.select(key, text(overlay).alias("overlay"))
    both = b.join(o, key, "full_outer").select(key, F.coalesce("base", F.lit("")).alias("base"), F.coalesce("overlay", F.lit("")).alias("overlay"))
    return both.join(_merged(both, union, equality), ["base", "overlay"]).select(key, F.col("doc").alias(doc), "outcome")


def merge_texts(rows: DataFrame, base: Column, overlay: Column, keep: list[str], union=(), equality: str = "host") -> DataFrame:
    """The kept columns with doc and outcome, as above, for each row of a table that has both texts.

    No row is shuffled to meet its texts, and none needs a key. The merged
    pairs are a written table, whose size is known: where they are few they
    go to the rows, else both are joined by their texts.
    """
    base_, overlay_ = free_names([*keep, "doc", "outcome"], "base", "overlay")
    held = rows.select(*keep, F.coalesce(base, F.lit("")).alias(base_), F.coalesce(overlay, F.lit("")).alias(overlay_))
    made = written(_merged(held.select(F.col(base_).alias("base"), F.col(overlay_).alias("overlay")), union, equality), "merged")
    return held.join(made.toDF(base_, overlay_, "doc", "outcome"), [base_, overlay_], "left").select(*keep, "doc", "outcome")


def _merged(both: DataFrame, union, equality: str) -> DataFrame:
    """(base, overlay, doc, outcome) of every pair of texts, once."""
    # Written, so that the number of a pair stays the same wherever its rows are made again.
    pairs = written(both.select("base", "overlay").distinct().withColumn("pair", F.monotonically_increasing_id()), "pairs")
    n = int(both.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a small file of pairs is much work
    return merge_pairs(pairs.repartition(n, "pair"), union, equality).join(pairs, "pair").select("base", "overlay", "doc", "outcome")


def merge_pairs(pairs: DataFrame, union=(), equality: str = "host") -> DataFrame:
    """(pair, doc, outcome) for rows of (pair, base, overlay); all steps keep a pair's places together, which are shuffled once."""
    by = Window.partitionBy("pair")
    united = F.col("path").isin(*map(path_of, union)) & (F.col("b") == "list") & (F.col("o") == "list") if union else F.lit(False)
    kind, value = F.coalesce("o", "b"), F.when(F.col("o").isNull(), F.col("value_b")).otherwise(F.col("value_o"))
    changed = F.col("o").isNotNull() & ~(F.col("b").eqNullSafe(F.col("o")) & F.col("value_b").eqNullSafe(F.col("value_o")))
    merged = flatten(pairs).select(
        "pair", "path", F.coalesce("depth_o", "depth_b").alias("depth"), "name", kind.alias("kind"), value.alias("value"), united.alias("united"), "value_b", changed.alias("changed"),
        F.when((F.col("b") == "object") & (F.col("o") != "object"), F.col("path")).alias("over"),
    )
    if union:
        lists = merged.withColumn("value", F.when(F.col("united"), _united(F.col("value"), F.col("value_b"), equality)).otherwise(F.col("value")))
        merged = lists.withColumn("changed", F.when(F.col("united"), F.col("value") != F.regexp_replace("value_b", r"\s*\n\s*", "")).otherwise(F.col("changed")))
    in_order = by.orderBy("path")
    # No overwritten object lies in another, so only the last one before a place can hold it.
    over = F.last("over", ignorenulls=True).over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    told = merged.withColumns({"last_over": over, "any": F.max(F.coalesce("changed", F.lit(False)) & (F.col("path") != "")).over(by)})
    kept = told.where(~F.coalesce(F.startswith("path", F.concat("last_over", F.lit(STEP))), F.lit(False)))
    around = kept.withColumns({"before": F.lag("depth").over(in_order), "after": F.coalesce(F.lead("depth").over(in_order), F.lit(0)), "place": F.row_number().over(in_order)})
    comma = F.when(F.col("before") >= F.col("depth"), ",").otherwise("")
    name = F.when(F.col("name").isNotNull(), F.concat("name", F.lit(":"))).otherwise("")
    opened = (F.col("kind") == "object") & (F.col("after") > F.col("depth"))
    body = F.when(opened, "{").when(F.col("kind") == "object", "{}").otherwise(F.col("value"))
    ends = F.when(opened, 0).otherwise(F.col("depth") - F.col("after"))
    piece = F.concat(comma, name, body, F.repeat(F.lit("}"), ends))
    pieces = around.groupBy("pair").agg(F.sort_array(F.collect_list(F.struct("place", piece.alias("piece")))).alias("p"), F.max("any").alias("any"), F.max(F.col("kind") == "rejected").alias("rejected"))
    outcome = F.when(F.col("rejected"), "rejected").when(F.col("any"), "merged").otherwise("current")
    return pieces.select("pair", F.when(~F.col("rejected"), F.array_join(F.transform("p", lambda x: x["piece"]), "")).alias("doc"), outcome.alias("outcome"))


def _united(overlay: Column, base: Column, equality: str) -> Column:
    items = lambda text: F.transform(F.from_json(text, "array<variant>"), lambda v: F.to_json(v))
    return F.concat(F.lit("["), F.array_join(ordered_union_json(items(overlay), items(base), equality), ","), F.lit("]"))
