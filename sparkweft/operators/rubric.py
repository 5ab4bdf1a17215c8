"""Rubric texts as numbered items, and verdicts that keep to their schema or name what breaks it."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What a line that is no item says of the items after it; the first that fits counts.
SECTIONS = {
    "forbidden": r"(?iU)\b(must|should|may) not\b|\bforbidden\b|false positive|не должен|запрещ",
    "bonus": r"(?iU)\bbonus\b|\boptional\b|бонус|дополнительн",
    "required": r"(?iU)\b(must|should|required?|has to)\b|обязан|обязательн|должен",
}
#: An item's number or mark, and its text.
ITEM = r"^ {0,3}(?:\d+[.)]|[-*+])[ \t]+(.*)$"
#: What marks a single item as a bonus one.
BONUS_ITEM = r"(?iU)^[*_(\[ ]*(bonus|бонус)\b"
#: Names of a verdict and the words of its verdict.
VERDICT_NAMES, VERDICT_WORDS = ("verdict", "matched", "missed", "notes"), ("pass", "fail")


def rubric_items(rubrics: DataFrame, key: str, text: str) -> DataFrame:
    """(key, item, kind, text): the items of each rubric, numbered from 1 through all sections, as verdicts count them.

    A line that is no item and that speaks of bonus, forbidden or required
    points opens a section; until one does, items are required. An item goes
    on over the lines after it up to a blank line, the next item or an unindented line that
    opens a section. Lines in fences are no items. Keys are unique; a null text has no
    items. A rubric's lines are one task's.
    """
    lines = rubrics.select(F.col(key).alias("k"), F.posexplode(F.split(F.regexp_replace(F.col(text), "\r\n?", "\n"), "\n", -1)).alias("pos", "line"))
    w = Window.partitionBy("k").orderBy("pos")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    fence = F.col("line").rlike(r"^\s*(```|~~~)")
    lines = lines.withColumn("fenced", (F.sum(F.when(fence, 1).otherwise(0)).over(upto) % 2 == 1) | fence)
    item, blank = ~F.col("fenced") & F.col("line").rlike(ITEM), F.trim("line") == ""
    opens = F.lit(None).cast("string")
    for kind, pattern in reversed(SECTIONS.items()):
        opens = F.when(F.col("line").rlike(pattern), kind).otherwise(opens)
    opens = F.when(~item & ~blank & ~F.col("fenced") & F.col("line").rlike(r"^\S"), opens)
    told = lines.withColumns({"is_item": item, "opens": opens})
    told = told.withColumns({"section": F.coalesce(F.last("opens", ignorenulls=True).over(upto), F.lit("required")), "item": F.sum(F.col("is_item").cast("int")).over(upto), "stops": blank | F.col("opens").isNotNull() | F.col("fenced")})
    # A line goes on with the item before it if nothing has stopped that since.
    at = F.last(F.when(F.col("is_item"), "item").when(F.col("stops"), "stop"), ignorenulls=True).over(upto)
    parts = told.withColumn("at", at).where("at = 'item' AND item > 0")
    piece = F.struct("pos", F.trim(F.when(F.col("is_item"), F.regexp_extract("line", ITEM, 1)).otherwise(F.col("line"))).alias("line"))
    whole = parts.groupBy("k", "item").agg(F.sort_array(F.collect_list(piece)).alias("p"), F.min_by("section", "pos").alias("section"))
    said = F.array_join(F.transform("p", lambda x: x["line"]), " ")
    kind = F.when((F.col("section") == "required") & said.rlike(BONUS_ITEM), "bonus").otherwise(F.col("section"))
    return whole.select(F.col("k").alias(key), F.col("item").cast("int").alias("item"), kind.alias("kind"), said.alias("text"))


def verdict_faults(output: Column, items: Column | None = None) -> Column:
    """What keeps a verdict from being one, as names in a fixed order; an empty array if it is in order.

    A verdict is an object with the word pass or fail, two lists of whole item
    numbers and notes, and nothing else. With ``items``, the number of items of its
    rubric, numbers beyond it are a fault. So is an item both matched and missed, and a pass that misses any.
    """
    v = F.try_parse_json(output)
    kind = lambda name: F.schema_of_variant(F.variant_get(v, f"$.{name}", "variant"))
    numbers = lambda name: F.when(kind(name).isin("ARRAY<BIGINT>", "ARRAY<VOID>"), F.try_variant_get(v, f"$.{name}", "array<bigint>"))
    is_object = F.coalesce(F.startswith(F.schema_of_variant(v), F.lit("OBJECT<")), F.lit(False))
    names = F.json_object_keys(output)
    matched, missed = numbers("matched"), numbers("missed")
    all_numbers = F.concat(F.coalesce(matched, F.array().cast("array<bigint>")), F.coalesce(missed, F.array().cast("array<bigint>")))
    word = F.try_variant_get(v, "$.verdict", "string")
    high = F.coalesce(F.exists(all_numbers, lambda x: x > items), F.lit(False)) if items is not None else F.lit(False)
    checks = [
        (~F.coalesce(word.isin(*VERDICT_WORDS) & (kind("verdict") == "STRING"), F.lit(False)), "verdict"),
        (matched.isNull(), "matched"), (missed.isNull(), "missed"),
        (~F.coalesce(kind("notes") == "STRING", F.lit(False)), "notes"),
        (F.size(F.array_except(names, F.array(*map(F.lit, VERDICT_NAMES)))) > 0, "unknown name"),
        (F.exists(all_numbers, lambda x: x < 1) | high, "no such item"),
        (F.coalesce(F.arrays_overlap(matched, missed), F.lit(False)), "matched and missed"),
        (F.coalesce((word == "pass") & (F.size(missed) > 0), F.lit(False)), "pass with missed items"),
    ]
    faults = F.filter(F.array(*(F.when(c, name) for c, name in checks)), lambda x: x.isNotNull())
    return F.when(v.isNull(), F.array(F.lit("no JSON"))).when(~is_object, F.array(F.lit("no object"))).otherwise(faults)
