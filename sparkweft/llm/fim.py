"""Fill-in-middle: texts cut between units and put together again with the middle last.

A grammar of units is an alternation of sequences of character classes, such
as ``w+|s+`` for runs of word characters and runs of spaces. Units are told by
the two code points beside a place, so a grammar becomes a regular expression
of no width, a look back for one class and a look ahead for another, and
Spark's split at it keeps every piece. Texts are split block by block, one code
point over, so that an array of pieces is never longer than BLOCK + 1.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkweft.llm.common import fresh_names

#: Grammars: classes by letter, which together hold every code point once, and the units as sequences of classes.
GRAMMARS = {
    "char": ({"x": "(?s:.)"}, "x"),
    "word": ({"w": r"[^\x20\x09-\x0D]", "s": r"[\x20\x09-\x0D]"}, "w+|s+"),
    "line": ({"c": r"[^\n]", "n": r"\n"}, "c*n|c+"),
}
#: Code points of a block that is split at once.
BLOCK = 1 << 16
#: Marks of prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")


def boundary(classes: dict[str, str], units: str) -> str:
    """The places between units, as a regular expression of no width.

    Units are matched left to right and as long as can be, so two classes are
    apart wherever no unit holds the one right before the other.
    """
    inside = set()
    for unit in units.split("|"):
        parts = re.findall(r"(\w)([+*]?)", unit)
        for i, (a, many) in enumerate(parts):
            if many:
                inside.add((a, a))
            for b, repeat in parts[i + 1 :]:
                inside.add((a, b))
                if repeat != "*":
                    break
    cuts = [(classes[a], [classes[b] for b in classes if (a, b) not in inside]) for a in classes]
    return "|".join(f"(?<={left})(?={'|'.join(right)})" for left, right in cuts if right)


def _block(text: Column, block: Column, size: int) -> Column:
    return F.substring(text, block * size + 1, F.lit(size + 1))


def _offset(text: Column, counts: Column, units: Column, at: str, size: int) -> Column:
    """The code points that the first ``units`` units have; ``counts`` are the boundaries of each block."""
    start = F.struct(F.lit(0).alias("block"), units.alias("left"), F.lit(False).alias("found"))
    step = lambda acc, c: F.when(acc["found"] | (acc["left"] <= c), F.struct(acc["block"].alias("block"), acc["left"].alias("left"), F.lit(True).alias("found"))).otherwise(
        F.struct((acc["block"] + 1).alias("block"), (acc["left"] - c).alias("left"), F.lit(False).alias("found"))
    )
    # Split so many times, what is left is the last piece.
    rest = lambda to: F.element_at(F.split(_block(text, to["block"], size), at, to["left"].cast("int") + 1), -1)
    length = lambda to: to["block"] * size + F.char_length(_block(text, to["block"], size)) - F.char_length(rest(to))
    # Past the last boundary is the end of the text.
    return F.aggregate(counts, start, step, lambda to: F.when(to["found"], length(to)).otherwise(F.char_length(text)))


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "char", seed: str = "1", percent: int = 90, spm_percent: int = 20, marks: tuple[str, str, str] = MARKS, block: int = BLOCK
) -> DataFrame:
    """All columns of the documents, and n, form, prefix_chars, middle_chars and output.

    A text of n units is cut after the smaller and after the larger of two
    numbers up to n that a digest of seed and id gives. ``form`` is plain for
    the share of texts above ``percent``, for empty and null ones, and for
    those that hold a mark; then the output is the text and the two sizes,
    which are of code points, are null. The rest are psm (prefix, suffix,
    middle) or, by ``spm_percent``, spm (suffix, prefix, middle). A null id
    counts as an empty one; rows with equal ids are cut by the same numbers.
    A null text is an empty one. Columns of any name may be there besides;
    those with the names of the result's are replaced.
    """
    classes, units = GRAMMARS[unit]
    at = boundary(classes, units)
    made = ("n", "form", "prefix_chars", "middle_chars", "output")
    if {id_col, text_col} & set(made):
        raise ValueError(f"the columns of ids and texts can't be named like the result's: {made}")
    rest = docs.drop(*made)
    text_, hash_, counts_, n_, a_, b_ = fresh_names(rest, "text", "hash", "counts", "n", "a", "b")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    number = lambda i: F.conv(F.substring(hash_, 8 * i - 7, 8), 16, 10).cast("bigint")
    text, n = F.col(text_), F.col(n_)
    cut = rest.withColumns({text_: F.coalesce(F.col(text_col), F.lit("")), hash_: digest})
    blocks = F.sequence(F.lit(0), F.greatest(F.ceil(F.char_length(text) / block).cast("int") - 1, F.lit(0)))
    # Splitting an empty text gives a piece, but it has no unit.
    cut = cut.withColumn(counts_, F.transform(blocks, lambda i: F.size(F.split(_block(text, i, block), at, -1)) - 1))
    whole = F.aggregate(counts_, F.lit(1).cast("bigint"), lambda total, c: total + c)
    cut = cut.withColumn(n_, F.when(text == "", F.lit(0).cast("bigint")).otherwise(whole))
    plain = (text == "") | (number(3) % 100 >= percent)
    for mark in marks:
        plain = plain | F.contains(text, F.lit(mark))
    cut = cut.withColumn("form", F.when(plain, "plain").when(number(4) % 100 < spm_percent, "spm").otherwise("psm"))
    first, second = number(1) % (n + 1), number(2) % (n + 1)
    place = lambda units: F.when(F.col("form") != "plain", F.when(units == 0, 0).otherwise(_offset(text, F.col(counts_), units, at, block)))
    cut = cut.withColumns({a_: place(F.least(first, second)), b_: place(F.greatest(first, second))})
    a, b = F.col(a_), F.col(b_)
    prefix, middle, suffix = F.substring(text, F.lit(1), a), F.substring(text, a + 1, b - a), F.substring(text, b + 1, F.char_length(text))
    p, s, m = map(F.lit, marks)
    output = F.when(F.col("form") == "plain", text).when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle)).otherwise(F.concat(s, suffix, p, prefix, m, middle))
    return cut.select(*rest.columns, n.alias("n"), "form", a.cast("bigint").alias("prefix_chars"), (b - a).cast("bigint").alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output was made of. No text with a mark in it is rearranged, so the marks cut an output in three."""
    parts = F.split(output, "|".join(re.sub(r"(\W)", r"\\\1", x) for x in marks), -1)
    return F.when(form == "plain", output).when(form == "psm", F.concat(parts[1], parts[3], parts[2])).otherwise(F.concat(parts[2], parts[3], parts[1]))
