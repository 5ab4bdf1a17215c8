"""Scalar column functions, all inside code generation."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The dashes that prose must not hold.
DASHES = "[—–]"
#: Spacing accents and the combining marks that replace them.
ACCENTS = {"¯": "\u0304", "^": "\u0302", "~": "\u0303", "¨": "\u0308", "´": "\u0301", "`": "\u0300", "˘": "\u0306", "˙": "\u0307", "ˇ": "\u030c", "→": "\u20d7"}
#: Operators whose limits stand above and below, and those whose limits stand beside.
LIMITS = {"undOvr": "∑∏∐⋃⋂⨂⨁⨀", "subSup": "∫∬∭∮"}
#: Relational signs, at which an operator's body ends.
RELATIONS = "=<>≤≥≠≈≡≪≫⇔⇒↔→←∝"
#: From which measures on a piece of code is reported; lines must exceed theirs.
LARGE_CODE = {"lines": 41, "params": 5, "methods": 10, "nesting": 3}


def sanitize_prose(text: Column) -> Column:
    """A dash between white space becomes a comma, any other a hyphen; null and empty pass."""
    spaced = F.regexp_replace(text, rf"(?U)\s+{DASHES}\s+", ", ")
    return F.regexp_replace(spaced, DASHES, "-")


def first_filled(*values: Column) -> Column:
    """The first value that is neither null nor empty, else an empty string."""
    return F.coalesce(*(F.nullif(v, F.lit("")) for v in values), F.lit(""))


def caption(prefix: Column, number: Column, text: Column) -> Column:
    """Prefix, number and sanitised text; the dash of the prefix stays."""
    return F.concat(prefix, F.lit(" "), number.cast("string"), F.lit(" — "), sanitize_prose(text))


def heading(text: Column, upper: bool) -> Column:
    return F.upper(sanitize_prose(text)) if upper else sanitize_prose(text)


def natural_width_cm(pixels: Column, dpi: Column) -> Column:
    return pixels / dpi * 2.54


def clamp_width(requested: Column, natural: Column, left_mm: Column, right_mm: Column) -> Column:
    """The width to set, in cm, on a page of 210 mm; null where the natural size fits and none was asked for."""
    room = (F.lit(210.0) - left_mm - right_mm) / 10
    return F.when(requested.isNotNull(), F.least(requested, room)).when(natural > room, room)


def fingerprint(content: Column) -> Column:
    return F.sha2(content, 256)


def is_stale(stored: Column, content: Column) -> Column:
    """True if no fingerprint is stored or it is that of other content."""
    return F.coalesce(F.trim(stored) != fingerprint(content), F.lit(True))


def dotted(*parts: Column) -> Column:
    """A dotted path; dots inside a part are not escaped."""
    return F.concat_ws(".", *parts)


def work_title(kind: Column, number: Column) -> Column:
    return F.trim(F.concat_ws(" ", kind, number))


def combining_accent(mark: Column) -> Column:
    lookup = F.create_map(*(F.lit(x) for kv in ACCENTS.items() for x in kv))
    return F.coalesce(lookup[mark], mark)


def as_list(value: Column) -> Column:
    """One string as a list; null or empty gives an empty list."""
    return F.filter(F.array(value), lambda x: x.isNotNull() & (x != ""))


def filled_lines(*lines: Column) -> Column:
    """The lines of a title page that have text."""
    return F.filter(F.array(*lines), lambda x: x.isNotNull() & (x != ""))


def pad_rows(rows: Column) -> Column:
    """Rows of a ragged table, short ones filled with empty cells."""
    width = F.array_max(F.transform(rows, F.size))
    return F.transform(rows, lambda r: F.concat(r, F.array_repeat(F.lit(""), (width - F.size(r)).cast("int"))))


def size_bucket(files: Column) -> Column:
    """SMALL up to 2, MEDIUM 3 to 5 (5 included), LARGE above."""
    return F.when(files <= 2, "SMALL").when(files <= 5, "MEDIUM").when(files > 5, "LARGE")


def rank_in(value: Column, order: list[str]) -> Column:
    """Place of a value in an ordered domain; unknown values come last."""
    ranked = reduce(lambda acc, kv: acc.when(value == kv[1], kv[0]), enumerate(order[1:], 1), F.when(value == order[0], 0))
    return ranked.otherwise(len(order)).cast("int")


def limit_place(sign: Column) -> Column:
    """Where the limits of an operator stand, null for any other sign."""
    return F.when(F.trim(sign).isin(*LIMITS["undOvr"]), "undOvr").when(F.trim(sign).isin(*LIMITS["subSup"]), "subSup")


def ends_body(sign: Column) -> Column:
    """Whether the sign is a relation, at which the body of an operator ends."""
    return F.coalesce(F.trim(sign).isin(*RELATIONS), F.lit(False))


def is_upright(identifier: Column, variant: Column) -> Column:
    """Names of several letters stand upright, single letters only if they are marked normal; null if there is no name."""
    name = F.trim(identifier)
    return F.when(F.char_length(name) > 0, (F.char_length(name) > 1) | F.coalesce(variant == "normal", F.lit(False)))


def large_code(lines: Column, params: Column, methods: Column, nesting: Column) -> Column:
    """Names of the measures by which a piece of code is too large."""
    given = {"lines": lines, "params": params, "methods": methods, "nesting": nesting}
    return F.filter(F.array(*(F.when(given[k] >= least, k) for k, least in LARGE_CODE.items())), lambda x: x.isNotNull())
