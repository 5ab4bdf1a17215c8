"""Fill-in-middle against a plain version: grammars, marks, nulls, empty and long texts, equal ids, clashing names."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from sparkweft.llm import fim

UNITS = {"char": r"[\s\S]", "word": r"[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", "line": r"[^\n]*\n|[^\n]+"}
ROWS = [
    (1, "a😀b\n\n c  d😀😀"), (2, None), (3, ""), (4, "x"), (5, "has <M> inside"), (5, "same id, another text\nof two lines"), (5, "same id, another text\nof two lines"),
    (None, "no id at all"), (6, "\n\n\n"), (7, " lead and trail "), (8, "word " * 30_000 + "end"), (9, "<P"), (10, "S><S"), (11, "漢字 é é \x1f  |"), (12, "one\r\ntwo\x0bthree"),
    *((100 + i, f"text {i} <" + "y" * i + "\n" + "S> z" * (i % 7)) for i in range(150)),
]


def plain(doc_id, text, unit):
    text = text or ""
    units = re.findall(UNITS[unit], text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(units)
    if not text or any(m in text for m in fim.MARKS) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    spm = h4 % 100 < 20
    return doc_id, n, "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("unit", sorted(UNITS))
@pytest.mark.parametrize("block", [fim.BLOCK, 7, 1])
def test_against_plain(spark, unit, block):
    rows = [r for r in ROWS if block > 1000 or len(r[1] or "") < 1000]
    df = spark.createDataFrame([(*r, "kept", "gone", 3) for r in rows], "doc_id bigint, text string, __text string, output string, __n int")
    got = fim.fill_in_middle(df, unit=unit, block=block)
    assert got.columns == ["doc_id", "text", "__text", "__n", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = got.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert sorted(map(repr, (plain(*r, unit) for r in rows))) == sorted(repr((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output)) for r in got)
    assert all(r.back == (r.text or "") and r["__text"] == "kept" and r["__n"] == 3 for r in got)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_empty_table_and_other_marks(spark):
    none = spark.createDataFrame([], "k string, body string")
    assert fim.fill_in_middle(none, "k", "body").count() == 0
    one = spark.createDataFrame([(f"k{i}", f"(a) {i} b") for i in range(40)], "k string, body string")
    marks = ("(p)", "[s]", "$m")
    got = fim.fill_in_middle(one, "k", "body", unit="word", marks=marks).withColumn("back", fim.restored(F.col("output"), F.col("form"), marks)).collect()
    assert all(r.back == r.body for r in got) and any(r.output.startswith("(p)") for r in got)
    with pytest.raises(ValueError, match="named like"):
        fim.fill_in_middle(one, "k", "body").transform(lambda d: fim.fill_in_middle(d, "n", "body"))


def test_boundaries_are_those_between_units():
    """Any grammar of single classes and runs: the places the expression finds are those where a greedy match ends."""
    classes = {"a": "[a]", "b": "[b]", "c": "[c]"}
    for units in ("a+|b+|c", "a*b|a+|c+", "a|b|c", "a+|b+|c+"):
        at = fim.boundary(classes, units)
        for number in range(3**6):
            text = "".join("abc"[number // 3**i % 3] for i in range(6))
            ends, pieces = 0, []
            for m in re.finditer(units, text):
                ends += len(m.group())
                pieces.append(ends)
            assert [m.start() for m in re.finditer(at, text)] == pieces[:-1], (units, text)
