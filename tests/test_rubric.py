"""Rubric texts, the verdicts on them, and both together."""

from pyspark.sql import functions as F

from sparkweft.operators import report, rubric

RUBRIC = """# Review

Хороший review этого кода ОБЯЗАН отметить:

1. **SQL injection** — f-string в query,
   a second line of it.
2) Passwords are compared in plain text
3. (bonus) Timing attack

Some text between that belongs to nothing.

Бонус:
- mentions `with`
continues without indent

```
1. not an item
```

Не должен (false positive):
- complain about `import sqlite3`
* change the architecture
"""


def items_of(spark, text):
    rows = rubric.rubric_items(spark.createDataFrame([(7, text)], "k int, t string"), "k", "t").orderBy("item").collect()
    return [(r.item, r.kind, r.text) for r in rows]


def test_rubric_items(spark):
    want = [
        (1, "required", "**SQL injection** — f-string в query, a second line of it."), (2, "required", "Passwords are compared in plain text"), (3, "bonus", "(bonus) Timing attack"),
        (4, "bonus", "mentions `with` continues without indent"), (5, "forbidden", "complain about `import sqlite3`"), (6, "forbidden", "change the architecture"),
    ]
    assert items_of(spark, RUBRIC) == want and items_of(spark, RUBRIC.replace("\n", "\r\n")) == want
    assert items_of(spark, "- one\n- two\nMust not:\n- three") == [(1, "required", "one"), (2, "required", "two"), (3, "forbidden", "three")]
    assert items_of(spark, None) == items_of(spark, "") == items_of(spark, "no items at all") == []


def test_verdict_faults(spark):
    good = '{"verdict":"pass","matched":[1,2],"missed":[],"notes":""}'
    cases = {
        good: [], good.replace("pass", "fail"): [], "": ["no JSON"], "text": ["no JSON"], "[1]": ["no object"], "null": ["no object"],
        "{}": ["verdict", "matched", "missed", "notes"], good.replace('"pass"', '"PASS"'): ["verdict"], good.replace('"pass"', "1"): ["verdict"], good.replace("[1,2]", '["1"]'): ["matched"], good.replace("[1,2]", "[1.5]"): ["matched"],
        good.replace("[]", "3"): ["missed"], good.replace('""', "null"): ["notes"], good.replace("{", '{"more":1,'): ["unknown name"], good.replace("[1,2]", "[0,1]"): ["no such item"], good.replace("[1,2]", "[9]"): ["no such item"],
        good.replace("[]", "[2]"): ["matched and missed", "pass with missed items"], good.replace("[]", "[3]"): ["pass with missed items"],
    }
    df = spark.createDataFrame([(t,) for t in cases] + [(None,)], "t string").select("t", rubric.verdict_faults(F.col("t"), F.lit(3)).alias("f"))
    assert {r.t: r.f for r in df.collect()} == cases | {None: ["no JSON"]}


def test_items_feed_the_reduction(spark):
    items = rubric.rubric_items(spark.createDataFrame([(1, RUBRIC), (2, RUBRIC)], "k int, t string"), "k", "t")
    met = spark.createDataFrame([(1, 1), (1, 2), (1, 4), (2, 1), (2, 6)], "k int, item int").withColumn("met", F.lit(True))
    got = {r.k: r for r in report.reduce_items(items.join(met, ["k", "item"], "left"), ["k"], "item", "met", "kind").collect()}
    assert (got[1].passed, got[1].matched, got[1].missed, got[1].forbidden) == (True, [1, 2, 4], [], [])
    assert (got[2].passed, got[2].matched, got[2].missed, got[2].forbidden) == (False, [1], [2], [6])
