"""Dependencies, keys and normal forms against plain counting of distinct rows."""

import random
from itertools import combinations

import pytest

from sparkweft.operators import normalform

DATA = "/root/testdata/sf0.01"


def plain(rows, columns, most=3):
    count = lambda x: len({tuple(repr(r[c]) for c in x) for r in rows})
    found, keys = [], []
    for size in range(most + 1):
        for x in combinations(columns, size):
            if count(x) == len(rows) and not any(set(k) <= set(x) for k in keys):
                keys.append(x)
            for c in columns:
                if c not in x and count(x) == count((*x, c)) and not any(d == c and set(y) < set(x) for y, d in found):
                    found.append((x, c))
    return sorted(found), sorted(keys)


@pytest.mark.parametrize("name", ["part", "customer"])
def test_tables(spark, name):
    df = spark.read.parquet(f"{DATA}/{name}.parquet")
    found, keys = normalform.dependencies(df)
    assert (sorted(found), sorted(keys)) == plain(df.collect(), df.columns)


def test_random_tables(spark):
    rnd = random.Random(4)
    for kind in range(4):
        rows = [(a := rnd.randint(0, 9), b := rnd.choice([None, 1, 2]), a % 3 if kind else None, (a, b) == (1, 1), f"{a}{b}", rnd.random() if kind == 2 else 5.0) for _ in range(60)]
        rows = rows if kind != 3 else list(dict.fromkeys(rows))
        df = spark.createDataFrame(rows, "a int, b int, c int, _n boolean, e string, f double")
        found, keys = normalform.dependencies(df)
        assert (sorted(found), sorted(keys)) == plain(df.collect(), df.columns)
    none = df.limit(0)
    assert normalform.dependencies(none) == ([((), c) for c in df.columns], [()])


def test_normal_forms(spark):
    """Order lines: the order's date hangs on a part of the key, the customer's city on the customer."""
    customer, date = [0, 0, 1, 1, 2, 2, 3, 3], [0, 0, 0, 1, 1, 1, 0, 0]
    rows = [(o, p, f"date {date[o]}", customer[o], f"city {customer[o] // 2}") for o in range(8) for p in range(5) if (o, p) != (3, 3)]
    df = spark.createDataFrame(rows, "order_id int, part int, date string, customer int, city string")
    got = {(r.determinant, r.dependent): r.breaks for r in normalform.normal_forms(df).collect()}
    assert got["order_id", "date"] == got["order_id", "customer"] == got["order_id", "city"] == "2NF"
    assert got["customer", "city"] == "3NF" and ("order_id,part", "date") not in got
    assert normalform.holds_everywhere(df, ["customer"], "city").first() == (True, 0)
    assert normalform.holds_everywhere(df, ["date"], "order_id").first().violations == 2
