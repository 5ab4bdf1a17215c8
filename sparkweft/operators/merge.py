"""Deep merge of JSON documents and ordered union of lists."""

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ordered_union(overlay: Column, base: Column) -> Column:
    """Overlay items first, then the base's others, without duplicates."""
    return F.array_union(overlay, base)


def ordered_union_json(overlay: Column, base: Column, equality: str = "host") -> Column:
    """The same for lists of JSON texts, which are read and written again; see ``merge_outcome`` for what is equal. Texts that are no JSON go."""

    @F.pandas_udf("array<string>")
    def united(o: pd.Series, b: pd.Series) -> pd.Series:
        def read(texts):
            for t in texts if texts is not None else ():
                try:
                    yield json.loads(t)
                except (TypeError, ValueError):
                    continue

        return pd.Series([[json.dumps(v, ensure_ascii=False, separators=(",", ":")) for v in union_values([*read(x)], [*read(y)], equality)] for x, y in zip(o, b, strict=True)], dtype=object)

    return united(overlay, base)


def prepend_unless(items: Column, item: Column, same) -> Column:
    """The item before the list, unless one in the list is the same."""
    return F.when(F.exists(items, same), items).otherwise(F.concat(F.array(item), items))


def _comparable(x):
    """A value in which all that is equal in the host language looks the same: 1, 1.0 and true are."""
    if isinstance(x, (bool, float)) and x == x and abs(x) != float("inf"):
        return int(x) if int(x) == x else x
    if isinstance(x, list):
        return [_comparable(y) for y in x]
    return {k: _comparable(v) for k, v in x.items()} if isinstance(x, dict) else x


def _key(x, equality: str) -> str:
    return json.dumps(_comparable(x) if equality == "host" else x, sort_keys=True)


def union_values(overlay: list, base: list, equality: str) -> list:
    """The overlay's items, then the base's others; of equal items the first stays."""
    first: dict[str, object] = {}
    for x in (*overlay, *base):
        first.setdefault(_key(x, equality), x)
    return list(first.values())


def merge_values(base, overlay, union: frozenset[tuple[str, ...]], equality: str):
    """Overlay wins; objects merge key by key; lists at a path in ``union`` unite; null overwrites. There is no limit of depth."""
    out: dict = {}
    left = [(out, "", base, overlay, ())]
    while left:
        into, name, b, o, path = left.pop()
        if isinstance(b, dict) and isinstance(o, dict):
            into[name] = made = b | o
            left += [(made, k, b[k], v, (*path, k)) for k, v in o.items() if k in b]
        elif isinstance(b, list) and isinstance(o, list) and path in union:
            into[name] = union_values(o, b, equality)
        else:
            into[name] = o
    return out[""]


def merge_outcome(base: Column, overlay: Column, union=(), equality: str = "host") -> Column:
    """doc and outcome of a merge: merged, current (the base already holds it all) or rejected.

    Paths in ``union`` are tuples of keys; a string is cut at its dots. With
    the equality ``host`` the numbers 1 and 1.0 and true are one list item,
    with ``text`` only what is written alike. Null and blank texts are empty
    objects; a text that is no object is rejected, and doc is null, and so is
    one that is nested deeper than the host's JSON reader goes, which takes
    9,000 levels, or that holds NaN or a number beyond a double's, which can't be
    written again. ``jsontree.merge_documents`` has neither limit.
    """
    paths = frozenset(tuple(p.split(".")) if isinstance(p, str) else tuple(p) for p in union)

    @F.pandas_udf("doc string, outcome string")
    def merged(b: pd.Series, o: pd.Series) -> pd.DataFrame:
        def one(x, y):
            try:
                x, y = (json.loads(t) if t and t.strip() else {} for t in (x, y))
            except (ValueError, RecursionError):
                return None, "rejected"
            if not isinstance(x, dict) or not isinstance(y, dict):
                return None, "rejected"
            try:
                out = merge_values(x, y, paths, equality)
                return json.dumps(out, ensure_ascii=False, allow_nan=False), "current" if out == x else "merged"
            except (RecursionError, ValueError):
                return None, "rejected"

        return pd.DataFrame([one(x, y) for x, y in zip(b, o, strict=True)], columns=["doc", "outcome"], dtype=object)

    return merged(base, overlay)


def deep_merge(base: Column, overlay: Column, union=(), equality: str = "host") -> Column:
    """Merged JSON text; null if either text is not an object."""
    return merge_outcome(base, overlay, union, equality)["doc"]


def merge_flat(base: DataFrame, overlay: DataFrame, key: str, path: str, value: str) -> DataFrame:
    """One level of documents flattened to (key, path, value): a full outer join with presence flags.

    An overlay's null overwrites, so presence, not the value, decides.
    """
    b = base.select(key, path, F.col(value).alias("_b"))
    o = overlay.select(key, path, F.col(value).alias("_o"), F.lit(True).alias("_has"))
    return b.join(o, [key, path], "full_outer").select(key, path, F.when(F.col("_has"), F.col("_o")).otherwise(F.col("_b")).alias(value))
