"""Benchmark decontamination by greedy string tiling.

Texts are lower-cased words. Every run of ``seed`` words of a document and of
an item is hashed. A Bloom filter of the items' hashes, of bounded size, lets
a task leave out most of a document's before anything is shuffled; what passes
is joined with the items' hashes, and (document, item) pairs that share enough
of them go on. In such a pair the longest common run of unmarked words is
marked again and again, found by Karp-Rabin hashes of falling length, until
none of at least ``seed`` words is left. The share of the item's words under
marks decides, wherever in the document they lie and in whatever order.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkweft.llm import common

#: Words of a seed and of the shortest tile; covered share of an item from which a document is contaminated.
SEED_WORDS, COVERAGE = 5, 0.5
#: Bits of the Bloom filter for a seed and at most (32 MB), and its probes; a larger benchmark only lets more seeds pass.
BITS_PER_SEED, MOST_BITS, PROBES = 64, 1 << 28, 4
#: Items that a document is tiled with at once, word pairs that are compared at once, bytes of texts that are hashed at once.
GROUP_ITEMS, PAIRS, CHUNK = 64, 1_000_000, 400_000

_P, _Q, _MIX = 0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F, np.uint64(0xBF58476D1CE4E5B9)


def _powers(base: int, n: int) -> np.ndarray:
    return np.concatenate([np.ones(1, np.uint64), np.multiply.accumulate(np.full(max(0, n - 1), base & 0xFFFFFFFFFFFFFFFF, np.uint64))])[:n]


_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _tables_for(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64."""
    if base not in _tables or len(_tables[base][0]) < n:
        size = 1 << max(10, (n - 1).bit_length())
        _tables[base] = _powers(base, size), _powers(pow(base, -1, 1 << 64), size)
    return _tables[base]


def _ranges(values: np.ndarray, base: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A polynomial hash of each range of values, from prefix sums."""
    up, down = _tables_for(base, len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    h = (total[end] - total[start]) * down[start]
    h ^= h >> np.uint64(32)
    return h * _MIX


def normalize(raw: np.ndarray) -> np.ndarray:
    """UTF-8 bytes with letters lowered (A-Z, and capitals of Latin-1) and all between words as spaces."""
    lut = np.full(256, 32, np.uint8)
    for a, b in ((48, 58), (97, 123), (128, 256)):
        lut[a:b] = np.arange(a, b)
    lut[65:91] = np.arange(97, 123)
    x = lut[raw]
    high = np.flatnonzero(raw >= 0xC2)
    if len(high):
        nxt = high[high + 1 < len(raw)]
        b = raw[nxt + 1]
        capital = nxt[(raw[nxt] == 0xC3) & (b >= 0x80) & (b <= 0x9E) & (b != 0x97)] + 1
        x[capital] += 0x20
        sign = nxt[(raw[nxt] == 0xC2) & (b >= 0x80) & (b <= 0xBF)]  # Latin-1 signs
        x[sign] = x[sign + 1] = 32
        dash = nxt[(raw[nxt] == 0xE2) & ((b == 0x80) | (b == 0x81))]  # general punctuation
        for i in range(3):
            x[np.minimum(dash + i, len(x) - 1)] = 32
    return x


def word_bounds(x: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word of the normalised bytes; a limit between texts ends a word."""
    inside = np.zeros(len(x) + 1, bool)
    inside[:-1] = x != 32
    before = np.zeros(len(x) + 1, bool)
    before[1:] = inside[:-1]
    cut = np.zeros(len(x) + 1, bool)
    cut[limits] = True
    return np.flatnonzero(inside & (~before | cut)), np.flatnonzero(before & (~inside | cut))


def words(text: bytes) -> list[bytes]:
    return normalize(np.frombuffer(text, np.uint8)).tobytes().split()


def seed_hashes(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``width`` words, and the text that it is in."""
    raw = np.frombuffer(b"".join(texts), np.uint8)
    limits = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    x = normalize(raw)
    start, end = word_bounds(x, limits)
    if len(start) < width:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    w = _ranges(x.astype(np.uint64), _P, start, end)
    owner = np.searchsorted(limits, start, side="right") - 1
    at = np.arange(len(w) - width + 1)
    h = _ranges(w, _Q, at, at + width)
    same = owner[: len(at)] == owner[width - 1 :]
    return h[same], owner[: len(at)][same]


def _common_runs(a: np.ndarray, b: np.ndarray, free_a: np.ndarray, free_b: np.ndarray, length: int) -> list[tuple[int, int, int]]:
    """(-words, place in a, place in b) of every common unmarked run of at least ``length`` words that can't be made longer."""

    def hashed(v: np.ndarray, free: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(v) < length:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        blocked = np.concatenate([[0], np.cumsum(~free)])
        at = np.flatnonzero(blocked[length:] == blocked[:-length])
        return at, _ranges(v + np.uint64(1), _Q, at, at + length)

    at_a, hash_a = hashed(a, free_a)
    at_b, hash_b = hashed(b, free_b)
    order = np.argsort(hash_a, kind="stable")
    first, last = (np.searchsorted(hash_a[order], hash_b, side) for side in ("left", "right"))
    met = np.flatnonzero(last > first)
    out = []
    while len(met):
        some = max(1, int(np.searchsorted(np.cumsum(last[met] - first[met]), PAIRS, side="right")))
        now, met = met[:some], met[some:]
        times = last[now] - first[now]
        j = np.repeat(at_b[now], times)
        i = at_a[order[np.arange(times.sum()) + np.repeat(first[now] - np.cumsum(times) + times, times)]]
        inner = (i > 0) & (j > 0) & free_a[i - 1] & free_b[j - 1] & (a[i - 1] == b[j - 1])  # part of one that starts before
        for x, y in zip(i[~inner].tolist(), j[~inner].tolist(), strict=True):
            m = min(len(a) - x, len(b) - y)
            same = (a[x : x + m] == b[y : y + m]) & free_a[x : x + m] & free_b[y : y + m]
            n = m if same.all() else int(same.argmin())
            if n >= length:  # else two hashes are equal by chance
                out.append((-n, x, y))
    return out


def tiles(doc: list[bytes], item: list[bytes], least: int) -> list[tuple[int, int, int]]:
    """(place in the document, place in the item, words) of the tiles, in the order in which they are laid.

    Search lengths fall from the longest possible; at each, unmarked runs of
    that length are matched by rolling Karp-Rabin hashes, checked word by
    word, and extended. If a match is far longer than searched for, the search
    starts again at its length. What a tile leaves of a match waits for its
    turn as a match of its own, so longer tiles always come first; ties go to
    the earlier place in the item, then in the document.
    """
    number: dict[bytes, int] = {}
    a = np.array([number.setdefault(w, len(number)) for w in item], np.uint64)
    b = np.array([number.get(w, len(number) + i) for i, w in enumerate(doc)], np.uint64)
    free_a, free_b = np.ones(len(a), bool), np.ones(len(b), bool)
    found: list[tuple[int, int, int]] = []
    length = min(len(a), len(b))
    while length >= least:
        matches = _common_runs(a, b, free_a, free_b, length)
        longest = max((-n for n, *_ in matches), default=0)
        if longest > 2 * length:
            length = longest
            continue
        heapify(matches)
        while matches:
            n, i, j = heappop(matches)
            n = -n
            free = free_a[i : i + n] & free_b[j : j + n]
            if free.all():
                free_a[i : i + n] = free_b[j : j + n] = False
                found.append((j, i, n))
                continue
            # Words marked meanwhile cut the match; short remnants are found again at a smaller length.
            ends = np.flatnonzero(np.diff(np.concatenate([[False], free, [False]])))
            for x, y in ends.reshape(-1, 2).tolist():
                if y - x >= length:
                    heappush(matches, (x - y, i + x, j + x))
        if length == least:
            break
        length = max(least, length // 2)
    return found


def _place(h: np.ndarray, bits: int, probe: int) -> np.ndarray:
    """Places of the hashes in a Bloom filter of that many bits, a power of two."""
    x = (h ^ (h >> np.uint64(29 + probe))) * np.uint64((0x9E3779B97F4A7C15 * (2 * probe + 1)) & 0xFFFFFFFFFFFFFFFF)
    return (x >> np.uint64(65 - bits.bit_length())).astype(np.int64)


def _lists(rows: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    flat = np.concatenate([np.zeros(0, np.int64), *[r.view(np.int64) for r in rows]])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat).cast(kind))


def _items(benchmark: DataFrame, seed: int, id_col: str, text_col: str) -> DataFrame:
    """k, item_id, text, words, width, seeds, places of each item with a word; k numbers the rows, ``places`` has the seed that begins at each word.

    Items of fewer than ``seed`` words have one seed, of all their words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = common.column_bytes(batch.column(2))
            size = [len(words(t)) for t in texts]
            places = [_seeds([t], min(seed, n))[0] for t, n in zip(texts, size, strict=True)]
            width = pa.array([min(seed, n) for n in size], pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(size, pa.int32()), width, _lists([np.unique(h) for h in places], pa.int64()), _lists(places, pa.int64())], ["k", "item_id", "text", "words", "width", "seeds", "places"])

    kind = benchmark.schema[id_col].dataType.simpleString()
    rows = benchmark.select(F.monotonically_increasing_id().alias("k"), F.col(id_col).alias("item_id"), F.col(text_col).alias("text"))
    out = rows.where("text IS NOT NULL").mapInArrow(run, f"k bigint, item_id {kind}, text string, words int, width int, seeds array<bigint>, places array<bigint>")
    return common.staged(out.where("words > 0"), "items")


def _seeds(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Seed hashes and owners; those of different widths are kept apart."""
    h, owner = seed_hashes(texts, width) if width else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    return h + np.uint64(width), owner


def _filter(items: DataFrame) -> tuple[int, bytes]:
    """Bits of a Bloom filter of the items' seeds, and the filter: of 4 MB for 500,000 seeds, of 32 MB at most."""
    n = items.agg(F.sum(F.size("seeds"))).first()[0] or 0
    bits = min(MOST_BITS, max(1 << 22, 1 << max(0, BITS_PER_SEED * n - 1).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column(0).flatten().to_numpy().view(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate([_place(h, bits, k) for k in range(PROBES)])) + 1)], ["at"])

    places = items.select("seeds").mapInArrow(run, "at bigint")
    rows = places.groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    out = np.zeros(bits // 8, np.uint8)
    for r in rows.toLocalIterator():
        part = np.frombuffer(bytes(r.bits), np.uint8)
        out[(r.bucket - 1) * 4096 :][: len(part)] = part
    return bits, out.tobytes()


def _suspects(docs: DataFrame, items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """n, doc_id, text, seeds of the documents of whose distinct seeds any passes the filter; n numbers the rows."""
    spark = docs.sparkSession
    widths = sorted(r.width for r in items.select("width").distinct().collect())  # five at most, by the default seed
    bits, raw = _filter(items)
    sent = spark.sparkContext.broadcast(raw)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.frombuffer(sent.value, np.uint8)
        for batch in batches:
            for part in common.slices(batch, 1, CHUNK):
                texts = common.column_bytes(part.column(1))
                hashes, owners = [], []
                for width in widths:
                    h, owner = _seeds(texts, width)
                    for k in range(PROBES):
                        at = _place(h, bits, k)
                        passed = (held[at >> 3] >> (at & 7)) & 1 > 0
                        h, owner = h[passed], owner[passed]
                    hashes.append(h)
                    owners.append(owner)
                h, owner = np.concatenate([np.zeros(0, np.uint64), *hashes]), np.concatenate([np.zeros(0, np.int64), *owners])
                mine = np.unique(owner)
                rows = part.take(pa.array(mine))
                yield pa.RecordBatch.from_arrays([*rows.columns, _lists([np.unique(h[owner == i]) for i in mine], pa.int64())], ["doc_id", "text", "seeds"])

    kind = docs.schema[id_col].dataType.simpleString()
    found = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(common.tidy(run), f"doc_id {kind}, text string, seeds array<bigint>")
    return common.staged(found.withColumn("n", F.monotonically_increasing_id()), "suspects")


def _over_words(of_places: Column) -> Column:
    """For each word of an item, what ``of_places`` says of the places whose seed holds the word."""
    low = lambda w: F.greatest(w - F.col("width") + 1, F.lit(1))
    return F.transform(F.sequence(F.lit(1), F.col("words")), lambda w: F.slice(of_places, low(w), F.least(w, F.size(of_places)) - low(w) + 1))


def _rarest(items: DataFrame, in_docs: DataFrame, coverage: float) -> DataFrame:
    """(k, h): the seeds of each item that fewest documents have, as many as it takes that the words of the others are too few to be enough.

    A document that has none of them can't cover the item, so a phrase that
    many items and many documents hold brings no pair of them about, unless
    the item has little else.
    """
    spread = in_docs.groupBy("h").agg(F.count("*").alias("docs"))
    at = items.select("k", F.posexplode("places").alias("at", "h")).join(spread, "h", "left")
    how = F.struct("at", F.coalesce("docs", F.lit(0)).alias("docs"), "h")
    known = at.groupBy("k").agg(F.transform(F.sort_array(F.collect_list(how)), lambda x: F.struct(x["docs"], x["h"])).alias("of")).join(items.select("k", "words", "width"), "k")
    # A word goes with the most frequent of its seeds; the bound is the seed up to which enough words have gone.
    frequent = F.sort_array(F.transform(_over_words(F.col("of")), F.array_max), asc=False)
    bound = F.element_at(frequent, F.greatest(F.ceil(F.lit(coverage) * F.col("words")).cast("int"), F.lit(1)))
    chosen = known.select("k", F.explode(F.array_distinct(F.filter("of", lambda x: (x["docs"] > 0) & (x <= bound)))).alias("x"))
    return common.staged(chosen.select("k", F.col("x.h").alias("h")), "rarest")


def contaminated(
    docs: DataFrame, benchmark: DataFrame, seed: int = SEED_WORDS, coverage: float = COVERAGE,
    id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """doc_id, item_id, coverage, n_tiles, longest for each document row and item row of which it covers that share.

    Null and empty texts, an empty table or an empty benchmark give no rows.
    An item of fewer than ``seed`` words is covered by all its words in a row
    and by nothing less. Repeated documents have a row each; items are told by
    row, so those that share an id, or have none, are each tested; other
    columns are not read. The documents are read once at any benchmark size.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    doc_type, item_type = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_id].dataType.simpleString()
    items = _items(benchmark, seed, item_id, item_text)
    suspects = _suspects(docs, items, id_col, text_col)
    in_docs = suspects.select("n", F.explode("seeds").alias("h"))
    met = in_docs.join(_rarest(items, in_docs, coverage), "h").select("n", "k").distinct()
    both = common.staged(met, "met").join(suspects.select("n", F.col("seeds").alias("held")), "n").join(items.select("k", "places", "words", "width"), "k")
    shared = both.withColumn("shared", F.transform("places", lambda h: F.array_contains("held", h)))
    # Tiles lie where seeds are shared, so their words are a bound of what is covered.
    most = F.size(F.filter(_over_words(F.col("shared")), lambda x: F.array_contains(x, True)))
    pairs = common.staged(shared.where(most >= F.lit(coverage) * F.col("words")).select("n", "k"), "pairs")
    # A document meets its items in groups, so neither many items nor a long text make a row large.
    group = F.floor((F.row_number().over(Window.partitionBy("n").orderBy("k")) - 1) / GROUP_ITEMS).alias("g")
    groups = pairs.select("n", "k", group).join(items.select("k", "item_id", "text"), "k").groupBy("n", "g").agg(F.collect_list(F.struct("item_id", "text")).alias("items"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, ids, found = [], [], []
            texts = common.column_bytes(batch.column(1))
            lists = batch.column(2)
            bounds, known, said = lists.offsets.to_pylist(), lists.values.field(0).to_pylist(), common.column_bytes(lists.values.field(1))
            for i, text in enumerate(texts):
                doc = words(text)
                for k in range(bounds[i], bounds[i + 1]):
                    item = words(said[k])
                    laid = [n for *_, n in tiles(doc, item, min(seed, len(item)))]
                    if laid and sum(laid) >= coverage * len(item):
                        at.append(i)
                        ids.append(known[k])
                        found.append((sum(laid) / len(item), len(laid), max(laid)))
            keys = batch.column(0).take(pa.array(at, pa.int64()))
            share, count, longest = zip(*found, strict=True) if found else ((), (), ())
            columns = [keys, pa.array(ids, lists.values.field(0).type), pa.array(share, pa.float64()), pa.array(count, pa.int64()), pa.array(longest, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "coverage", "n_tiles", "longest"])

    rows = suspects.select("n", "doc_id", "text").join(groups, "n").select("doc_id", "text", "items")
    return rows.mapInArrow(run, f"doc_id {doc_type}, item_id {item_type}, coverage double, n_tiles bigint, longest bigint")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that cover no item. Rows that share the id of one that does go with it, rows without doc_id are kept."""
    id_col = options.get("id_col", "doc_id")
    bad = contaminated(docs, benchmark, **options).select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(common.staged(bad, "contaminated"), id_col, "left_anti")
