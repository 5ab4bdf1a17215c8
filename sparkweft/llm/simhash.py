"""SimHash fingerprints, pigeonhole blocks and components of near copies.

A fingerprint's bit is set if it is set in over half of the hashes of the
text's word shingles. Two fingerprints that differ in few bits agree in whole
blocks: of B blocks, at least B - d for d differing bits. So each distinct
fingerprint is dealt to one bucket per choice of B - d blocks; buckets of one
are dropped, large ones are split again by blocks of the bits that are left,
and inside the others the Hamming distance is verified.

Inside a bucket not all pairs are made. Few members are compared with each
other as a matrix that leaves only a spanning forest; many members are sorted
under masks: two members within distance d agree when the bits in which they
differ are masked out. Each bucket yields at most one link a member.

The pipeline's near copies are those whose sets of five-word shingles are
alike to 0.8. Fingerprints of copies at 0.8 differ in more bits than any
blocks promise to find, so the blocks come first, their links are confirmed on
the sets, and prefix filters find what is left: all of it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate, combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkweft.llm import common

#: Members up to which a bucket is compared as a matrix, and from which it is split; keys that one task makes, about.
MATRIX, SPLIT, TASK_KEYS = 768, 8192, 1_000_000


def mix(h: np.ndarray, lane: int) -> np.ndarray:
    """Further 64-bit hashes from the first; lane 0 is the hash itself."""
    if not lane:
        return h
    x = h + np.uint64(0x9E3779B97F4A7C15 * lane & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: bytes, width: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each run of ``width`` words, lower-cased in A-Z and joined by spaces; of all words, if fewer."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # bytes: A-Z, and white space \x20 \x09-\x0D
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxh64_intdigest(joined, seed)], np.uint64)
    ends = list(accumulate(map((1).__add__, map(len, words))))
    starts = [0, *ends]
    hashes = [xxh64_intdigest(joined[a : b - 1], seed) for a, b in zip(starts, ends[width - 1 :], strict=False)]
    return np.array(hashes, np.uint64)


#: For each byte value, its bits as eight 8-bit counters in a 64-bit word.
_SPREAD = (np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="big")).astype(np.uint64) @ (np.uint64(1) << (np.uint64(8) * np.arange(8, dtype=np.uint64)))


def bit_counts(h: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit, most significant first."""
    out = np.zeros(64, np.int64)
    columns = h.astype(">u8").view(np.uint8).reshape(-1, 8)
    for i in range(0, len(h), 255):  # 255 fits a counter
        sums = _SPREAD[columns[i : i + 255]].sum(0, dtype=np.uint64)
        out += sums.astype("<u8").view(np.uint8)
    return out


def fingerprint(h: np.ndarray, lanes: int) -> bytes:
    """``lanes`` times 8 bytes."""
    if not len(h):
        return bytes(8 * lanes)
    bits = np.concatenate([bit_counts(mix(h, i)) * 2 > len(h) for i in range(lanes)])
    return np.packbits(bits).tobytes()


def fingerprints(docs: DataFrame, width: int, lanes: int = 1, repeats: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp (binary). Null, empty and blank texts have zeros; rows stay rows; other columns are not read."""
    common.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in common.column_bytes(batch.column(1)):
                h = shingle_hashes(text, width)
                out.append(fingerprint(h if repeats else np.unique(h), lanes))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("t"))
    return rows.mapInArrow(common.tidy(run), "doc_id bigint, fp binary")


def _forest_matrix(m: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of members (rows of u64 words) within ``most`` bits."""
    n = len(m)
    links, root = [], np.arange(n)
    for i in range(n - 1):
        near = np.flatnonzero(np.bitwise_count(m[i + 1 :] ^ m[i]).sum(1) <= most) + i + 1
        for j in near[root[near] != root[i]]:
            if root[j] != root[i]:
                links.append((i, int(j)))
                root[root == root[j]] = root[i]
    return links


def _forest_masks(m: np.ndarray, most: int) -> list[tuple[int, int]]:
    """The same for many members that agree in most bits, by sorting under every mask of ``most`` bits in which they vary."""
    varying = np.bitwise_or.reduce(m ^ m[0])
    places = [i for i in range(64) if int(varying) >> i & 1]
    links, root = [], list(range(len(m)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for off in combinations(places, min(most, len(places))):
        masked = m & np.uint64(~sum(1 << i for i in off) & 0xFFFFFFFFFFFFFFFF)
        order = np.argsort(masked, kind="stable")
        for k in np.flatnonzero(masked[order[1:]] == masked[order[:-1]]).tolist():
            a, b = int(order[k]), int(order[k + 1])
            if (x := find(a)) != (y := find(b)):
                root[y] = x
                links.append((a, b))
    return links


def bucket_links(members: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of 64-bit members within ``most`` bits."""
    return _forest_matrix(members[:, None], most) if len(members) <= MATRIX else _forest_masks(members, most)


def block_keys(fps: np.ndarray, places: np.ndarray, blocks: int, agree: int) -> np.ndarray:
    """For each fingerprint, its bits at every choice of ``agree`` blocks of those places as a number: (fingerprints, choices)."""
    bits = (fps[:, None] >> places.astype(np.uint64)) & np.uint64(1)
    cuts = [len(places) * i // blocks for i in range(blocks + 1)]
    out = []
    for choice in combinations(range(blocks), agree):
        taken = np.concatenate([np.arange(cuts[i], cuts[i + 1]) for i in choice])
        out.append((bits[:, taken] << np.arange(len(taken), dtype=np.uint64)).sum(1, dtype=np.uint64).view(np.int64))
    return np.stack(out, axis=1)


def _words(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), ">u8").astype(np.uint64)


def links(distinct: DataFrame, blocks: int, most: int, split: int = SPLIT) -> DataFrame:
    """Links (a, b) that connect, in buckets, the row numbers of distinct 64-bit fingerprints (n, fp) within ``most`` bits.

    They are few a member and bucket. Tasks make a bounded number of keys, as
    a fingerprint is small beside its keys. Buckets are runs of sorted rows; a
    bucket of over ``split`` members is dealt out again, by choices of blocks
    of the bits that its own key leaves open.
    """
    agree, every = blocks - most, np.arange(64)
    choices = [np.setdiff1d(every, np.concatenate([every[64 * i // blocks : 64 * (i + 1) // blocks] for i in c])) for c in combinations(range(blocks), agree)]

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                k = block_keys(_words(batch.column(1)), every, blocks, agree)
                offsets = pa.array(np.arange(len(k) + 1) * k.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(k.ravel()))], ["n", "keys"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m, choice, fps = batch.column(4).to_numpy(), batch.column(2).to_numpy(), _words(batch.column(1))
            rows, part, sub = [np.flatnonzero(m <= split)], [np.full((m <= split).sum(), -1)], [np.zeros((m <= split).sum(), np.int64)]
            for c in np.unique(choice[m > split]):
                at = np.flatnonzero((choice == c) & (m > split))
                k = block_keys(fps[at], choices[c], blocks, agree)
                rows.append(np.repeat(at, k.shape[1]))
                part.append(np.tile(np.arange(k.shape[1]), len(at)))
                sub.append(k.ravel())
            out = batch.take(pa.array(np.concatenate(rows)))
            yield pa.RecordBatch.from_arrays([*out.columns[:4], pa.array(np.concatenate(part), pa.int32()), pa.array(np.concatenate(sub))], ["n", "fp", "choice", "key", "part", "sub"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = [np.zeros(0, np.int64)] * 6

        def found(upto: int) -> pa.RecordBatch:
            """Links of the whole buckets at the front of the rows held."""
            edge = np.any([np.diff(x[:upto]) != 0 for x in held[2:]], axis=0) if upto else np.zeros(0, bool)
            cuts = np.concatenate([[0], np.flatnonzero(edge) + 1, [upto]])
            a, b = [], []
            for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if y - x > 1:
                    for i, j in bucket_links(held[1][x:y], most):
                        a.append(held[0][x + i])
                        b.append(held[0][x + j])
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            new = [_words(batch.column(1)) if i == 1 else batch.column(i).to_numpy() for i in range(6)]
            held = [np.concatenate([x.astype(y.dtype), y]) for x, y in zip(held, new, strict=True)]
            last = np.all([x == x[-1] for x in held[2:]], axis=0)
            upto = len(last) - int(np.argmin(last[::-1])) if not last.all() else 0
            if upto:
                yield found(upto)
                held = [x[upto:] for x in held]
        yield found(len(held[0]))

    tasks = distinct.count() * comb(blocks, agree) // TASK_KEYS
    dealt = distinct.select("n", "fp").repartition(max(tasks + 1, distinct.sparkSession.sparkContext.defaultParallelism))
    # Written, as it is read twice, and as a stage with both this and deal() would need two Python workers a core; these stay and load what later stages use.
    keyed = common.staged(dealt.mapInArrow(common.tidy(keys), "n bigint, keys array<bigint>"), "block_keys").select("n", F.posexplode("keys").alias("choice", "key"))
    # Counts are combined before the shuffle, and the join with them may be split: no bucket is one task's.
    sizes = common.staged(keyed.groupBy("choice", "key").agg(F.count("*").alias("m")).where("m > 1"), "buckets")
    met = keyed.join(sizes, ["choice", "key"])
    members = met.join(distinct.select("n", "fp"), "n").select("n", "fp", "choice", "key", "m")
    buckets = ["choice", "key", "part", "sub"]
    spread = members.mapInArrow(deal, "n bigint, fp binary, choice int, key bigint, part int, sub bigint").repartition(*buckets).sortWithinPartitions(*buckets, "n")
    return spread.mapInArrow(run, "a bigint, b bigint").distinct()


def components(prints: DataFrame, blocks: int, most: int) -> DataFrame:
    """doc_id, fp, component_id of 64-bit fingerprints that are linked within ``most`` bits."""
    prints = common.staged(prints, "fingerprints")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("rows"))
    distinct = common.staged(distinct.withColumn("n", F.monotonically_increasing_id()), "distinct")
    return linked(prints, distinct, links(distinct, blocks, most))


def linked(prints: DataFrame, distinct: DataFrame, edges: DataFrame) -> DataFrame:
    """doc_id, fp, component_id: the smallest doc_id that is linked, itself included.

    ``edges`` (a, b) are between the n of distinct fingerprints (n, fp, rows
    that have it, first: smallest doc_id). Both tables are written ones.

    Copies are one fingerprint from the start, so a group of any size costs a
    row. Rows with null doc_id keep a null component unless linked to others.
    """
    roots = common.connected_components(edges)
    placed = distinct.join(roots.withColumnRenamed("node", "n"), "n", "inner")
    least = placed.groupBy("root").agg(F.min("first").alias("least"))
    moved = placed.join(least, "root").select("fp", F.col("least").alias("c"))
    alone = distinct.join(roots.select(F.col("node").alias("n")), "n", "left_anti").where("rows > 1").select("fp", F.col("first").alias("c"))
    known = common.staged(moved.unionByName(alone), "components")
    return prints.select("doc_id", "fp").join(known, "fp", "left").select("doc_id", "fp", F.coalesce("c", "doc_id").alias("component_id"))


#: The pipeline's near copies: words of a shingle, similarity as a fraction, 64-bit words of a parity map, members of a small bucket.
WIDTH, PART, WHOLE, MAPS, SMALL = 5, 4, 5, 8, 8
#: Shingles whose frequency is told in the order of a prefix filter, and the share of sets (one in so many) that it is estimated on.
FREQUENT, EVERY = 100_000, 8


def _lists(rows: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    flat = np.concatenate([np.zeros(0, kind.to_pandas_dtype()), *rows])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(r) for r in rows])]), pa.int32()), pa.array(flat, kind))


def _sets(docs: DataFrame, prefix: bool) -> DataFrame:
    """Of (doc_id, t): doc_id, fp (a hash of the shingle set), size and shingles, and row, a number of the row.

    The shingles are all, sorted by hash, or 32 bits of those that seven
    tenths of the set follow at most.
    """
    common.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for batch in batches:
            sets = [np.unique(shingle_hashes(t, WIDTH)) for t in common.column_bytes(batch.column(1))]
            fp = np.array([xxh64_intdigest(s.tobytes(), WIDTH) for s in sets], np.uint64).view(np.int64)
            size = np.array([len(s) for s in sets], np.int64)
            held = [np.unique(s[: len(s) - len(s) * 7 // 10].astype(np.uint32)).view(np.int32) if prefix else s.view(np.int64) for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp), pa.array(size), _lists(held, pa.int32() if prefix else pa.int64())], ["doc_id", "fp", "size", "tokens"])

    rows = docs.select("doc_id", "t").mapInArrow(common.tidy(run), f"doc_id bigint, fp bigint, size bigint, tokens array<{'int' if prefix else 'bigint'}>")
    return rows.withColumn("row", F.monotonically_increasing_id())


def _one_of_each(rows: DataFrame) -> DataFrame:
    """The row of smallest number of each set. A map of fixed size tells most rows at once that they are alone, so only the others travel."""
    first = common.settled(rows.groupBy("fp").agg(F.min("row").alias("row"), F.count("*").alias("n_rows")), "firsts")
    told = common.maybe_in(rows, "fp", first.where("n_rows > 1"), "fp", "again")
    return told.where(~F.col("again")).unionByName(told.where("again").join(first.select("row"), "row", "left_semi").select(told.columns)).drop("again")


def _split_bytes(x: np.ndarray) -> bytes:
    """Little-endian u32 with all first bytes first: what is small or alike packs well so."""
    return x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _join_bytes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _packed(token: np.ndarray, row: np.ndarray, parts: int) -> Iterator[tuple]:
    """(part, base, blob, row, hits): shingles for each part, packed, and the hits of rows that share one here.

    A shingle that several rows here have is a hit for each of them, and is
    passed on once, as no row's: so a frequent one costs an entry, not a row.
    """
    from zstandard import compress

    order = np.argsort(token, kind="stable")
    token, row = token[order], row[order]
    same = token[1:] == token[:-1]
    after, before = np.append(same, False), np.append(False, same)
    rows, hits = np.unique(row[after | before], return_counts=True)
    yield from ((int(r) % parts, None, None, int(r), int(h)) for r, h in zip(rows, hits, strict=True))
    base = int(row.min()) - 1
    place = np.where(after, 0, row - base)[~before]
    token = token[~before]
    part = (token.astype(np.uint64) * np.uint64(parts)) >> np.uint64(32)
    cuts = np.searchsorted(part, np.arange(parts + 1, dtype=np.uint64))
    for p in np.unique(part).tolist():
        x, y = cuts[p], cuts[p + 1]
        yield p, base, compress(_split_bytes(np.diff(token[x:y], prepend=np.uint32(0))) + _split_bytes(place[x:y]), 3), None, None


def _hits(rows: DataFrame, parts: int) -> DataFrame:
    """(row, hits): how many of its shingles another row has too. Tasks get a bounded number of shingles."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
            token, row = (np.concatenate(x) for x in zip(*held, strict=True))
            for far in np.unique(row >> 31):  # so that numbers less the least are short
                near = row >> 31 == far
                found = [*_packed(token[near], row[near], parts)]
                for i in range(0, len(found), 4096):
                    columns = zip(*found[i : i + 4096], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64()), strict=True)], ["part", "base", "blob", "row", "hits"])

        held, count = [], 0
        for batch in batches:
            lists = batch.column(0)
            flat = lists.flatten().to_numpy().view(np.uint32)
            if len(flat):
                held.append((flat, np.repeat(batch.column(1).to_numpy(), lists.value_lengths().to_numpy())))
                count += len(flat)
            if count >= TASK_KEYS:
                yield from out(held)
                held, count = [], 0
        if held:
            yield from out(held)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from zstandard import decompress

        tokens, rows = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for batch in batches:
            known = batch.column(2).is_null()
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(known) for i in (3, 4)], ["row", "hits"])
            for base, blob in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if blob is not None:
                    both = _join_bytes_pair(decompress(blob))
                    tokens.append(np.cumsum(both[0], dtype=np.uint32))
                    rows.append(np.where(both[1] > 0, both[1].astype(np.int64) + base, -1))
        token, row = np.concatenate(tokens), np.concatenate(rows)
        order = np.argsort(token, kind="stable")
        same = token[order[1:]] == token[order[:-1]]
        row = row[order[np.append(same, False) | np.append(False, same)]] if len(order) else row
        row = row[row >= 0]
        for i in range(0, len(row), 65536):
            some = row[i : i + 65536]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(np.ones(len(some), np.int64))], ["row", "hits"])

    dealt = rows.select("tokens", "row").mapInArrow(common.tidy(deal), "part int, base bigint, blob binary, row bigint, hits bigint").repartitionById(parts, F.col("part"))
    return dealt.mapInArrow(common.tidy(meet), "row bigint, hits bigint").groupBy("row").agg(F.sum("hits").alias("hits"))


def _join_bytes_pair(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    return _join_bytes(raw[: len(raw) // 2]), _join_bytes(raw[len(raw) // 2 :])


def _may_have_partner(held: DataFrame, distinct: DataFrame) -> DataFrame:
    """Those distinct sets that share a tenth of their shingles or more in the prefixes.

    For sets of at most N shingles with 4/5 of N in common, in whatever order,
    a common shingle that 7/10 N common ones follow is among the first 3/10 of
    either, so N/10 of these are shared. Of copies only one row gives its
    shingles. Two shingles of a set may have the same 32 bits; a set is let
    off that many.
    """
    parts = (held.agg(F.sum(F.size("tokens"))).first()[0] or 0) // TASK_KEYS
    hits = _hits(_one_of_each(held), max(parts + 1, held.sparkSession.sparkContext.defaultParallelism))
    return hits.join(distinct, "row").where("10 * hits >= size - 10 * lost")


def _frequent(sets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that many sets hold, and how many, on some of the sets: any order of shingles gives the same pairs, so this only sets the cost."""
    some = sets.where(F.pmod("fp", F.lit(EVERY)) == 0).select(F.explode("tokens").alias("token")).groupBy("token").count().where("count > 2")
    rows = some.orderBy(F.desc("count"), "token").limit(FREQUENT).toArrow()
    token, count = rows["token"].to_numpy(), rows["count"].to_numpy()
    order = np.argsort(token)
    return token[order], count[order]


def parity_map(tokens: np.ndarray) -> np.ndarray:
    """Which of 512 places an odd number of the hashes fall on, as 8 words: two maps differ in no more bits than their sets in members."""
    odd = np.bincount((tokens.view(np.uint64) & np.uint64(64 * MAPS - 1)).astype(np.int64), minlength=64 * MAPS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _keyed(sets: DataFrame) -> DataFrame:
    """row, size, mark (fingerprint), share of rare shingles in 16 steps, keys and parity map of each set.

    A pair at 4/5 shares one of the first n - ceil(4n/5) + 1 shingles of
    either, in any order; 32 bits of each of these are the keys.
    """
    sent = sets.sparkSession.sparkContext.broadcast(_frequent(sets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, count = sent.value
        for batch in batches:
            share, keys, maps, marks = [], [], [], []
            for size, own in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                mine = own.values.to_numpy()
                at = np.minimum(np.searchsorted(token, mine), max(0, len(token) - 1))
                times = np.where(token[at] == mine, count[at], 0) if len(token) else np.zeros(size, np.int64)
                share.append(int(16 * (times == 0).mean()) if size else 0)
                first = mine[np.lexsort((mine, times))[: size - -(-PART * size // WHOLE) + 1]]
                keys.append(np.unique(first.astype(np.uint32)).view(np.int32))
                maps.append(parity_map(mine))
                marks.append(fingerprint(mine.view(np.uint64), 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(marks, pa.binary()), pa.array(share, pa.int8()), _lists(keys, pa.int32()), _lists(maps, pa.int64())], ["n", "size", "mark", "share", "keys", "maps"])

    return sets.select("row", "size", "tokens").mapInArrow(common.tidy(run), "n bigint, size bigint, mark binary, share tinyint, keys array<int>, maps array<bigint>")


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            i, j = x.values.to_numpy(), y.values.to_numpy()
            both = len(np.intersect1d(i, j, assume_unique=True))
            kept.append(WHOLE * both >= PART * (len(i) + len(j) - both))
        yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))


def set_links(held: DataFrame, distinct: DataFrame, docs: DataFrame) -> DataFrame:
    """Links (a, b) between sets fp that connect what all pairs at the similarity connect.

    Sets without a possible partner go first. Then come pairs whose
    fingerprints are equal or within two bits, by pigeonhole blocks. What
    these leave open is found by prefix filters: a pair shares one of the
    first shingles of either, rare ones first, so it meets in a bucket.

    Inside such a bucket not all pairs are made. In each round some members
    are compared with all others that they aren't connected to, by confirmed
    links, and leave the bucket: one in the first round, then all in a small
    bucket and 8, 64, ... in others. Those with the smallest share of rare shingles come first, as
    an original among its edits. A bucket is done when its members are
    connected or have all been compared. Every pair that is compared is first
    told by size and parity map, which the sets' difference bounds, and then
    by the sets themselves.
    """
    left = common.settled(_may_have_partner(held, distinct).select("fp", "first"), "left")
    # Their texts are found by a map of ids, of fixed size, without a shuffle; their sets by one of hashes.
    some = common.maybe_in(docs, "doc_id", left, "first", "may").where("may")
    sets = common.maybe_in(_sets(some, prefix=False), "fp", left, "fp", "may").where("may").drop("may")
    sets = common.settled(_one_of_each(common.settled(sets, "sets")), "distinct_sets")  # every confirmation reads them
    keyed = common.settled(_keyed(sets), "keyed")  # here n is the set's row number
    maps = [f"m{i}" for i in range(MAPS)]
    facts = keyed.select("n", "size", *[F.col("maps")[i].alias(m) for i, m in enumerate(maps)])
    tokens = sets.select(F.col("row").alias("n"), "tokens")

    def told(rows: DataFrame, n: str) -> DataFrame:
        """The rows with size and parity map of n, under its name."""
        return rows.join(facts.toDF(n, *[f"{n}_{c}" for c in ("size", *maps)]), n)

    def near(x: str, y: str) -> Column:
        """Whether sizes and parity maps allow the similarity."""
        apart = sum((F.bit_count(F.col(f"{x}_{m}").bitwiseXOR(F.col(f"{y}_{m}"))) for m in maps), F.lit(0))
        sizes = WHOLE * F.least(f"{x}_size", f"{y}_size") >= PART * F.greatest(f"{x}_size", f"{y}_size")
        return sizes & ((PART + WHOLE) * apart <= (WHOLE - PART) * (F.col(f"{x}_size") + F.col(f"{y}_size")))

    def confirmed(pairs: DataFrame) -> DataFrame:
        """The written pairs (a, b) that are at the similarity."""
        close = common.settled(told(told(pairs, "a"), "b").where(near("a", "b")).select("a", "b").distinct(), "close")
        if close.isEmpty():
            return close
        # Only the sets of these pairs travel.
        x, y = (common.maybe_in(tokens, "n", close, c, "may").where("may").select(F.col("n").alias(c), F.col("tokens").alias(v)) for c, v in (("a", "x"), ("b", "y")))
        both = close.join(x, "a").join(y, "b").select("a", "b", "x", "y")
        return common.settled(both.mapInArrow(_alike, "a bigint, b bigint").distinct(), "links")

    ends = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    by_print = common.settled(keyed.groupBy(F.col("mark").alias("fp")).agg(F.min("n").alias("n")), "marks")
    equal = keyed.select("n", F.col("mark").alias("fp")).join(by_print.withColumnRenamed("n", "m"), "fp").where("n <> m").select(*ends("n", "m"))
    tried = common.settled(equal.unionByName(links(by_print, 4, 2).select(*ends("a", "b"))).distinct(), "pairs")
    found = confirmed(tried)

    def rooted(rows: DataFrame, n: str, c: str) -> DataFrame:
        """The rows with the component c of n, as far as it is known."""
        if roots is None:
            return rows.withColumn(c, F.col(n))
        return rows.join(roots.select(F.col("node").alias(n), "root"), n, "left").withColumn(c, F.coalesce("root", n)).drop("root")

    # What a head has least of: its share of rare shingles, then its number; both in one long.
    members = keyed.select(F.explode("keys").alias("key"), (F.shiftleft(F.col("share").cast("bigint"), 58) + F.col("n")).alias("o"), "n")
    some, roots, more = 1, None, not found.isEmpty()
    while True:
        # Only buckets that hold unconnected members go on.
        if more:
            roots = common.settled(common.connected_components(found), "roots")
        placed = rooted(members, "n", "c")
        open_keys = placed.groupBy("key").agg(F.min("c").alias("x"), F.max("c").alias("y"), F.count("*").alias("m")).where("x <> y").select("key", (F.col("m") <= SMALL).alias("small"))
        placed = common.settled(placed.join(open_keys, "key"), "open")
        if placed.isEmpty():
            break
        part = F.when(F.col("small") & F.lit(some > 1), F.col("n")).otherwise(F.pmod(F.xxhash64("n", F.lit(some)), F.lit(some)))
        heads = placed.groupBy("key", part.alias("part")).agg(F.min("o").alias("o")).select("key", F.col("o").bitwiseAND(F.lit((1 << 58) - 1)).alias("r_n"))
        heads = common.settled(rooted(heads, "r_n", "r_c"), "heads")
        met = F.col("p.c") != F.col("h.r_c")
        if some > 1:  # several heads a bucket: only pairs that may be alike leave the join
            placed_, heads_, met = told(placed, "n"), told(heads, "r_n"), met & near("n", "r_n")
        else:
            placed_, heads_ = placed, heads
        pairs = placed_.alias("p").join(heads_.alias("h"), (F.col("p.key") == F.col("h.key")) & met).select(*ends("n", "r_n")).distinct()
        pairs = common.settled(pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
        new = confirmed(pairs)
        more = not new.isEmpty()
        found, tried = found.unionByName(new), tried.unionByName(pairs)
        members = placed.drop("c", "small").join(heads.select("key", F.col("r_n").alias("n")), ["key", "n"], "left_anti")
        some *= 8
    named = sets.select("row", "fp")
    return found.join(named.toDF("a", "x"), "a").join(named.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Components of texts whose 5-word shingle sets have a similarity of 0.8 or more: all such pairs, and no others.

    Sets are of 64-bit hashes and are told by one; equal sets are one node.
    """
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("t"))
    held = common.settled(_sets(docs, prefix=True), "prefixes")
    given = F.first("size") - F.floor(F.first("size") * 7 / 10) - F.first(F.size("tokens"))
    distinct = held.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("rows"), F.min("row").alias("row"), F.first("size").alias("size"), given.alias("lost"))
    distinct = common.settled(distinct.withColumn("n", F.col("fp")), "distinct")
    return linked(held, distinct, set_links(held, distinct, docs))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without those that are linked to a smaller doc_id. Rows that share an id stay or go together, rows without id stay."""
    found = near_components(docs, id_col, text_col)
    losers = common.settled(found.where("component_id < doc_id").select(F.col("doc_id").alias(id_col)).distinct(), "copies")
    return docs.join(losers, id_col, "left_anti")
