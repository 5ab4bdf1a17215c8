"""Token-id files with Elias-Fano document bounds.

A shard image holds, one after another:

- ``EFT1``, then little-endian u32: bytes of an id (2 or 4), documents,
  documents with null id (they come first), and i64: the smallest doc_id;
- the bounds of the documents in the id array, Elias-Fano coded;
- the doc_ids less the smallest, Elias-Fano coded;
- the ids.

An Elias-Fano list of n values up to u keeps floor(log2(u / n)) low bits of
each value as they are and the rest in unary, so about 2 + log2(u / n) bits a
value. Every 64th one bit has its place in a table of u32, from which select
counts at most a few words on: no 64-bit offset table is needed.

Shards are rows of a Parquet table, so they go to whatever store Spark writes
to and a lost task leaves nothing behind; ``export`` writes them out as plain
files.

Texts are encoded where they are read, and only ids travel: each document's
are compressed, dealt by ranges of the doc_id and sorted. The ranges come from
quantiles of the ids alone. An id that many rows share spans several ranges,
among which its rows are dealt, so it fills no single task.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkweft.llm import common, pretoken

#: Ids after which a shard is closed (a longer document has one of its own), bytes of text encoded at once.
SHARD_IDS, CHUNK = 400_000, 2_000_000
#: Pieces whose ids a worker keeps, and the longest that it keeps.
CACHE_PIECES, CACHE_LENGTH = 500_000, 64
SELECT_STEP = 64
#: The rules of a vocabulary file that this module follows.
RULES = {"normalizer": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}}


class EliasFano:
    """A nondecreasing list of non-negative integers."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, np.uint64)
        n = len(v)
        top = int(v[-1]) if n else 0
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        bits = (v[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1) if low_bits else np.zeros((n, 0), np.uint64)
        low = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little")
        at = (v >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        ones = np.zeros(-(-(int(at[-1]) + 1 if n else 0) // 64) * 64, np.uint8)
        ones[at] = 1
        return cls(n, low_bits, low, np.packbits(ones, bitorder="little"), at[::SELECT_STEP].astype(np.uint32))

    def to_bytes(self) -> bytes:
        head = struct.pack("<IIIII", self.n, self.low_bits, len(self.low), len(self.high), len(self.samples))
        return head + self.low.tobytes() + self.high.tobytes() + self.samples.astype("<u4").tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes, at: int) -> tuple[EliasFano, int]:
        n, low_bits, nl, nh, ns = struct.unpack_from("<IIIII", raw, at)
        at += 20
        low = np.frombuffer(raw, np.uint8, nl, at)
        high = np.frombuffer(raw, np.uint8, nh, at + nl)
        samples = np.frombuffer(raw, "<u4", ns, at + nl + nh)
        return cls(n, low_bits, low, high, samples), at + nl + nh + 4 * ns

    def select(self, i: np.ndarray) -> np.ndarray:
        """Places of the one bits of those numbers: from the sample before each, whole words on, then inside a word."""
        i = np.asarray(i, np.int64)
        place = self.samples[i // SELECT_STEP].astype(np.int64)
        left = i % SELECT_STEP  # ones still to come after the sample's
        words = self.high.view("<u8")
        k = place // 64
        word = words[k] & ~((np.uint64(2) << (place % 64).astype(np.uint64)) - np.uint64(1)) if len(i) else np.zeros(0, np.uint64)
        ones = np.bitwise_count(word).astype(np.int64)
        far = np.flatnonzero(ones < left)
        while len(far):
            left[far] -= ones[far]
            k[far] += 1
            word[far] = words[k[far]]
            ones[far] = np.bitwise_count(word[far])
            far = far[ones[far] < left[far]]
        # Inside a word by halves: go to the upper half if the lower one has too few.
        bit, at = np.zeros(len(i), np.uint64), left.copy()
        for half in (32, 16, 8, 4, 2, 1):
            low = np.bitwise_count((word >> bit) & np.uint64((1 << half) - 1)).astype(np.int64)
            up = at > low
            at -= np.where(up, low, 0)
            bit += np.where(up, np.uint64(half), np.uint64(0))
        return np.where(left > 0, k * 64 + bit.astype(np.int64), place)

    def get(self, i: np.ndarray) -> np.ndarray:
        """The values of those numbers, by select."""
        i = np.asarray(i, np.int64)
        out = (self.select(i) - i) << self.low_bits
        if self.low_bits:
            bits = i[:, None] * self.low_bits + np.arange(self.low_bits)
            out |= (self.low[bits >> 3].astype(np.int64) >> (bits & 7) & 1) @ (np.int64(1) << np.arange(self.low_bits))
        return out


def pack(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    """A shard image of documents in ascending order, null ids first."""
    nulls = sum(x is None for x in doc_ids)
    known = np.array(doc_ids[nulls:], np.int64)
    least = int(known[0]) if len(known) else 0
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    head = b"EFT1" + struct.pack("<IIIq", ids.dtype.itemsize, len(doc_ids), nulls, least)
    return head + EliasFano.encode(bounds).to_bytes() + EliasFano.encode(known - least).to_bytes() + ids.tobytes()


class Shard:
    """A shard image, read in place."""

    def __init__(self, raw: bytes):
        if raw[:4] != b"EFT1":
            raise ValueError("not a shard image")
        width, self.n_docs, self.nulls, self.least = struct.unpack_from("<IIIq", raw, 4)
        self.bounds, at = EliasFano.from_bytes(raw, 24)
        self.keys, at = EliasFano.from_bytes(raw, at)
        self.ids = np.frombuffer(raw, f"<u{width}", offset=at)

    def starts(self) -> np.ndarray:
        """Where each document begins in the ids, and the end."""
        return self.bounds.get(np.arange(self.n_docs + 1))

    def document(self, i: int) -> np.ndarray:
        """Ids of the i-th document, by two selects."""
        first, end = self.bounds.get(np.array([i, i + 1]))
        return self.ids[first:end]

    def doc_ids(self) -> list[int | None]:
        return [None] * self.nulls + (self.keys.get(np.arange(self.n_docs - self.nulls)) + self.least).tolist()


class ByteBpe:
    """Byte-level encoding: pieces are split here, each distinct one is encoded by the tokenizers library once."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        from sparkweft.llm.bpe import MODEL, byte_symbols

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        other = [k for k, v in RULES.items() if spec.get(k) != v] + [k for k, v in MODEL.items() if spec["model"].get(k, v) != v]
        if other:
            raise ValueError(f"{path} has other rules than this module follows: {', '.join(other)}")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.symbol = byte_symbols()
        self.ascii = {i: s for i, s in enumerate(self.symbol) if i < 128}
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 65536 else "<u4")
        self.cache: dict[str, bytes] = {}

    def piece(self, text: str) -> bytes:
        mapped = text.translate(self.ascii) if text.isascii() else "".join(map(self.symbol.__getitem__, text.encode("utf-8", "replace")))
        got = np.array([t.id for t in self.model.tokenize(mapped)], self.dtype).tobytes()
        if len(text) <= CACHE_LENGTH:
            if len(self.cache) >= CACHE_PIECES:
                self.cache.clear()
            self.cache[text] = got
        return got

    def encode_many(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and each text's bounds. Texts with an added token's string go to the library whole."""
        odd = {i: np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, self.dtype) for i, t in enumerate(texts) if any(a in t for a in self.added)}
        plain = ["" if i in odd else t for i, t in enumerate(texts)]
        joined = "".join(plain)
        limits = np.concatenate([[0], np.cumsum([len(t) for t in plain])]).astype(np.int64)
        cp = pretoken.code_points(joined)
        s, e = pretoken.spans(cp, limits, keep_spaces=True)
        ids, cuts = np.zeros(0, self.dtype), np.zeros(len(limits), np.int64)
        if len(s):
            pieces, which = pretoken.distinct(cp, joined, s, e)
            get, make = self.cache.get, self.piece
            rows = [get(p) or make(p) for p in pieces]
            offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64) // self.dtype.itemsize
            ids, lengths = pretoken.ragged_gather(np.frombuffer(b"".join(rows), self.dtype), offsets, which)
            cuts = np.concatenate([[0], np.cumsum(lengths)])[np.searchsorted(s, limits)]
        if not odd:
            return ids, cuts
        rows = [odd[i] if i in odd else ids[cuts[i] : cuts[i + 1]] for i in range(len(texts))]
        return np.concatenate(rows), np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)


@lru_cache(2)
def tokenizer(path: str) -> ByteBpe:
    return ByteBpe(path)


SHARDS = "part bigint, seq bigint, n_docs bigint, n_ids bigint, image binary"


def _ranges(rows: DataFrame, parts: int) -> np.ndarray:
    """Quantiles of the ids k that deal them to that many parts; an id of many rows is there several times."""
    shares = [i / parts for i in range(1, parts)]
    found = rows.agg(F.percentile_approx("k", shares, 100 * parts).alias("q")).first().q if parts > 1 else []
    return np.array(found or [], np.int64)


def write_shards(docs: DataFrame, tokenizer_path: str, end_id: int, out: str, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Encode every text, append ``end_id``, and write shards in ascending id order to ``out``.

    A shard is a run of the order; (part, seq) orders the shards. Null and
    empty texts have just the end id, rows with equal ids stay rows, side by
    side, null ids come first, an empty table gives no shard; other columns
    are not read.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    rows = docs.select(F.col(id_col).cast("bigint").alias("k"), F.col(text_col).alias("t"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = _ranges(rows, parts)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from zstandard import ZstdCompressor

        tok, pack_one, done = tokenizer(tokenizer_path), ZstdCompressor(level=3).compress, 0
        for batch in batches:
            for piece in common.slices(batch, 1, CHUNK):
                ids, cuts = tok.encode_many(common.column_texts(piece.column(1)))
                ids = np.insert(ids, cuts[1:], np.array(end_id, ids.dtype))
                cuts = (cuts + np.arange(len(cuts))).tolist()
                keys = piece.column(0)
                known = keys.fill_null(0).to_numpy()
                first, last = np.searchsorted(bounds, known, "left"), np.searchsorted(bounds, known, "right")
                part = first + (done + np.arange(len(known))) % (last - first + 1)
                part[keys.is_null().to_numpy(zero_copy_only=False)] = 0
                done += len(known)
                held = [pack_one(ids[a:b].tobytes()) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([keys, pa.array(part, pa.int32()), pa.array(held, pa.binary())], ["k", "part", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from zstandard import ZstdDecompressor

        part, seq, dtype, unpack = TaskContext.get().partitionId(), 0, tokenizer(tokenizer_path).dtype, ZstdDecompressor().decompress
        keys: list = []
        held: list[np.ndarray] = []
        count = 0

        def close() -> pa.RecordBatch:
            ids = np.concatenate(held)
            row = [part], [seq], [len(keys)], [len(ids)], [pack(keys, [len(x) for x in held], ids)]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, (pa.int64(),) * 4 + (pa.binary(),), strict=True)], ["part", "seq", "n_docs", "n_ids", "image"])

        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.frombuffer(unpack(raw), dtype)
                if count and count + len(ids) > SHARD_IDS:
                    yield close()
                    keys, held, count, seq = [], [], 0, seq + 1
                keys.append(k)
                held.append(ids)
                count += len(ids)
        if keys:
            yield close()

    dealt = rows.mapInArrow(common.tidy(encode), "k bigint, part int, ids binary").repartitionById(parts, F.col("part"))
    dealt.select("k", "ids").sortWithinPartitions(F.col("k").asc_nulls_first()).mapInArrow(common.tidy(run), SHARDS).write.option("parquet.block.size", 16 << 20).parquet(out)
    return out


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the shards."""
    common.small_batches(spark)
    shards = spark.read.schema(SHARDS).parquet(path)
    by_part = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = by_part.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("p"))
    inside = F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_ids")
    bases = shards.select("part", "seq", inside.alias("i")).join(parts, "part").select("part", "seq", (F.col("p") + F.col("i")).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, image in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                shard = Shard(image)
                bounds = shard.starts()
                wide = shard.ids.astype("<u4").tobytes()
                crc = [zlib.crc32(wide[4 * a : 4 * b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                n = shard.n_docs
                cols = [pa.array(shard.doc_ids(), pa.int64()), pa.array(bounds[:-1]), pa.array(np.diff(bounds)), pa.array(crc, pa.int64()), pa.array([part] * n, pa.int64()), pa.array([seq] * n, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "local", "n_tokens", "ids_crc32", "part", "seq"])

    docs = shards.select("part", "seq", "image").mapInArrow(run, "doc_id bigint, local bigint, n_tokens bigint, ids_crc32 bigint, part bigint, seq bigint")
    return docs.join(bases, ["part", "seq"]).select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def export(shards: DataFrame, folder: str) -> None:
    """Each shard image as a plain file in a folder that the driver sees, a shard at a time."""
    for r in shards.orderBy("part", "seq").toLocalIterator():
        with open(f"{folder}/{r.part:06d}-{r.seq:06d}.eft", "wb") as f:
            f.write(r.image)
