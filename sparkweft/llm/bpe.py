"""BPE encoding and decoding with a public vocabulary file.

Encoding. A piece is a string of symbols; a token's symbols are its string.
An Aho-Corasick pass over the piece finds every token that occurs in it, and
from those the longest that begins at each place. Tokens are then laid from
the left: the longest one that may stand after the token before it. Two
neighbours are compatible if the merges, run on both strings together, leave
the boundary where it is; the answer is kept in a pair table. If none of the
tokens at a place is compatible, the last token is taken back and the next
shorter one tried; places that have failed are marked, so the work is linear.
A sequence in which all neighbours are compatible is the one that the merges
give.

Decoding. Token strings lie one after another in one byte array, cut by an
offset table; ids are decoded by gathering from it.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sparkweft.llm import common, pretoken

#: Pieces whose encoding a worker keeps, the longest that it keeps, and answers that its pair table keeps.
CACHE_PIECES, CACHE_LENGTH, PAIRS = 200_000, 64, 200_000
#: Bytes of text that are encoded at once; arrays over them take some 60 times as much.
CHUNK = 250_000
#: The rules of a vocabulary file that this module follows.
RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "decoder": None,
}
#: Settings of its model.
MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}
#: Final symbols are told from inner ones by this distance.
FINAL = 0x8000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = {b: chr(b) for b in printable}, 256
    for b in range(256):
        if b not in out:
            out[b], spare = chr(spare), spare + 1
    return [out[b] for b in range(256)]


class Backtracking:
    """Exact BPE of single pieces by longest matches and a pair table."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str):
        import ahocorasick

        self.suffix = suffix
        self.ids = {self.symbols(t): i for t, i in vocab.items()}
        self.string = {i: t for t, i in self.ids.items()}
        self.rank, self.split = {}, {}
        for r, (a, b) in enumerate(merges):
            x, y = self.ids[self.inner(a)], self.ids[self.symbols(b)]
            whole = self.ids[self.inner(a) + self.symbols(b)]
            self.rank[x, y] = r, whole
            self.split.setdefault(whole, (x, y, r))
        self.automaton = ahocorasick.Automaton()
        for t, i in self.ids.items():
            self.automaton.add_word(t, (i, len(t)))
        self.automaton.make_automaton()
        self.shorter: dict[int, int] = {}
        self.pairs: dict[int, bool] = {}  # by both ids in one number: half the memory of a tuple

    def symbols(self, token: str) -> str:
        """The token with its last character marked if it ends a piece."""
        if self.suffix and token.endswith(self.suffix) and len(token) > len(self.suffix):
            body = token[: -len(self.suffix)]
            return body[:-1] + chr(ord(body[-1]) + FINAL)
        return token

    def inner(self, token: str) -> str:
        return self.symbols(token)

    def next_shorter(self, token: int) -> int:
        """The longest token that is a proper prefix, or -1."""
        found = self.shorter.get(token)
        if found is None:
            s, found = self.string[token], -1
            for n in range(len(s) - 1, 0, -1):
                if (found := self.ids.get(s[:n], -1)) >= 0:
                    break
            self.shorter[token] = found
        return found

    def compatible(self, left: int, right: int) -> bool:
        both = left << 32 | right
        got = self.pairs.get(both)
        if got is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            got = self.pairs[both] = self._boundary_stays(left, right)
        return got

    def _boundary_stays(self, left: int, right: int) -> bool:
        """Undo merges from both sides, latest first, and see whether one across the boundary came earlier."""
        limit = len(self.rank)
        while True:
            r = self.rank.get((left, right))
            if r is not None and r[0] < limit:
                return False
            a, b = self.split.get(left), self.split.get(right)
            if a is None and b is None:
                return True
            # The part that was merged last is undone; on equal ranks the left pair came first.
            if b is None or (a is not None and a[2] > b[2]):
                limit, left = a[2], a[1]
            elif a is None or b[2] > a[2]:
                limit, right = b[2] + 1, b[0]
            else:
                limit, right = b[2] + 1, b[0]

    def merge(self, piece: str) -> list[int]:
        """The merges run one by one: the plain definition, for comparison and for pieces with unknown symbols."""
        out = [self.ids[c] for c in piece if c in self.ids]
        while len(out) > 1:
            best = min(((self.rank[p][0], i) for i, p in enumerate(zip(out, out[1:], strict=False)) if p in self.rank), default=None)
            if best is None:
                break
            i = best[1]
            out[i : i + 2] = [self.rank[out[i], out[i + 1]][1]]
        return out

    def encode(self, piece: str) -> list[int]:
        whole = self.ids.get(piece)
        if whole is not None and (whole in self.split or len(piece) == 1):
            return [whole]
        n = len(piece)
        longest = [-1] * n
        for end, (token, size) in self.automaton.iter(piece):
            longest[end - size + 1] = token  # ends only grow: the last is the longest
        if n and min(longest) < 0:
            return self.merge(piece)
        out: list[int] = []
        at, token, dead = 0, longest[0] if n else -1, bytearray(n + 1)
        while at < n:
            end = at + len(self.string[token])
            if not dead[end] and (not out or self.compatible(out[-1], token)):
                out.append(token)
                at = end
                token = longest[at] if at < n else -1
                continue
            token = self.next_shorter(token)
            while token < 0:
                dead[at] = 1
                if not out:
                    return self.merge(piece)
                last = out.pop()
                at -= len(self.string[last])
                token = self.next_shorter(last)
        return out


class WordBpe:
    """The vocabulary file's whole path: normalising, splitting, encoding, decoding."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        other = [k for k, v in RULES.items() if spec.get(k) != v] + [k for k, v in MODEL.items() if model.get(k, v) != v]
        if other:
            raise ValueError(f"{path} has other rules than this module follows: {', '.join(other)}")
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.bpe = Backtracking(model["vocab"], merges, self.suffix)
        self.symbol = byte_symbols()
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        strings = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.added.items()}
        raw = [(strings.get(i, "") + " ").encode() for i in range(max(strings) + 1)]
        self.offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
        self.blob = np.frombuffer(b"".join(raw), np.uint8)
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def normalize(self, text: str) -> str:
        """NFC, then lower case character by character (no final sigma). White space needs no rule: it ends pieces either way."""
        if text.isascii():
            return text.lower()
        if pretoken.unassigned()[pretoken.code_points(text)].any():  # newer characters: by the library's tables
            from tokenizers import normalizers

            return normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()]).normalize_str(text)
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        return text.replace("Σ", "σ").lower()

    def piece_ids(self, piece: str) -> bytes:
        """Ids of a piece as 32-bit integers; as bytes they take a third of an array's memory."""
        got = self.cache.get(piece)
        if got is None:
            got = self.older.get(piece)
            if got is None:
                mapped = "".join(map(self.symbol.__getitem__, piece.encode("utf-8", "replace")))
                marked = mapped[:-1] + chr(ord(mapped[-1]) + FINAL) if self.suffix else mapped
                got = np.array(self.bpe.encode(marked), np.uint32).tobytes()
            if len(piece) <= CACHE_LENGTH:
                if len(self.cache) >= CACHE_PIECES // 2:  # the half that was filled before goes
                    self.cache, self.older = {}, self.cache
                self.cache[piece] = got
        return got

    def encode_many(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and the bounds of each text in them."""
        parts: list[tuple[int, str | int]] = []  # (text, segment or id of an added token)
        for i, t in enumerate(texts):
            parts += [(i, x) for x in self._segments(t)]
        plain = [self.normalize(x) for _, x in parts if isinstance(x, str)]
        joined = "".join(plain)
        cp = pretoken.code_points(joined)
        limits = np.concatenate([[0], np.cumsum([len(x) for x in plain])]).astype(np.int64)
        s, e = pretoken.spans(cp, limits, keep_spaces=False)
        if len(s):
            pieces, which = pretoken.distinct(cp, joined, s, e)
            rows = [self.piece_ids(p) for p in pieces]
            offsets = np.concatenate([[0], np.cumsum([len(r) // 4 for r in rows])]).astype(np.int64)
            ids, lengths = pretoken.ragged_gather(np.frombuffer(b"".join(rows), np.uint32), offsets, which)
            ends = np.concatenate([[0], np.cumsum(lengths)])
            cuts = ends[np.searchsorted(s, limits)]
        else:
            ids, cuts = np.zeros(0, np.uint32), np.zeros(len(limits), np.int64)
        if len(plain) == len(parts) == len(texts):
            return ids, cuts
        out: list[list[np.ndarray]] = [[] for _ in texts]
        k = 0
        for i, x in parts:
            if isinstance(x, str):
                out[i].append(ids[cuts[k] : cuts[k + 1]])
                k += 1
            else:
                out[i].append(np.array([x], np.uint32))
        joined_ids = [np.concatenate(o) if o else np.zeros(0, np.uint32) for o in out]
        return np.concatenate([np.zeros(0, np.uint32), *joined_ids]), np.concatenate([[0], np.cumsum([len(o) for o in joined_ids])]).astype(np.int64)

    def _segments(self, text: str) -> list[str | int]:
        """The text cut at added tokens, which stand for themselves before any normalising."""
        found = [a for a in self.added if a in text]
        if not found:
            return [text]
        import regex

        cut = regex.split("(" + "|".join(map(regex.escape, sorted(found, key=len, reverse=True))) + ")", text)
        return [self.added.get(x, x) for x in cut if x]

    def decode_many(self, ids: np.ndarray, cuts: np.ndarray) -> list[bytes]:
        """Token strings of each text with single spaces between, from the offset table."""
        flat, lengths = pretoken.ragged_gather(self.blob, self.offsets, ids.astype(np.int64))
        at = np.concatenate([[0], np.cumsum(lengths)])[cuts]
        raw = flat.tobytes()
        return [raw[a : max(a, b - 1)] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


@lru_cache(2)
def tokenizer(path: str) -> WordBpe:
    return WordBpe(path)


def encode_texts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, n_tokens, token_ids (array of int), decoded text of each row.

    Null and empty texts give no tokens and an empty text; repeated rows stay
    rows; an empty table gives none; other columns are not read. A text of any
    length is encoded whole.
    """
    return _encoded(docs, path, id_col, text_col, "token_ids array<int>, decoded string", _full)


def encode_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The same with SHA-256 digests for the ids (little-endian 32 bits) and the decoded text."""
    return _encoded(docs, path, id_col, text_col, "ids_sha256 string, decoded_sha256 string", _digest)


def _full(ids: np.ndarray, cuts: np.ndarray, texts: list[bytes]) -> list[pa.Array]:
    return [pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(ids.astype(np.int32))), pa.array([t.decode("utf-8", "replace") for t in texts], pa.string())]


def _digest(ids: np.ndarray, cuts: np.ndarray, texts: list[bytes]) -> list[pa.Array]:
    raw = ids.astype("<u4").tobytes()
    ids_sha = [hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
    return [pa.array(ids_sha, pa.string()), pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())]


def _encoded(docs: DataFrame, path: str, id_col: str, text_col: str, more: str, columns) -> DataFrame:
    common.small_batches(docs.sparkSession)
    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, n_tokens bigint, {more}"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)
        for batch in batches:
            for part in common.slices(batch, 1, CHUNK):
                ids, cuts = tok.encode_many(common.column_texts(part.column(1)))
                made = columns(ids, cuts, tok.decode_many(ids, cuts))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(cuts), pa.int64()), *made], names)
            common.give_back()  # else a worker keeps half as much again as it uses

    return docs.select(id_col, text_col).mapInArrow(common.tidy(run), schema)
