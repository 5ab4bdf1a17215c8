"""Language identification by error-correcting output codes.

Every language has a codeword; one linear classifier over hashed byte n-grams
predicts each bit. Decoding sums, for every codeword, the logistic loss of all
bit outputs, each weighted by how well that bit told that language in
training, and takes the codeword of least loss. If the next one is hardly
worse the text is flagged as ambiguous.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkweft.llm import common

UNKNOWN = "und"
#: Hashed features, rows that a language gives to the training sample, rows that all give at most, longest code.
FEATURES, SAMPLE_PER_LANGUAGE, MOST_SAMPLE, MAX_BITS = 4096, 1000, 16_000, 31
#: A text is ambiguous if its share of the likelihood is below this.
AMBIGUOUS = 0.4

_KEEP = np.full(256, 32, np.uint8)  # ASCII letters, lowered, and all bytes of other characters
_KEEP[65:91] = np.arange(97, 123)
_KEEP[97:123] = np.arange(97, 123)
_KEEP[128:] = np.arange(128, 256)


def features(text: bytes) -> np.ndarray:
    """Counts of hashed byte 2-, 3- and 4-grams of the whole text, damped and brought to length 1."""
    x = _KEEP[np.frombuffer(b" " + text + b" ", np.uint8)]
    x = x[np.concatenate([[True], (x[1:] != 32) | (x[:-1] != 32)])].astype(np.uint32)
    if len(x) < 4:
        x = np.concatenate([x, np.full(4 - len(x), 32, np.uint32)])
    two = x[:-1] << np.uint32(8) | x[1:]
    three = two[:-1] << np.uint32(8) | x[2:]
    four = three[:-1] << np.uint32(8) | x[3:]
    mixed = np.concatenate([two * np.uint32(0x9E3779B1), three * np.uint32(0x85EBCA6B), four * np.uint32(0xC2B2AE35)])
    counts = np.bincount(mixed >> np.uint32(20), minlength=FEATURES).astype(np.float32)
    np.sqrt(counts, out=counts)
    return counts / np.linalg.norm(counts)


def codewords(n: int) -> np.ndarray:
    """(n, bits) of -1 and 1: all splits in two for few languages, else the best of many drawn codes."""
    if n <= 5:
        bits = max(1, 2 ** (n - 1) - 1)
        return np.array([[1 if i == 0 or not (b >> (n - 1 - i)) & 1 else -1 for b in range(1, bits + 1)] for i in range(n)])
    rng, best, far = np.random.default_rng(0), None, -1
    for _ in range(400):
        code = rng.choice([-1, 1], (n, MAX_BITS))
        apart = ((MAX_BITS - code @ code.T) // 2 + MAX_BITS * np.eye(n, dtype=int)).min()
        if apart > far and (np.abs(code.sum(0)) < n).all():
            best, far = code, apart
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of the language and its share of the likelihood."""
        out = x @ self.weights + self.bias
        loss = np.logaddexp(0, -self.code[None] * out[:, None, :]) * self.trust[None]
        share = np.exp(-loss.sum(2))
        share /= share.sum(1, keepdims=True)
        best = share.argmax(1)
        return best, share[np.arange(len(best)), best]


def fit(x: np.ndarray, labels: list[str], rounds: int = 150) -> Model:
    """Logistic regression of every bit at once by accelerated gradient descent."""
    languages = sorted(set(labels))
    code = codewords(len(languages)) if languages else np.zeros((0, 1), int)
    place = {v: i for i, v in enumerate(languages)}
    which = np.array([place[v] for v in labels], int)
    y = code[which].astype(np.float32) if languages else np.zeros((0, 1), np.float32)
    size = np.bincount(which, minlength=len(languages)).astype(np.float32)
    row = (1 / (len(languages) * size[which]))[:, None].astype(np.float32)  # each language weighs the same
    w, b = np.zeros((FEATURES, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    vw, vb = w.copy(), b.copy()
    for k in range(rounds if len(languages) > 1 else 0):
        g = -y / (1 + np.exp(np.clip(y * (x @ vw + vb), -30, 30))) * row
        old_w, old_b = w, b
        w, b = vw - 8 * (x.T @ g + 1e-5 * vw), vb - 8 * g.sum(0)
        vw, vb = w + k / (k + 3) * (w - old_w), b + k / (k + 3) * (b - old_b)
    hit = (y * (x @ w + b) > 0).astype(np.float32)
    trust = np.array([hit[which == i].mean(0) for i in range(len(languages))]) if languages else np.zeros((0, 1))
    trust = trust / np.maximum(trust.mean(1, keepdims=True), 1e-9)
    return Model(languages, code, w, b, trust)


def train(docs: DataFrame, label_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", per_language: int = SAMPLE_PER_LANGUAGE) -> Model:
    """A model from the labelled rows given.

    The sample has at most ``per_language`` rows of each language, and all
    languages together at most MOST_SAMPLE: those of the smallest hashes of id
    and text, equal rows once. That bound keeps what comes to the driver small,
    also where ids are null or repeated; nothing else is sampled.
    """
    common.small_batches(docs.sparkSession)
    labelled = docs.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull())
    hashed = labelled.select(F.col(label_col).alias("label"), F.xxhash64(id_col, text_col).alias("h"), F.col(text_col).alias("text"))
    counts = {r[0]: max(r[1], 1) for r in hashed.groupBy("label").agg(F.approx_count_distinct("h")).collect()}
    if not counts:
        return fit(np.zeros((0, FEATURES), np.float32), [])
    most = min(per_language, MOST_SAMPLE / len(counts))
    # A little more than the share is drawn, then the bound holds to the row.
    share = F.element_at(F.create_map(*(F.lit(v) for k, n in counts.items() for v in (k, min(1.0, 1.25 * most / n + 50 / n)))), F.col("label"))
    drawn = hashed.where(F.pmod("h", F.lit(1 << 30)) < share * F.lit(float(1 << 30))).groupBy("label", "h").agg(F.first("text").alias("text"))
    place = F.row_number().over(Window.partitionBy("label").orderBy(F.pmod("h", F.lit(1 << 30)), "h"))
    drawn = drawn.withColumn("place", place).where(F.col("place") <= int(most)).select("label", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(t).astype(np.float16).tobytes() for t in common.column_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], ["label", "x"])

    rows = drawn.mapInArrow(common.tidy(run), "label string, x binary").toArrow()
    # The driver holds the rows once as they came and once as a matrix.
    labels, raw = rows["label"].to_pylist(), [y.as_buffer() for y in rows["x"]]
    order = sorted(range(len(labels)), key=lambda i: (labels[i], zlib.crc32(raw[i])))  # whatever the order of the rows
    x = np.empty((len(raw), FEATURES), np.float32)
    for k, i in enumerate(order):
        x[k] = np.frombuffer(raw[i], np.float16)
    del rows, raw
    model = fit(x, [labels[i] for i in order])
    del x
    common.give_back()
    return model


def has_letter(text: str) -> bool:
    return text.isalpha() or any(map(str.isalpha, text))


def predict(docs: DataFrame, model: Model, keep: list[Column | str], text_col: str = "text") -> DataFrame:
    """The kept columns with lang_pred, score (0 to 1) and ambiguous, for each row's whole text.

    Null texts and texts without a letter have ``und``, score 0, and are not
    ambiguous; so has every text if nothing was learned. A single learned
    language is predicted with score 1. Kept columns that are named like these
    three are replaced.
    """
    common.small_batches(docs.sparkSession)
    made = "lang_pred", "score", "ambiguous"
    given = docs.select(*keep).drop(*made)
    out = given.schema.fields
    # The text is the column of its own name, or the last one if that is not kept.
    at = given.columns.index(text_col) if text_col in given.columns else len(out)
    if at == len(out):
        given = docs.select(*keep, F.col(text_col).alias(*common.fresh_names(given, "text"))).drop(*made)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in out]
    names = [f.name for f in out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            texts, raw = common.column_texts(batch.column(at)), common.column_bytes(batch.column(at))
            lang, score, doubt = [UNKNOWN] * n, [0.0] * n, [False] * n
            known = [i for i in range(n) if model.languages and has_letter(texts[i])]
            if known:
                best, share = model.predict(np.stack([features(raw[i]) for i in known]))
                for i, k, s in zip(known, best.tolist(), share.tolist(), strict=True):
                    lang[i], score[i], doubt[i] = model.languages[k], float(s), s < AMBIGUOUS
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(lang), pa.array(score, pa.float64()), pa.array(doubt)], [*names, "lang_pred", "score", "ambiguous"])

    return given.mapInArrow(common.tidy(run), ", ".join([*fields, "lang_pred string", "score double", "ambiguous boolean"]))


def held_out(id_col: str = "doc_id") -> Column:
    """The fold that is not learned from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))
