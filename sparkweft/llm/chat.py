"""Chat formatting with typed content parts.

A turn's content is a list of parts. A visitor flattens them in order: text is
escaped, other parts become numbered placeholders, and each reference is
recorded with the tokens that it will expand to. A template marks the turns;
the strings that it uses are escaped inside texts, so a formatted conversation
can be read back exactly.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkweft.llm import common

#: The template: how a turn begins and ends, and names of frequent roles. Other roles are written after ``role=``.
BEGIN, SEP, END = "### ", ": ", " </turn>\n"
ROLES = {"system": "System", "user": "User", "assistant": "Assistant"}
_BACK = {v: k for k, v in ROLES.items()}
_CONTROL = re.compile(r"\\|#(?=##)|<(?=/turn>)|<(?=\|)")
_ROLE_CONTROL = re.compile(r"\\|:|\n|#|<")
_ESCAPED = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"### ((?:[^\\:\n]|\\.)*): ((?:[^\\<#]|\\.|<(?!/turn>)|#(?!## ))*?) </turn>\n", re.S)
_TOKEN = re.compile(r"<\|(image|audio|document):(\d+)\|>")


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


@dataclass
class Rules:
    """Tokens that attachments expand to."""

    image_tile: int = 14
    image_merge: int = 2
    audio_tokens_a_second: float = 25.0
    document_tokens_a_page: int = 800


@dataclass
class Flatten:
    """Visits parts and keeps what they leave: text, attachments, tokens."""

    rules: Rules = field(default_factory=Rules)
    text: list[str] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)

    def visit(self, part: dict) -> None:
        kind = part.get("type") or "text"
        getattr(self, f"visit_{kind}", self.visit_other)(part)

    def visit_text(self, part: dict) -> None:
        self.text.append(escape(part.get("text") or ""))

    def visit_image(self, part: dict) -> None:
        cell = self.rules.image_tile * self.rules.image_merge
        self._attach("image", part, math.ceil((part.get("width") or cell) / cell) * math.ceil((part.get("height") or cell) / cell))

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part, math.ceil((part.get("seconds") or 0) * self.rules.audio_tokens_a_second))

    def visit_document(self, part: dict) -> None:
        self._attach("document", part, (part.get("pages") or 1) * self.rules.document_tokens_a_page)

    def visit_other(self, part: dict) -> None:
        self.visit_text({"text": json.dumps(part, sort_keys=True, ensure_ascii=False)})

    def _attach(self, kind: str, part: dict, tokens: int) -> None:
        self.text.append(f"<|{kind}:{len(self.attachments)}|>")
        self.attachments.append({"kind": kind, "ref": part.get("ref") or "", "tokens": int(tokens)})


class Conversation:
    """A conversation that is formatted turn by turn."""

    def __init__(self, rules: Rules | None = None, trained: frozenset[str] = frozenset({"assistant"})):
        self.flat, self.trained = Flatten(rules or Rules()), trained
        self.pieces: list[str] = []
        self.mask: list[tuple[int, int]] = []
        self.length = 0

    def add(self, role: str | None, parts: list[dict]) -> None:
        role = role or ""
        self.flat.text = []
        for p in parts:
            self.flat.visit(p)
        body = "".join(self.flat.text)
        name = ROLES.get(role) or "role=" + _ROLE_CONTROL.sub(lambda m: "\\" + m[0], role)
        head = BEGIN + name + SEP
        if role in self.trained:
            self.mask.append((self.length + len(head), self.length + len(head) + len(body)))
        self.pieces += [head, body, END]
        self.length += len(head) + len(body) + len(END)

    def formatted(self) -> str:
        return "".join(self.pieces)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of the turns; placeholders stay in the text."""
    out, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            raise ValueError(f"no turn at {at}")
        at = m.end()
        role = unescape(m[1][5:]) if m[1].startswith("role=") else _BACK[m[1]]
        out.append((role, unescape(m[2])))
    if at != len(formatted):
        raise ValueError(f"no turn at {at}")
    return out


def placeholders(formatted: str) -> list[int]:
    """Numbers of the attachments in order; escaped look-alikes don't count."""
    return [int(m[2]) for m in _TOKEN.finditer(_ESCAPED.sub("\0\0", formatted))]


SCHEMA = "n_turns bigint, formatted string, loss_spans array<struct<start:int,end:int>>, attachments array<struct<kind:string,ref:string,tokens:int>>, expanded_tokens bigint"


def format_conversations(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str | None = "text", parts_col: str | None = None, rules: Rules | None = None) -> DataFrame:
    """A row for each conversation: conv_id, n_turns, formatted, loss_spans, attachments, expanded_tokens.

    Turns are ordered by number, then role, then text (null first), so repeated rows have
    a fixed order. A null text is empty, a null role an empty one; a null
    conv_id is a conversation of its own. Parts are an array of structs with
    type, text, ref, width, height, seconds and pages, as far as they are
    there. Rows are sorted by Spark and streamed through, a conversation is
    held only while it is written. An empty table gives no rows.
    """
    common.small_batches(turns.sparkSession)
    content = F.to_json(parts_col) if parts_col else F.col(text_col)
    rows = turns.select(F.col(id_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), content.alias("content"))
    kind = rows.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", *(x.split()[0] for x in SCHEMA.split(", "))]
    typed = parts_col is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, open_, count = None, None, 0
        id_type = None
        done: list[tuple] = []

        def closed() -> tuple:
            return key, count, open_.formatted(), [{"start": a, "end": b} for a, b in open_.mask], open_.flat.attachments, sum(x["tokens"] for x in open_.flat.attachments)

        def batch_of(found: list[tuple]) -> pa.RecordBatch:
            types = [id_type, pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.list_(pa.struct([("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int32())])), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate(types)], names)

        for batch in batches:
            id_type = batch.column(0).type
            for conv, role, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), common.column_texts(batch.column(3)), strict=True):
                if open_ is None or conv != key:
                    if open_ is not None:
                        done.append(closed())
                    key, open_, count = conv, Conversation(rules), 0
                open_.add(role, json.loads(text or "[]") if typed else [{"type": "text", "text": text}])
                count += 1
            if done:
                yield batch_of(done)
                done = []
        if open_ is not None:
            yield batch_of([closed()])

    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "content")
    return dealt.mapInArrow(run, f"conv_id {kind}, {SCHEMA}")


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what the formatted text and its loss mask say: the turns, and the unescaped text under the mask."""
    kind = formatted.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv, text, spans in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                turns = read_turns(text)
                loss = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
                whole = "".join(f"{role}\n{said}\n" for role, said in turns)
                out.append((conv, len(turns), _sha(whole), len(loss), _sha(loss), len(text)))
            types = [batch.column(0).type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(types)], names)

    return formatted.select("conv_id", "formatted", "loss_spans").mapInArrow(run, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
