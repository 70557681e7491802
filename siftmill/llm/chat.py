"""Formatting of conversations into training text with loss masks."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmill.llm.chat_template import Template

END = "</turn>"
MARK = "###"
DEFAULT_TEMPLATE = (
    "{% for message in messages %}"
    "{{ '### ' ~ (message.role | line) }}\n"
    "{% if message.role == 'assistant' %}{% generation %}{{ message.text | escape }}{% endgeneration %}"
    "{% else %}{{ message.text | escape }}{% endif %}"
    "</turn>\n"
    "{% endfor %}"
)

_CONTROL = re.compile(rf"\\|{MARK}|{END}")
_ESCAPED = re.compile(rf"\\(\\|{MARK}|{END}|n)")
_TURN = re.compile(rf"{MARK} ((?:[^\\\n]|\\.)*)\n((?:[^\\<]++|\\.|<(?!/turn>))*+){END}\n", re.DOTALL)


def escape(text: str) -> str:
    """A backslash before every backslash and control string."""
    return _CONTROL.sub(lambda m: "\\" + m[0], text)


def escape_line(text: str) -> str:
    """As ``escape``, and line ends as backslash n, for what has to stay on its line."""
    return escape(text).replace("\n", "\\n")


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], text)


FILTERS = {"escape": escape, "line": escape_line, "trim": str.strip, "upper": str.upper, "capitalize": str.capitalize}

_SEGMENTS = "turn_no bigint, start bigint, segment string, loss array<struct<start: bigint, end: bigint>>"
_LOSS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
ROWS_OUT = 4096


def format_conversations(conversations: DataFrame, template: str = DEFAULT_TEMPLATE, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per turn: conv_id, turn_no, start, segment, loss.

    The segments of a conversation, in the order of ``turn_no``, make up its
    formatted text; ``start`` is where a segment begins in it and ``loss`` lists
    the ranges in the segment the model is trained on, all in code points.

    Turns are ordered by turn, null first, then role and text. Null roles and
    texts count as empty; rows with a null id are one conversation; repeated
    rows are turns of their own; other columns are not looked at; an empty table
    gives an empty result. Rows come sorted by conversation, and every task
    reads them as a stream: of a conversation, however long, it holds one turn.
    """
    Template(template, FILTERS)  # a template that is wrong fails here

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = Template(template, FILTERS)
        rows = (row for batch in batches for row in zip(*(column.to_pylist() for column in batch.columns)))
        held, out, index, start = next(rows, None), [], 0, 0
        while held is not None:
            following = next(rows, None)
            last = following is None or following[0] != held[0]
            segment, spans = compiled.segment(held[1], held[2], index, last)
            out.append((held[0], index, start, segment, [{"start": a, "end": b} for a, b in spans]))
            index, start = (0, 0) if last else (index + 1, start + len(segment))
            held = following
            if len(out) >= ROWS_OUT or (held is None and out):
                yield _batch(out, ["conv_id", "turn_no", "start", "segment", "loss"], [None, pa.int64(), pa.int64(), pa.string(), _LOSS])
                out = []

    rows = conversations.select(
        F.col(id_col).cast("bigint").alias("conv_id"), F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(render, f"conv_id bigint, {_SEGMENTS}")


def _batch(rows: list[tuple], names: list[str], types: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t or pa.int64()) for c, t in zip(zip(*rows), types)], names)


def parse_segment(segment: str) -> list[tuple[str, str]]:
    """Role and text of the turns in formatted text of the default template."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(segment)]


def read_back(segments: DataFrame) -> DataFrame:
    """Digest of every formatted conversation, from its text and loss ranges alone.

    conv_id, n_turns, turns_sha256 (role, line end, text, line end for each
    turn), loss_chars and loss_sha256 (all text under the mask, unescaped),
    formatted_chars. Takes the rows as ``format_conversations`` gives them,
    sorted by conversation, and holds one segment at a time.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        out, state = [], None
        for batch in batches:
            for conv, number, segment, loss in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn_no", "segment", "loss"))):
                if number == 0:
                    if state is not None:
                        out.append(state.row())
                    state = _Digest(conv)
                state.add(segment, loss)
                if len(out) >= ROWS_OUT:
                    yield _batch(out, names, types)
                    out = []
        if state is not None:
            out.append(state.row())
        if out:
            yield _batch(out, names, types)

    return segments.select("conv_id", "turn_no", "segment", "loss").mapInArrow(
        digest, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    )


class _Digest:
    def __init__(self, conv):
        self.conv, self.turns, self.loss_chars, self.chars = conv, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, segment: str, loss: list[dict]) -> None:
        self.chars += len(segment)
        for role, text in parse_segment(segment):
            self.turns += 1
            self.all.update(f"{role}\n{text}\n".encode())
        for span in loss:
            text = unescape(segment[span["start"] : span["end"]])
            self.loss_chars += len(text)
            self.loss.update(text.encode())

    def row(self) -> tuple:
        return self.conv, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars
