"""Chat formatting: a template renders each conversation with its loss mask.

Conversations are dealt out by id and sorted by turn; each is rendered while it is read, in
parts that end between turns, so that no conversation has to fit in memory. A control string
inside a text gets a backslash behind its first character, and a backslash is doubled, so the
template's own marks are the only ones and the text can be read back exactly.

Null texts and roles are empty. Rows of the same turn are ordered by role and text, and
repeated rows are turns of their own; a null turn comes first. Rows whose id is null are one
conversation. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from idcordon.llm import template as _template

# The marks of the format.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]", "[/TEXT]")
TEMPLATE = (
    "<s>{% for message in messages -%}"
    "{% if message.role == 'user' %}[INST] {{ message.text | guard }} [/INST]"
    "{% elif message.role == 'assistant' %} {% generation %}{{ message.text | guard }}{% endgeneration %}</s>"
    "{% elif message.role == 'system' %}<<SYS>>\n{{ message.text | guard }}\n<</SYS>>\n\n"
    "{% else %}[ROLE]{{ message.role | guard }}[/ROLE]{{ message.text | guard }}[/TEXT]{% endif %}"
    "{%- endfor %}"
)
# Opening and closing marks by role; None: any other role, which stands between the marks of the role.
_TURNS = (("[INST] ", " [/INST]", "user"), (" ", "</s>", "assistant"), ("<<SYS>>\n", "\n<</SYS>>\n\n", "system"),
          ("[ROLE]", "[/TEXT]", None))


@dataclass(frozen=True)
class ChatOptions:
    """part_chars: a part of a conversation's text ends at the first turn's end beyond so many characters."""

    template: str = TEMPLATE
    controls: tuple[str, ...] = CONTROLS
    part_chars: int = 1 << 20
    batch_chars: int = 1 << 22


def guard(controls: tuple[str, ...]) -> Callable[[str | None], str]:
    """Makes a text free of control strings; ``unguard`` reads it back."""
    found = re.compile(r"\\|" + "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in controls))
    return lambda text: found.sub(lambda m: m[0] + "\\", text or "")


def unguard(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text) if "\\" in text else text


@dataclass
class _Part:
    """Text under construction, with the spans of it that the model learns."""

    texts: list[str] = field(default_factory=list)
    size: int = 0
    spans: list[dict[str, int]] = field(default_factory=list)
    begin: int | None = None

    def take(self, piece: object) -> None:
        if piece is _template.BEGIN:
            self.begin = self.size
        elif piece is _template.END:
            self.spans.append({"begin": self.begin, "end": self.size})
            self.begin = None
        else:
            self.texts.append(piece)
            self.size += len(piece)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns))


def format_conversations(turns: DataFrame, options: ChatOptions | None = None) -> DataFrame:
    """conv_id, part, text and spans (begin, end: code points of the text that are learnt)."""
    options = options or ChatOptions()
    kind = turns.schema["conv_id"].dataType.simpleString()
    rows = (
        turns.select("conv_id", "turn", "role", "text")
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
    )
    arrow = pa.schema([("conv_id", pa.string() if kind == "string" else pa.int64()), ("part", pa.int32()),
                       ("text", pa.string()), ("spans", pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])))])

    def parts(messages: Iterator[tuple], render: Callable[..., Iterator[object]]) -> Iterator[_Part]:
        read = {"n": 0}

        def given() -> Iterator[dict[str, str]]:
            for r in messages:
                read["n"] += 1
                yield {"role": r[2] or "", "text": r[3] or ""}

        part, seen = _Part(), 0
        for piece in render(messages=given()):
            # A new message has been read: all pieces of the one before it are in this part.
            if read["n"] != seen and part.size >= options.part_chars and part.begin is None:
                yield part
                part = _Part()
            seen = read["n"]
            part.take(piece)
        yield part

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = _template.compile_template(options.template, guard=guard(options.controls))
        out, size = [], 0
        for conv, messages in itertools.groupby(_rows(batches), key=lambda r: r[0]):
            for k, part in enumerate(parts(messages, render)):
                out.append({"conv_id": conv, "part": k, "text": "".join(part.texts), "spans": part.spans})
                size += part.size + 100
                if size >= options.batch_chars:
                    yield pa.RecordBatch.from_pylist(out, schema=arrow)
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return rows.mapInArrow(run, f"conv_id {kind}, part int, text string, spans array<struct<begin: bigint, end: bigint>>")


def read_turns(pieces: Iterator[str]) -> Iterator[tuple[str, str]]:
    """Role and text of each turn of a conversation formatted by ``TEMPLATE``."""
    rest, at = "", 0
    for piece in pieces:
        rest, at = rest[at:] + piece, 0
        if rest.startswith("<s>"):
            at = 3
        while at < len(rest):
            opening, closing, role = next(t for t in _TURNS if rest.startswith(t[0], at))
            at += len(opening)
            if role is None:
                end = rest.index("[/ROLE]", at)
                role, at = unguard(rest[at:end]), end + len("[/ROLE]")
            end = rest.index(closing, at)
            yield role, unguard(rest[at:end])
            at = end + len(closing)


def digests(formatted: DataFrame) -> DataFrame:
    """What the formatted conversations say when they are read back; one row for each.

    The parts of a conversation stand one after the other in one partition, as
    ``format_conversations`` leaves them.
    """
    kind = formatted.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.string() if kind == "string" else pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    arrow = pa.schema(list(zip(names, kinds)))

    def one(conv: object, parts: Iterator[tuple]) -> dict[str, object]:
        turns, loss, n, learnt, chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0

        def texts() -> Iterator[str]:
            nonlocal learnt, chars
            for _, _, text, spans in parts:
                chars += len(text)
                for s in spans:
                    plain = unguard(text[s["begin"] : s["end"]])
                    learnt += len(plain)
                    loss.update(plain.encode())
                yield text

        for role, text in read_turns(texts()):
            n += 1
            turns.update(f"{role}\n{text}\n".encode())
        return dict(zip(names, (conv, n, turns.hexdigest(), learnt, loss.hexdigest(), chars)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for conv, parts in itertools.groupby(_rows(batches), key=lambda r: r[0]):
            out.append(one(conv, parts))
            if len(out) >= 4096:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    columns = f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return formatted.select("conv_id", "part", "text", "spans").mapInArrow(run, columns)
