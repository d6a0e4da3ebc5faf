"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it as context, and only the words of that reply under the loss
mask. Turns after the last reply, and conversations without one, end in an example without a target, so no turn is lost.

A turn reads ``<|im_start|>role``, line end, text, ``<|im_end|>``, line end. Control strings inside texts are made harmless: each
``<`` followed by backslashes (or none) and a bar gets one backslash more, and loses it when read. Roles also have backslashes
and line ends written as ``\\\\`` and ``\\n``.

Rows are dealt by conversation, sorted by turn, role and text, and formatted as they stream past; memory holds one conversation.
The examples of a conversation of t turns hold about t/2 prefixes of it, which is what this format means. Null
text is empty, a null role is empty and no assistant; a null conv_id is one conversation; null turns come first. Repeated rows are
turns of their own. Extra columns are ignored. An empty table has no examples.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of

START, END = "<|im_start|>", "<|im_end|>"
_BYTES = 4 << 20


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*+)\|", r"<\\$1|")


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def _escaped_role(role: Column) -> Column:
    return escaped(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def _unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def _expand(batches: Iterator[pa.RecordBatch], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    size = 0

    def batch_of(rows):
        columns = list(zip(*rows, strict=True))
        types = [kind, pa.int64(), pa.string(), pa.int64(), pa.int64()]
        names = ["conv_id", "example", "text", "loss_start", "loss_end"]
        return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types, strict=True)], names=names)

    conv, prefix, example, ended = object(), "", 0, True

    def rest():
        return [] if ended else [(conv, example, prefix, None, None)]

    for batch in batches:
        for c, head, body, reply in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "head", "body", "reply")), strict=True):
            if c != conv:
                out += rest()
                conv, prefix, example = c, "", 0
            begin = len(prefix) + len(head)
            prefix += head + body + END + "\n"
            ended = reply
            if reply:
                out.append((conv, example, prefix, begin, begin + len(body)))
                example += 1
                size += len(prefix)
            if size > _BYTES:
                yield batch_of(out)
                out, size = [], 0
    out += rest()
    if out:
        yield batch_of(out)


def examples(turns: DataFrame) -> DataFrame:
    """conv_id, example (its number), text, loss_start and loss_end (code points of the reply, null without one)."""
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    rows = turns.select(
        "conv_id", "turn", role.alias("role"), F.concat(F.lit(START), _escaped_role(role), F.lit("\n")).alias("head"),
        text_of().alias("text"), (role == "assistant").alias("reply"),
    )
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select(
        "conv_id", "head", escaped(F.col("text")).alias("body"), "reply"
    )
    from pyspark.sql.pandas.types import to_arrow_type

    kind, name = to_arrow_type(turns.schema["conv_id"].dataType), turns.schema["conv_id"].dataType.simpleString()
    return dealt.mapInArrow(lambda b: _expand(b, kind), f"conv_id {name}, example long, text string, loss_start long, loss_end long")


def turns_of(text: str) -> Iterator[tuple[str, str]]:
    """Role and text of every turn of an example."""
    for piece in text.split(END + "\n")[:-1]:
        role, body = piece.removeprefix(START).split("\n", 1)
        yield _unescape_role(role), unescape(body)


def _digest(batches: Iterator[pa.RecordBatch], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    def closed(conv, last, loss, loss_chars, chars):
        n, turns = 0, hashlib.sha256()
        for role, text in turns_of(last):
            n += 1
            turns.update(f"{role}\n{text}\n".encode())
        return conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    conv, last, loss, loss_chars, chars = object(), None, None, 0, 0
    for batch in batches:
        out = []
        for c, text, begin, end in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "text", "loss_start", "loss_end")), strict=True):
            if c != conv:
                if last is not None:
                    out.append(closed(conv, last, loss, loss_chars, chars))
                conv, loss, loss_chars, chars = c, hashlib.sha256(), 0, 0
            last, chars = text, chars + len(text)
            if begin is not None:
                plain = unescape(text[begin:end])
                loss.update(plain.encode())
                loss_chars += len(plain)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
    if last is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x], type=t) for x, t in zip(closed(conv, last, loss, loss_chars, chars), types, strict=True)], names=names)


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation, read back from its examples: turns, their hash, the text under the mask and its hash, characters of all examples."""
    from pyspark.sql.pandas.types import to_arrow_type

    field = formatted.schema["conv_id"].dataType
    kind = to_arrow_type(field)
    rows = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "example").select("conv_id", "text", "loss_start", "loss_end")
    return rows.mapInArrow(
        lambda b: _digest(b, kind),
        f"conv_id {field.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long",
    )
