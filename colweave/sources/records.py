"""CSV records of any size, cut out of files that are split over tasks.

A line break ends a record unless it stands inside quotes, which a task cannot tell from its block alone. What a block
does is therefore found for both cases, that it begins outside and inside quotes, from those of its lines that hold a quote. The blocks'
outcomes, a row each, are followed through every file in order, and then each block is cut into records from its true state.
A record over several blocks is put together from its pieces.

Quotes count as CSV readers take them: a field is quoted if it begins with a quote; a doubled quote inside is one character;
what follows a closing quote runs to the next separator; other quotes are plain characters. An open quote at the end of
a file ends there. Blank lines outside quotes are no records.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_QUOTE = 0x22


def ends_inside(line: bytes, inside: bool, sep: bytes) -> bool:
    """Whether a line that begins inside or outside quotes ends inside them."""
    at, n = 0, len(line)
    while True:
        if inside:
            at = line.find(b'"', at)
            while at >= 0 and at + 1 < n and line[at + 1] == _QUOTE:
                at = line.find(b'"', at + 2)
            if at < 0:
                return True
            inside = False
        elif at < n and line[at] == _QUOTE:
            inside, at = True, at + 1
            continue
        at = line.find(sep, at)
        if at < 0:
            return False
        at += len(sep)


class _Lines:
    """Lines of a batch that matter to the quote state: those with a quote, and those that begin outside quotes and end inside."""

    def __init__(self, values: pa.Array, sep: bytes):
        self.values, self.sep = values, sep
        self.quoted = np.flatnonzero(pc.match_substring(values, '"').to_numpy(zero_copy_only=False))
        held = values.take(pa.array(self.quoted))
        if len(sep) == 1:
            # A run of fields that all end on this line, as ``ends_inside`` takes them; one pass over the bytes in place of a call per line.
            cut = f"\\x{sep[0]:02x}"
            plain = f'[^"{cut}][^{cut}]*'
            field = f'"(?:[^"]|"")*"(?:{plain})?|{plain}|'
            closed = pc.match_substring_regex(held, f"\\A(?:{field})(?:{cut}(?:{field}))*\\z").to_numpy(zero_copy_only=False)
        else:
            closed = np.array([not ends_inside(line, False, sep) for line in held.to_pylist()], dtype=bool)
        self.opening = self.quoted[~closed.astype(bool)]

    def next_change(self, at: int, high: int, inside: bool) -> tuple[int, bool]:
        """The first line from ``at`` that changes the state, and whether there is one before ``high``."""
        if not inside:
            i = np.searchsorted(self.opening, at)
            return (int(self.opening[i]), True) if i < len(self.opening) and self.opening[i] < high else (high, False)
        for i in range(np.searchsorted(self.quoted, at), len(self.quoted)):
            line = int(self.quoted[i])
            if line >= high:
                break
            if not ends_inside(self.values[line].as_py(), True, self.sep):
                return line, True
        return high, False


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple, int, int]]:
    """The blocks in a batch of lines: their path and start, first and last row."""
    starts = batch.column("start").to_numpy()
    paths = batch.column("path").dictionary_encode().indices.to_numpy(zero_copy_only=False)
    cuts = np.flatnonzero((np.diff(starts) != 0) | (np.diff(paths) != 0)) + 1
    for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
        yield (batch.column("path")[low].as_py(), int(starts[low])), low, high


def _outcomes(batches: Iterator[pa.RecordBatch], sep: bytes) -> Iterator[pa.RecordBatch]:
    """Per block, from its lines with quotes: its end from either start, whether a start inside is ever left, and whether
    a record goes over lines or a line is odd, the block beginning outside."""
    names, key, ends, left, several, done = ["path", "start", "from_out", "from_in", "left", "several"], None, [False, True], False, False, []
    for batch in batches:
        if not batch.num_rows:
            continue
        lines = _Lines(batch.column("value").cast(pa.binary()), sep)
        for own, low, high in _runs(batch):
            if own != key:
                if key is not None:
                    done.append((*key, *ends, left, several))
                key, ends, left, several = own, [False, True], False, False
            several = several or bool(pc.any(batch.column("odd").slice(low, high - low)).as_py())
            for which in (0, 1):
                at, found = lines.next_change(low, high, ends[which])
                while found:
                    ends[which] = not ends[which]
                    left, several = left or (which == 1 and not ends[1]), several or (which == 0 and ends[0])
                    at, found = lines.next_change(at + 1, high, ends[which])
    if key is not None:
        done.append((*key, *ends, left, several))
    types = [pa.string(), pa.int64(), *[pa.bool_()] * 4]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True) if done else [[]] * 6, types, strict=True)], names=names)


def _follow(blocks: pd.DataFrame) -> pd.DataFrame:
    """Where a file is inside quotes at a block's edge: from the block ``start`` to that beginning at ``until``, in the record begun in ``since``.

    A row of -1 tells of a file where lines and records are not the same.
    """
    inside, since, out = False, 0, []
    ordered = list(blocks.sort_values("start").itertuples())
    for b, after in zip(ordered, [*ordered[1:], None], strict=True):
        ends = bool(b.from_in if inside else b.from_out)
        if ends:
            if not inside or b.left:
                since = b.start
            out.append((b.path, b.start, after.start if after is not None else 1 << 62, since))
        inside = ends
    if blocks["several"].any():
        out.append((ordered[0].path, -1, -1, -1))
    return pd.DataFrame(out, columns=["path", "start", "until", "since"])


def _begun(edges: dict, path: str, start: int) -> int | None:
    """The block where the record that is open at this block's start began, None if none is."""
    own = edges.get(path, ())
    at = bisect_left(own, (start,)) - 1
    return own[at][2] if at >= 0 and own[at][0] < start <= own[at][1] else None


def _cut(batches: Iterator[pa.RecordBatch], sep: bytes, held_edges, pieces: bool) -> Iterator[pa.RecordBatch]:
    """Records of all blocks; whole ones, or only the pieces of those that go over a block's edge."""
    edges = held_edges.value
    key, inside, since, edge, held, first = None, False, None, False, [], False
    texts: list = []
    rows: list[tuple] = []

    def piece():
        """What is open at the end of the block."""
        if held and pieces:
            rows.append((key[0], since, key[1], b"\n".join(held), first))

    def flushed():
        if pieces:
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.bool_()]
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["path", "since", "start", "record", "header"])
        else:
            out = pa.RecordBatch.from_arrays([pa.concat_arrays(texts)], names=["record"])
        texts.clear()
        rows.clear()
        return out

    def whole(lines: pa.Array):
        """Records of one line each, or one of several."""
        nonlocal first
        if pieces and not first:
            return
        filled = lines.filter(pc.greater(pc.binary_length(lines), 0))
        filled = filled.filter(pc.not_equal(filled, pa.scalar(b"\r", pa.binary())))
        if first and len(filled):
            filled, first = filled.slice(1), False
        if len(filled) and not pieces:
            texts.append(filled)

    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column("value").cast(pa.binary())
        lines = _Lines(values, sep)
        for own, low, high in _runs(batch):
            if own != key:
                piece()
                key, held, first = own, [], own[1] == 0
                since = _begun(edges, *own)
                inside = edge = since is not None
                since = since if inside else own[1]
            at = low
            while True:
                i, found = lines.next_change(at, high, inside)
                if i > at:
                    if inside:
                        held += values.slice(at, i - at).to_pylist()
                    else:
                        whole(values.slice(at, i - at))
                if not found:
                    break
                held.append(values[i].as_py())
                at, inside = i + 1, not inside
                if not inside:
                    if edge:  # the tail of a record from before
                        piece()
                        edge, since = False, key[1]
                    else:
                        whole(pa.array([b"\n".join(held)], pa.binary()))
                    held = []
        if texts or rows:
            yield flushed()
    piece()
    if pieces and rows:
        yield flushed()


def quoted_records(spark: SparkSession, paths: list[str], sep: str) -> DataFrame | None:
    """``record`` (bytes) of every record but the first of each file, its header. Lines end in a line feed.

    None where every line that is not empty is a record of its own which any reader of lines finds: no record goes over a line's end, and no
    line has a carriage return or blanks only.
    """
    text = spark.read.option("lineSep", "\n").text(paths)
    fields = [F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start")]
    lines = text.select(*fields)
    mark = sep.encode()
    odd = F.contains("value", F.lit("\r")) | ((F.ascii("value") <= 32) & F.col("value").rlike(r"^[\x00-\x20]+$"))
    found = text.select(*fields, odd.alias("odd")).where(F.contains("value", F.lit(b'"')) | F.col("odd")).mapInArrow(
        lambda b: _outcomes(b, mark), "path string, start long, from_out boolean, from_in boolean, left boolean, several boolean"
    )
    # a row per block that ends inside quotes, less than one for each block of the files, and one per file with other than plain lines
    edges: dict[str, list[tuple[int, int, int]]] = {}
    several = False
    for r in found.groupBy("path").applyInPandas(_follow, "path string, start long, until long, since long").orderBy("start").collect():
        several = True
        if r.start >= 0:
            edges.setdefault(r.path, []).append((r.start, r.until, r.since))
    if not several:
        return None
    held = spark.sparkContext.broadcast(edges)
    records = lines.mapInArrow(lambda b: _cut(b, mark, held, False), "record binary")
    if not edges:
        return records
    pieces = lines.mapInArrow(lambda b: _cut(b, mark, held, True), "path string, since long, start long, record binary, header boolean")
    latin = lambda p: F.decode(p["record"], "ISO-8859-1")
    joined = pieces.groupBy("path", "since").agg(
        F.bool_or("header").alias("header"), F.array_sort(F.collect_list(F.struct("start", "record"))).alias("parts")
    ).where("not header").select(F.encode(F.array_join(F.transform("parts", latin), "\n"), "ISO-8859-1").alias("record"))
    return records.unionByName(joined)
