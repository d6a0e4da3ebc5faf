"""Records of JSON files that are one array of objects, cut out by tasks that share a file.

Files are read in pieces that end with a closing brace, which needs no line breaks, so a file of one line is split as well. Whether a
byte of a block stands in a string, and at which depth, depends on what came before. Each block is therefore summed up for both cases, that
it begins outside and inside a string: how it ends, how far the depth moves and how low it gets. These sums, a row a block, are
followed through every file in order, and each block is then cut from its true state. A record over several blocks is put
together from its pieces.

Commas between records are not checked. An element that is no object, a line break or control character inside a string, and an array that
is not closed fail the job.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .records import _runs

_STEP = np.zeros(256, np.int8)
_STEP[[0x5B, 0x7B]], _STEP[[0x5D, 0x7D]] = 1, -1
_BETWEEN = np.zeros(256, bool)
_BETWEEN[list(b" \t\r\n,")] = True


def _read(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes, whether each is inside a string if the first is outside, and the step in depth of brackets."""
    raw = np.frombuffer(data, np.uint8)
    quote = raw == 0x22
    slash = raw == 0x5C
    if slash.any():  # a quote after an odd run of backslashes is part of the string
        at = np.arange(len(raw))
        last_other = np.maximum.accumulate(np.where(slash, -1, at))
        before = np.concatenate([[0], at[:-1] - last_other[:-1]])
        quote &= before % 2 == 0
    return raw, (np.cumsum(quote, dtype=np.int32) & 1).astype(bool), _STEP[raw]


def _pieces(batch: pa.RecordBatch) -> Iterator[tuple[tuple, bytes]]:
    """The bytes of each block in a batch, closing braces put back."""
    for own, low, high in _runs(batch):
        yield own, b"}".join(batch.column("value").slice(low, high - low).to_pylist()) + b"}"


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per block and start outside or inside a string: whether it ends inside, the depth's move and its lowest point."""
    done: dict[tuple, list[list]] = {}
    for batch in batches:
        if not batch.num_rows:
            continue
        for own, data in _pieces(batch):
            _, inside, step = _read(data)
            states = done.setdefault(own, [[False, 0, 0], [True, 0, 0]])
            for state in states:
                depth = np.cumsum(np.where(inside ^ state[0], 0, step), dtype=np.int64) + state[1]
                state[:] = [bool(inside[-1]) ^ state[0], int(depth[-1]), min(state[2], int(depth.min()))]
    rows = [(*key, *out, *within) for key, (out, within) in done.items()]
    kinds = [pa.string(), pa.int64()] + [pa.bool_(), pa.int64(), pa.int64()] * 2
    columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
    names = ["path", "start", "in_out", "move_out", "low_out", "in_in", "move_in", "low_in"]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)


def _follow(blocks: pd.DataFrame) -> pd.DataFrame:
    """The blocks of a file that begin inside a record: string state and depth there, and the block ``since`` where the record began."""
    inside, depth, since, out = False, 0, 0, []
    for b in blocks.sort_values("start").itertuples():
        if inside or depth > 1:
            out.append((b.path, b.start, inside, depth, since))
        move, low, ends = (b.move_in, b.low_in, b.in_in) if inside else (b.move_out, b.low_out, b.in_out)
        if depth + low <= 1:
            since = b.start
        inside, depth = bool(ends), depth + int(move)
    if inside or depth != -1:  # the last piece has a brace that the file has not
        raise ValueError(f"JSON array that is not closed: {blocks['path'].iloc[0]}")
    return pd.DataFrame(out, columns=["path", "start", "inside", "depth", "since"])


def _cut(batches: Iterator[pa.RecordBatch], held_edges, over_edges: bool) -> Iterator[pa.RecordBatch]:
    """Records within a block, or only the pieces of those that go over a block's edge."""
    edges = held_edges.value
    key, inside, depth, since, edge, held = None, False, 0, 0, False, []
    rows: list = []

    def piece():
        if held and over_edges:
            rows.append((key[0], since, key[1], b"".join(held)))

    def flushed():
        if over_edges:
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.binary()]
            out = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
            names = ["path", "since", "start", "record"]
        else:
            out, names = [pa.array(rows, pa.binary())], ["record"]
        rows.clear()
        return pa.RecordBatch.from_arrays(out, names=names)

    for batch in batches:
        if not batch.num_rows:
            continue
        for own, data in _pieces(batch):
            if own != key:
                piece()
                key, held = own, []
                known = edges.get(own[0], ())
                at = bisect_left(known, (own[1],))
                edge = at < len(known) and known[at][0] == own[1]
                inside, depth, since = known[at][1:] if edge else (False, int(own[1] > 0), own[1])
            raw, within, step = _read(data)
            within = within ^ inside
            step = np.where(within, 0, step)
            at_depth = np.cumsum(step, dtype=np.int64) + depth
            if (within & (raw < 0x20)).any():
                raise ValueError(f"control character inside a string of {own[0]}")
            if ((at_depth == 1) & (step == 0) & ~within & ~_BETWEEN[raw]).any():
                raise ValueError(f"array with elements that are not objects: {own[0]}")
            opened = np.flatnonzero((step == 1) & (at_depth == 2))
            if (raw[opened] != 0x7B).any():
                raise ValueError(f"array with elements that are not objects: {own[0]}")
            closed = np.flatnonzero((step == -1) & (at_depth == 1)) + 1
            began_before = depth > 1
            if began_before:
                held.append(data[: closed[0]] if len(closed) else data)
                if len(closed):
                    if edge:
                        piece()
                    elif not over_edges:
                        rows.append(b"".join(held))
                    held, edge, since = [], False, own[1]
            ends = closed[1:] if began_before else closed
            if not over_edges:
                rows += [data[a:b] for a, b in zip(opened.tolist(), ends.tolist())]
            if len(opened) > len(ends):
                held.append(data[opened[-1] :])
            inside, depth = bool(within[-1]), int(at_depth[-1])
        if rows:
            yield flushed()
    piece()
    if over_edges and rows:
        yield flushed()


def array_records(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``line``: the text of every object in files that are one array of objects each, line breaks as blanks."""
    pieces = spark.read.option("lineSep", "}").text(paths).select(
        F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start")
    )
    sums = pieces.mapInArrow(
        _sums, "path string, start long, in_out boolean, move_out long, low_out long, in_in boolean, move_in long, low_in long"
    )
    # a row per block that begins inside a record: at most one for each block of the files
    edges: dict[str, list[tuple]] = {}
    found = sums.groupBy("path").applyInPandas(_follow, "path string, start long, inside boolean, depth long, since long")
    for r in found.orderBy("start").collect():
        edges.setdefault(r.path, []).append((r.start, r.inside, r.depth, r.since))
    held = spark.sparkContext.broadcast(edges)
    records = pieces.mapInArrow(lambda b: _cut(b, held, False), "record binary")
    if edges:
        parts = pieces.mapInArrow(lambda b: _cut(b, held, True), "path string, since long, start long, record binary")
        hexed = F.array_sort(F.collect_list(F.struct("start", F.hex("record").alias("h"))))
        joined = parts.groupBy("path", "since").agg(hexed.alias("parts"))
        whole = F.unhex(F.array_join(F.transform("parts", lambda p: p["h"]), ""))
        records = records.unionByName(joined.select(whole.alias("record")))
    return records.select(F.translate(F.col("record").cast("string"), "\r\n", "  ").alias("line"))
