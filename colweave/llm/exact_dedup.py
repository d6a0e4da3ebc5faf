"""Exact deduplication against a history of digests held in minimal perfect hashes.

The history is a table of distinct SHA-256 digests, cut into shards by leading digest bits; a shard is one row holding a
minimal perfect hash (levels of bit maps: a key whose slot on a level is its own stays there, the rest go on; the slot
number is the rank of its bit) and, slot by slot, the full digest and the winner's locator. Arriving digests are grouped
first, so a text repeated in a third of all rows is one look-up; each shard's digests are looked up in its hash and the
slot's digest is compared byte by byte. Members join the slot's group, nonmembers group among themselves.

The winner of equal texts is the largest doc_id over history and arrivals. Null text counts as the empty text; a null
doc_id wins only if all are null. Of rows repeating both doc_id and text the first copy is kept. An empty history or an empty
table gives what remains.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of, written

_ODD = np.uint64(0x9E3779B97F4A7C15)
_SHARD_BITS = 24


class PerfectHash:
    """A minimal perfect hash over distinct digests given as (n, 32) bytes."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.ranks = []
        before = 0
        for bits in levels:
            ranks = before + np.cumsum(bits, dtype=np.int64) - bits
            before += int(bits.sum())
            self.ranks.append(ranks)
        self.size = before

    @staticmethod
    def _place(words: np.ndarray, level: int, size: int) -> np.ndarray:
        mixed = words[:, level % 4] + words[:, (level + 1) % 4] * (_ODD + np.uint64(2 * level))
        mixed ^= mixed >> np.uint64(29)
        return ((mixed * _ODD) >> np.uint64(11)) % np.uint64(size)

    @classmethod
    def build(cls, digests: np.ndarray, spread: float = 2.0) -> PerfectHash:
        words, levels = np.ascontiguousarray(digests).view("<u8").reshape(-1, 4), []
        while len(words):
            size = max(1, math.ceil(spread * len(words)))
            at = cls._place(words, len(levels), size)
            alone = np.bincount(at.astype(np.int64), minlength=size) == 1
            levels.append(alone)
            words = words[~alone[at]]
            if len(levels) > 200:
                raise ValueError("digests are not distinct")
        return cls(levels)

    def slots(self, digests: np.ndarray) -> np.ndarray:
        """The slot of each digest, -1 where no level claims it; a digest outside the set may get any slot."""
        words = np.ascontiguousarray(digests).view("<u8").reshape(-1, 4)
        out = np.full(len(words), -1, dtype=np.int64)
        left = np.arange(len(words))
        for level, (bits, ranks) in enumerate(zip(self.levels, self.ranks, strict=True)):
            if not len(left):
                break
            at = self._place(words[left], level, len(bits))
            hit = bits[at]
            out[left[hit]] = ranks[at[hit]]
            left = left[~hit]
        return out

    def to_bytes(self) -> bytes:
        sizes = np.array([len(self.levels), *map(len, self.levels)], dtype="<u4").tobytes()
        return sizes + b"".join(np.packbits(x).tobytes() for x in self.levels)

    @classmethod
    def from_bytes(cls, data: bytes) -> PerfectHash:
        n = int(np.frombuffer(data, "<u4", 1)[0])
        sizes, at, levels = np.frombuffer(data, "<u4", n, 4), 4 * (n + 1), []
        for size in sizes.tolist():
            length = -(-size // 8)
            levels.append(np.unpackbits(np.frombuffer(data, np.uint8, length, at))[:size].astype(bool))
            at += length
        return cls(levels)


def _bytes(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(map(bytes, column)), dtype=np.uint8).reshape(-1, 32)


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    digests = _bytes(pdf["digest"])
    mph = PerfectHash.build(digests)
    slot = mph.slots(digests)
    order = np.argsort(slot)
    return pd.DataFrame({
        "shard": [pdf["shard"].iloc[0]], "mph": [mph.to_bytes()], "digests": [digests[order].tobytes()],
        "winners": [[None if pd.isna(x) else int(x) for x in pdf["winner"].iloc[order]]], "sizes": [pdf["n"].iloc[order].tolist()],
    })


def digest_rows(docs: DataFrame) -> DataFrame:
    """doc_id and the SHA-256 of the text's UTF-8 bytes as 32 bytes."""
    return docs.select("doc_id", F.unhex(F.sha2(text_of().cast("binary"), 256)).alias("digest"))


def _grouped(rows: DataFrame) -> DataFrame:
    return rows.groupBy("digest").agg(F.max("doc_id").alias("winner"), F.count("*").alias("n"))


def _shard(bits: int):
    lead = F.conv(F.hex(F.substring("digest", 1, _SHARD_BITS // 8)), 16, 10).cast("int")
    return F.shiftright(lead, _SHARD_BITS - bits).alias("shard")


def build_history(rows: DataFrame, shard_digests: int = 2048) -> tuple[DataFrame, int]:
    """The history's shards from ``digest_rows`` rows, written to the shared folder, and the number of shard bits.

    A shard holds about ``shard_digests`` digests whatever the size of the history, up to 2^24 shards; ``merge`` cuts them
    finer where more arrive.
    """
    distinct = written(_grouped(rows), "history-digests")
    bits = _bits(distinct.count(), shard_digests)
    return _shards(distinct, bits), bits


def _bits(count: int, shard_digests: int) -> int:
    return min(_SHARD_BITS, max(0, math.ceil(math.log2(max(1, count / shard_digests)))))


def _shards(distinct: DataFrame, bits: int) -> DataFrame:
    shards = distinct.select(_shard(bits), "digest", F.col("winner").cast("long").alias("winner"), "n").groupBy("shard").applyInPandas(
        _build, "shard int, mph binary, digests binary, winners array<long>, sizes array<long>"
    )
    return written(shards, "history")


def _held(shards: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The groups that shards hold."""
    for pdf in shards:
        for digests, winners, sizes in zip(pdf["digests"], pdf["winners"], pdf["sizes"], strict=True):
            held = np.frombuffer(digests, dtype=np.uint8).reshape(-1, 32)
            known = pd.array([None if pd.isna(x) else int(x) for x in winners], dtype="Int64")
            yield pd.DataFrame({"digest": [x.tobytes() for x in held], "winner": known, "n": np.array(sizes, dtype=np.int64)})


def _lookup(history: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
    """The merged groups of one shard: all slots, grown by the members among the arrivals, then the nonmembers."""
    n = len(asked)
    new = _bytes(asked["digest"]) if n else np.zeros((0, 32), dtype=np.uint8)
    winners = [None if pd.isna(x) else int(x) for x in asked["winner"]]
    sizes = asked["n"].to_numpy(dtype=np.int64) if n else np.zeros(0, dtype=np.int64)
    if not len(history):
        return pd.DataFrame({"digest": [x.tobytes() for x in new], "winner": pd.array(winners, dtype="Int64"), "n": sizes})
    row = history.iloc[0]
    held = np.frombuffer(row["digests"], dtype=np.uint8).reshape(-1, 32)
    old_winners, old_sizes = [None if pd.isna(x) else int(x) for x in row["winners"]], np.array(row["sizes"], dtype=np.int64)
    slot = PerfectHash.from_bytes(row["mph"]).slots(new)
    member = (slot >= 0) & (held[np.maximum(slot, 0)] == new).all(axis=1)
    for i in np.flatnonzero(member):
        at = slot[i]
        known = [x for x in (old_winners[at], winners[i]) if x is not None]
        old_winners[at] = max(known) if known else None
        old_sizes[at] += sizes[i]
    rest = np.flatnonzero(~member)
    return pd.DataFrame({
        "digest": [x.tobytes() for x in held] + [new[i].tobytes() for i in rest],
        "winner": pd.array(old_winners + [winners[i] for i in rest], dtype="Int64"),
        "n": np.concatenate([old_sizes, sizes[rest]]),
    })


def merge(history: DataFrame, bits: int, arriving: DataFrame, shard_digests: int = 2048) -> DataFrame:
    """digest, winner and n (rows) of every group over the history and the ``digest_rows`` rows that arrive.

    Where far more digests arrive than the history holds, its shards are first cut finer, so that a shard meets at most
    about four times ``shard_digests`` of them: a small or empty history does not bring them all to one task.
    """
    groups = written(_grouped(arriving), "arriving-digests")
    needed = _bits(groups.count(), shard_digests)
    if needed > bits + 2:
        history, bits = _shards(history.mapInPandas(_held, "digest binary, winner long, n long"), needed), needed
    asked = groups.select(_shard(bits), "digest", F.col("winner").cast("long").alias("winner"), "n")
    return history.groupBy("shard").cogroup(asked.groupBy("shard")).applyInPandas(_lookup, "digest binary, winner long, n long")


def exact_duplicates(docs: DataFrame, is_history) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, digest. ``is_history`` tells which rows came before."""
    rows = written(digest_rows(docs).withColumn("old", F.coalesce(is_history, F.lit(True))), "digests")
    history, bits = build_history(rows.where("old").drop("old"))
    groups = merge(history, bits, rows.where("not old").drop("old"))
    copies = rows.groupBy("doc_id", "digest").agg(F.count("*").cast("int").alias("copies"))
    each = copies.join(groups, "digest").withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
    return each.select(
        "doc_id", F.col("winner").alias("keep_id"), F.col("n").alias("group_size"),
        (F.col("doc_id").eqNullSafe(F.col("winner")) & (F.col("copy") == 1)).alias("kept"), "digest",
    )
