"""Near duplicates by SimHash: a binary trie of the fingerprints joined with itself.

A fingerprint has 64 bits; bit b is set if more than half of the text's shingle hashes have it. Documents link when their
fingerprints differ in at most ``max_bits`` bits; components are taken over all links.

The self-join walks pairs of trie nodes together from the root. Each step goes to both children of both nodes and adds one
to the pair's differing bits where the branches differ; a pair beyond the budget is dropped with all below it. To spread the
walk, the bits are cut into ``max_bits + 1`` blocks: two fingerprints within the budget agree on a whole block, so there is
one trie per block, with that block's bits at the top, and below each top node a walk of its own that starts with no
differing bits. Top nodes holding more than ``node_size`` fingerprints are cut again in the same way by their remaining
bits, and so on, until few remain or the remaining bits bound their number; nothing is capped. Copies share a
fingerprint and are one leaf, so they never make pairs.

Null text is empty and has fingerprint zero, linked like any other. An empty table gives an empty result. Repeated rows are
returned as often as they come. A null ``doc_id`` joins components but never names one, unless all ids there are null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, raw_texts, text_of, trimmed, written
from .components import components

BITS = 64
SEED = 42
_CHUNK = 1 << 15


def fingerprint(text: bytes, shingle: int) -> int:
    """The fingerprint of a UTF-8 text: A-Z lower-cased, words between ASCII blanks, shingles with repeats."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    ones = np.zeros(BITS, dtype=np.int64)
    for low in range(0, n, _CHUNK):
        high = min(n, low + _CHUNK)
        part = words[low:high + shingle - 1]
        texts = map(b" ".join, zip(*(part[i:] for i in range(shingle)), strict=False)) if len(words) >= shingle else [b" ".join(words)]
        hashes = np.fromiter((xxh64_intdigest(t, SEED) for t in texts), dtype="<u8", count=high - low)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in by_bytes(batches):
        found = np.array([fingerprint(t, shingle) for t in raw_texts(batch.column("text"))], dtype=np.uint64)
        yield pa.RecordBatch.from_pydict({
            "doc_id": batch.column("doc_id"), "text_hash": batch.column("text_hash"), "fp": pa.array(found.view(np.int64)),
        })


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, text_hash and fp (the fingerprint as a signed long) per row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.xxhash64(text_of()).alias("text_hash"), text_of().alias("text"))
    return rows.mapInArrow(lambda batches: trimmed(_fingerprints(batches, shingle)), f"doc_id {kind}, text_hash long, fp long")


def walk(keys: np.ndarray, starts: np.ndarray, ends: np.ndarray, depth: int, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of ``keys`` within ``budget`` bits inside each of the given ranges.

    ``keys``: unsigned longs of ``depth`` meaningful low bits, ascending and distinct within each range. A trie node is a
    range of keys sharing a prefix. Pairs of nodes of all ranges go down together, one bit a step.
    """
    a_low = b_low = starts.astype(np.int64)
    a_high = b_high = ends.astype(np.int64)
    spent = np.zeros(len(a_low), dtype=np.int64)
    left, right = [], []
    for bit in range(depth - 1, -1, -1):
        same = a_low == b_low
        open_ = ~same | (a_high - a_low > 1)
        leaves = open_ & ~same & (a_high - a_low == 1) & (b_high - b_low == 1)
        if leaves.any():  # two single keys: the rest of their bits at once
            rest = np.bitwise_count((keys[a_low[leaves]] ^ keys[b_low[leaves]]) & np.uint64((1 << (bit + 1)) - 1))
            near = spent[leaves] + rest <= budget
            left.append(a_low[leaves][near])
            right.append(b_low[leaves][near])
        go = open_ & ~leaves
        if not go.any():
            return _joined(left), _joined(right)
        a_low, a_high, b_low, b_high, spent, same = (x[go] for x in (a_low, a_high, b_low, b_high, spent, same))
        ones = np.concatenate([[0], np.cumsum((keys >> np.uint64(bit)) & np.uint64(1))]).astype(np.int64)
        a_mid, b_mid = a_high - (ones[a_high] - ones[a_low]), b_high - (ones[b_high] - ones[b_low])
        more = spent < budget
        cross = more & ~same
        pairs = [
            (a_low, a_mid, b_low, b_mid, spent, np.ones(len(spent), dtype=bool)), (a_mid, a_high, b_mid, b_high, spent, np.ones(len(spent), dtype=bool)),
            (a_low, a_mid, b_mid, b_high, spent + 1, more), (a_mid, a_high, b_low, b_mid, spent + 1, cross),
        ]
        a_low, a_high, b_low, b_high, spent = (np.concatenate([p[i][p[5] & (p[0] < p[1]) & (p[2] < p[3])] for p in pairs]) for i in range(5))
    final = a_low != b_low  # below the last bit every node is one key
    return _joined([*left, a_low[final]]), _joined([*right, b_low[final]])


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)


def _walk_all(keys: np.ndarray, starts: np.ndarray, ends: np.ndarray, budget: int, most: int = 1 << 22) -> pa.RecordBatch:
    """``walk`` over all ranges, in portions whose pairs of keys, were none pruned, number about ``most``."""
    portion = np.cumsum((ends - starts) ** 2) // most
    left, right = [], []
    for cut in np.split(np.arange(len(starts)), np.flatnonzero(np.diff(portion)) + 1):
        low, high = starts[cut[0]], ends[cut[-1]]
        a, b = walk(keys[low:high], starts[cut] - low, ends[cut] - low, BITS, budget)
        left.append(a + low)
        right.append(b + low)
    a, b = keys[np.concatenate(left)], keys[np.concatenate(right)]
    return pa.RecordBatch.from_pydict({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})


def _links(batches: Iterator[pa.RecordBatch], budget: int, most: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """Links within each node. Rows come sorted by node; a node may run over several batches."""

    def solve(node, fp):
        order = np.lexsort((fp, node))
        node, fp = node[order], fp[order]
        starts = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
        ends = np.r_[starts[1:], len(node)]
        wide = ends - starts > 1
        if wide.any():  # all agree on the bits fixed so far, so the walk passes those at no cost
            yield _walk_all(fp, starts[wide], ends[wide], budget)

    node, fp = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        held.append((batch.column("node").to_numpy(), batch.column("fp").to_numpy().view(np.uint64)))
        if sum(len(x) for x, _ in held) < most:
            continue
        node, fp = (np.concatenate(x) for x in zip(*held, strict=True))
        cut = int(np.flatnonzero(node == node[-1])[0])
        yield from solve(node[:cut], fp[:cut]) if cut else ()
        held = [(node[cut:], fp[cut:])]
    if held:
        yield from solve(*(np.concatenate(x) for x in zip(*held, strict=True)))


def _mask(bits: list[int]) -> int:
    """The mask of some bits as a signed long."""
    value = sum(1 << b for b in bits)
    return value - (1 << 64) if value >> 63 else value


def links(distinct: DataFrame, max_bits: int = 2, node_size: int = 2048, least_bits: int = 11) -> DataFrame:
    """Pairs ``a``, ``b`` of distinct fingerprints (column ``fp``) within ``max_bits`` bits, each at least once."""
    out = None
    level = [(distinct.select("fp", F.lit(0).cast("long").alias("above")), ())]
    while level:
        deeper = []
        for rows, fixed in level:
            free = [b for b in range(BITS) if b not in fixed]
            parts = [p for p in ([free[i] for i in x] for x in np.array_split(np.arange(len(free)), max_bits + 1)) if p]
            tops = F.array(*[
                F.struct(F.lit(i).alias("block"), F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(_mask(p))), "above").alias("node"))
                for i, p in enumerate(parts)
            ])
            placed = rows.select("fp", F.explode(tops).alias("top")).select("fp", "top.block", "top.node")
            if len(free) - len(parts[0]) > least_bits:
                counted = placed.groupBy("block", "node").agg(F.count("*").alias("n")).where(F.col("n") > node_size)
                large = written(counted.select("block", "node"), "trie-nodes")
                if large.limit(1).count():
                    wide = written(placed.join(large, ["block", "node"], "left_semi"), "trie-wide")
                    deeper += [(wide.where(F.col("block") == i).select("fp", F.col("node").alias("above")), fixed + tuple(p)) for i, p in enumerate(parts)]
                    placed = placed.join(large, ["block", "node"], "left_anti")
            found = placed.select("node", "fp").repartition("node").sortWithinPartitions("node").mapInArrow(
                lambda batches: _links(batches, max_bits), "a long, b long"
            )
            out = found if out is None else out.unionByName(found)
        level = deeper
    return out


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_hash, fp, component_id (smallest doc_id reachable over links)."""
    rows = written(fingerprints(docs, shingle), "simhash")
    distinct = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    found = written(links(distinct, max_bits), "simhash-links")
    roots = components(found)
    named = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = named.join(least, "root").select("fp", "component_id")
    return rows.join(by_fp, "fp").select("doc_id", "text_hash", "fp", "component_id")


def keep_one(docs: DataFrame, shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """``docs`` with one row of each component: the smallest doc_id, of rows repeating it the smallest text hash."""
    found = near_duplicates(docs, shingle, max_bits)
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("w")
    winners = written(found.groupBy("component_id").agg(first).select(_key(F.col("w.doc_id"), F.col("w.text_hash"))), "simhash-winners")
    rows = docs.select(F.struct("*").alias("row"), _key(F.col("doc_id"), F.xxhash64(text_of())))
    return rows.join(winners, "key", "left_semi").dropDuplicates(["key"]).select("row.*")


def _key(doc_id: Column, text_hash: Column) -> Column:
    return F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("null")), text_hash).alias("key")
