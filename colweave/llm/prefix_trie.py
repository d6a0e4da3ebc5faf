"""The trie of all conversations' turn prefixes, built by Z-fast tries over batches.

A turn is a digest of role and text; a prefix is named by 120 bits made from the sum of the digests of (depth, turn), so names of all
prefixes are prefix sums. Conversations are cut into stretches of ``STRETCH`` turns, whose trie hangs on the name of
the prefix before them; a conversation of any length is thus many bounded groups of rows. Stretches are dealt by ranges of (first
name, conversation), so those that share a beginning meet while a beginning shared by very many is spread over
tasks. A task inserts its stretches in batches into a Z-fast trie: compacted nodes are hashed under the name of the prefix at
the two-fattest depth of their edge, and a stretch's exit node is found by fat binary search over its own names. Weights of
stretches are summed bottom-up, edges are expanded into their prefixes, and batches are added up by name.

A first pass counts members and finds each prefix's smallest one, its owner. What a conversation owns is the end of its
path, so a second pass inserts only the owners, cut where their own part begins, to bring leaves and bytes of subtrees to the
prefixes above.

Turns are ordered by turn (null first), role and text; null role or text is empty. Rows without a conversation id
belong to none and are left out; ids are integers. Repeated rows are turns of their own, equal conversations members of the
same prefixes. An empty table has no node. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import text_of, written

STRETCH = 1024
_BATCH = 1 << 16
_LANES = ("l1", "l2", "l3", "l4")


# -- turns in their places

def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the rows of each conversation within the task, from 0."""
    part, before, n = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        ids = batch.column("conv_id").to_numpy()
        if not len(ids):
            continue
        row = np.arange(len(ids))
        new = np.concatenate([[True], ids[1:] != ids[:-1]])
        at = row - np.maximum.accumulate(np.where(new, row, 0))
        if before is not None and ids[0] == before:  # goes on from the batch before
            at[:np.append(np.flatnonzero(new)[1:], len(ids))[0]] += n
        before, n = ids[-1], int(at[-1]) + 1
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("conv_id", "digest", "n_bytes")), pa.array(np.full(len(ids), part, np.int32)), pa.array(at.astype(np.int64))],
            names=["conv_id", "digest", "n_bytes", "part", "at"],
        )


def placed_turns(turns: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), own (turns in all), digest and n_bytes of every turn, whatever part of all rows a conversation has."""
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text_of().alias("text"))
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text"]
    digest = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"))
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", digest.alias("digest"), F.octet_length("text").cast("long").alias("n_bytes"))
    numbered = written(ranged.mapInArrow(_number, "conv_id long, digest string, n_bytes long, part int, at long"), "turns")
    parts = numbered.groupBy("conv_id", "part").agg((F.max("at") + 1).alias("n"))
    conv = W.partitionBy("conv_id")  # a row per task that holds turns of the conversation
    offsets = parts.select(
        "conv_id", "part", F.sum("n").over(conv).alias("own"),
        F.coalesce(F.sum("n").over(conv.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"),
    )
    return numbered.join(offsets, ["conv_id", "part"]).select("conv_id", (F.col("before") + F.col("at") + 1).alias("pos"), "own", "digest", "n_bytes")


def rebuilt(turns: DataFrame, family: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv_id, n) and their turns (conv_id, depth, digest, n_bytes) after the shared beginnings are put in.

    Conversation c begins with the first h turns of conversation c - c % ``family`` (fewer if that has fewer) and goes on with its own behind
    its first h; h is crc32 of the decimal id % ``most``.
    """
    placed = written(placed_turns(turns), "placed")
    h = lambda c: F.crc32(F.col(c).cast("string").cast("binary")) % most
    convs = placed.where("pos = 1").select("conv_id", "own", h("conv_id").alias("h"), (F.col("conv_id") - F.col("conv_id") % family).alias("base"))
    bases = convs.select(F.col("conv_id").alias("base"), F.col("own").alias("of_base"))
    convs = convs.join(bases, "base", "left").select("conv_id", "own", "h", "base", F.least("h", F.coalesce("of_base", F.lit(0))).alias("shared"))
    convs = written(convs.withColumn("n", F.col("shared") + F.greatest(F.col("own") - F.col("h"), F.lit(0))), "conversations")
    beginnings = placed.where((F.col("pos") < most) & (F.col("conv_id") % family == 0)).select(F.col("conv_id").alias("base"), "pos", "digest", "n_bytes")
    first = convs.where("shared > 0").join(beginnings, "base").where("pos <= shared").select("conv_id", F.col("pos").alias("depth"), "digest", "n_bytes")
    # the shared length by stretch of positions, so that a long conversation's turns are not one key
    stretches = convs.where("own > h").select("conv_id", "h", "shared", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(own - 1) div {STRETCH}"))).alias("s"))
    rest = placed.withColumn("s", F.expr(f"(pos - 1) div {STRETCH}")).join(stretches, ["conv_id", "s"]).where("pos > h")
    rest = rest.select("conv_id", (F.col("shared") + F.col("pos") - F.col("h")).alias("depth"), "digest", "n_bytes")
    return convs.select("conv_id", "n"), first.unionByName(rest)


# -- names of prefixes

def _name(lanes: list[Column], depth: Column) -> list[Column]:
    text = F.md5(F.concat_ws(",", *[x.cast("string") for x in lanes], depth.cast("string")).cast("binary"))
    return [F.conv(F.substring(text, at, 15), 16, 10).cast("long") for at in (1, 17)]


def paths(sequences: DataFrame) -> DataFrame:
    """A row per conversation and depth: the prefix's name (k1, k2), its parent's (p1, p2), that of the stretch's first (f1, f2), the
    last turn's bytes and those of the whole prefix (upto), the stretch s, and the conversation's bytes in all (total).
    """
    mixed = F.md5(F.concat(F.col("depth").cast("string"), F.lit(":"), "digest").cast("binary"))
    lanes = [F.conv(F.substring(mixed, 1 + 8 * i, 8), 16, 10).cast("long").alias(n) for i, n in enumerate(_LANES)]
    rows = sequences.select("conv_id", "depth", F.expr(f"(depth - 1) div {STRETCH}").alias("s"), "n_bytes", *lanes)
    summed = [*_LANES, "n_bytes"]
    blocks = rows.groupBy("conv_id", "s").agg(*[F.sum(c).alias(c) for c in summed])
    conv = W.partitionBy("conv_id")  # a row per stretch
    before = conv.orderBy("s").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.select(
        "conv_id", "s", F.sum("n_bytes").over(conv).alias("total"), *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"b_{c}") for c in summed]
    )
    upto = W.partitionBy("conv_id", "s").orderBy("depth").rowsBetween(W.unboundedPreceding, 0)
    run = rows.join(blocks, ["conv_id", "s"]).select(
        "conv_id", "s", "depth", "n_bytes", "total", (F.sum("n_bytes").over(upto) + F.col("b_n_bytes")).alias("upto"),
        *[(F.sum(c).over(upto) + F.col(f"b_{c}")).alias(f"t_{c}") for c in _LANES], *_LANES,
    )
    own, parent = _name([F.col(f"t_{c}") for c in _LANES], F.col("depth")), _name([F.col(f"t_{c}") - F.col(c) for c in _LANES], F.col("depth") - 1)
    named = run.select(
        "conv_id", "s", "depth", own[0].alias("k1"), own[1].alias("k2"), parent[0].alias("p1"), parent[1].alias("p2"), "n_bytes", "upto", "total"
    )
    return named.withColumns({f"f{i}": F.first(f"k{i}").over(upto) for i in (1, 2)})


# -- Z-fast trie of a batch

def two_fattest(low: int, high: int) -> int:
    """The number in (low, high] divisible by the largest power of two."""
    return high & (-1 << ((low ^ high).bit_length() - 1))


class Node:
    """A compacted node: its edge covers the depths (above, extent] of the path ``names``; ``rows`` describe that path."""

    __slots__ = ("above", "children", "extent", "low", "names", "parent", "rows", "sums")

    def __init__(self, parent, above: int, extent: int, names: list[int], rows: list[tuple]):
        self.parent, self.above, self.extent, self.names, self.rows = parent, above, extent, names, rows
        self.children: dict[int, Node] = {}
        self.sums, self.low = [0, 0], None

    def handle(self) -> int:
        return self.names[two_fattest(self.above, self.extent) - 1]


class ZFastTrie:
    def __init__(self):
        self.root = Node(None, -1, 0, [], [])
        self.nodes: list[Node] = []
        self.handles: dict[int, Node] = {}

    @staticmethod
    def _common(names: list[int], node: Node, known: int, most: int) -> int:
        """How far the path follows the node's, given that it does to ``known``."""
        while known < most:
            middle = (known + most + 1) // 2
            if names[middle - 1] == node.names[middle - 1]:
                known = middle
            else:
                most = middle - 1
        return known

    def locate(self, names: list[int]) -> tuple[Node, int]:
        """The exit node of a path and the depth to which the path is in the trie, by fat binary search over the handles."""
        at, low, high = self.root, 0, len(names)
        while low < high:
            depth = two_fattest(low, high)
            node = self.handles.get(names[depth - 1])
            if node is None:
                high = depth - 1
            elif node.extent <= len(names) and names[node.extent - 1] == node.names[node.extent - 1]:
                at, low = node, node.extent
            else:
                return node, self._common(names, node, depth, min(len(names), node.extent))
        child = at.children.get(names[low]) if low < len(names) else None
        return (at, low) if child is None else (child, self._common(names, child, low + 1, min(len(names), child.extent)))

    def _add(self, node: Node) -> Node:
        self.nodes.append(node)
        node.parent.children[node.names[node.above]] = node
        self.handles[node.handle()] = node
        return node

    def insert(self, names: list[int], rows: list[tuple], weights: tuple[int, int], low: int) -> None:
        node, depth = self.locate(names)
        if depth < node.extent:  # the edge is cut
            del self.handles[node.handle()]
            top = self._add(Node(node.parent, node.above, depth, node.names, node.rows))
            node.parent, node.above = top, depth
            top.children[node.names[depth]] = node
            self.handles[node.handle()] = node
            node = top
        if depth < len(names):
            node = self._add(Node(node, depth, len(names), names, rows))
        node.sums[0] += weights[0]
        node.sums[1] += weights[1]
        node.low = low if node.low is None else min(low, node.low)

    def expanded(self) -> Iterator[tuple]:
        """Every prefix on the edges: its path's row and the sums and least of the paths through it."""
        for node in sorted(self.nodes, key=lambda x: -x.extent):
            over = node.parent
            over.sums[0] += node.sums[0]
            over.sums[1] += node.sums[1]
            over.low = node.low if over.low is None else min(over.low, node.low)
            for row in node.rows[node.above:node.extent]:
                yield (*row, *node.sums, node.low)


_PATH = ["k1", "k2", "p1", "p2", "depth", "n_bytes", "upto"]
_OUT = [*_PATH, "w1", "w2", "low"]


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    trie, held, key, names, rows, weights = ZFastTrie(), 0, None, [], [], (0, 0)

    def emitted():
        columns = list(zip(*trie.expanded(), strict=True)) or [[]] * len(_OUT)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=_OUT)

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "s", "w1", "w2", *_PATH)]
        for conv, s, w1, w2, *row in zip(*columns, strict=True):
            if (conv, s) != key:
                if names:
                    trie.insert(names, rows, weights, key[0])
                    held += len(names)
                    if held >= _BATCH:
                        yield emitted()
                        trie, held = ZFastTrie(), 0
                key, names, rows, weights = (conv, s), [], [], (w1, w2)
            names.append(row[0] << 60 | row[1])
            rows.append(tuple(row))
    if names:
        trie.insert(names, rows, weights, key[0])
    if trie.nodes:
        yield emitted()


def fold(rows: DataFrame) -> DataFrame:
    """Per prefix the sums of w1 and w2 and the least conversation over all ``paths`` rows through it, which carry w1 and w2."""
    dealt = rows.select("f1", "f2", "conv_id", "s", "w1", "w2", *_PATH).repartitionByRange("f1", "f2", "conv_id", "s")
    dealt = dealt.sortWithinPartitions("f1", "f2", "conv_id", "s", "depth")
    found = dealt.mapInArrow(_fold, ", ".join(f"{c} long" for c in _OUT))
    return found.groupBy("k1", "k2").agg(*[F.min(c).alias(c) for c in _PATH[2:]], F.sum("w1").alias("w1"), F.sum("w2").alias("w2"), F.min("low").alias("low"))


# -- members that end at a prefix

def _chunks(batches: Iterator[pa.RecordBatch], most: int = 4096) -> Iterator[pa.RecordBatch]:
    """Decimal ids of each prefix in pieces, in order; a piece starts with the first of its ids."""
    key, ids = None, []
    for batch in batches:
        out = []
        for k1, k2, conv in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "conv_id")), strict=True):
            if (k1, k2) != key or len(ids) >= most:
                if ids:
                    out.append((*key, ids[0], ",".join(map(str, ids))))
                key, ids = (k1, k2), []
            ids.append(conv)
        if out:
            yield _chunk_batch(out)
    if ids:
        yield _chunk_batch([(*key, ids[0], ",".join(map(str, ids)))])


def _chunk_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["k1", "k2", "first", "ids"])


def _hash_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, running, done = None, None, []
    for batch in batches:
        for k1, k2, ids in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "ids")), strict=True):
            if (k1, k2) != key:
                if key is not None:
                    done.append((*key, running.hexdigest()))
                key, running = (k1, k2), hashlib.sha256(ids.encode())
            else:
                running.update(b"," + ids.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=["k1", "k2", "ends_sha256"])
            done = []
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, running.hexdigest())], names=["k1", "k2", "ends_sha256"])


def ends_digest(ends: DataFrame) -> DataFrame:
    """Per prefix (k1, k2) the SHA-256 of its conversations' ids, ascending, with commas; many ids travel as few pieces."""
    ranged = ends.repartitionByRange("k1", "k2", "conv_id").sortWithinPartitions("k1", "k2", "conv_id")
    pieces = ranged.mapInArrow(_chunks, "k1 long, k2 long, first long, ids string")
    return pieces.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "first").select("k1", "k2", "ids").mapInArrow(
        _hash_chunks, "k1 long, k2 long, ends_sha256 string"
    )


# -- the whole trie

def prefix_trie(turns: DataFrame, hot_children: int = 1000) -> DataFrame:
    """A row per prefix: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Parents of more than ``hot_children`` prefixes (more than a 2000th of all owners where that is larger, so at most
    2000 parents) are looked up apart from the others.
    """
    spark = turns.sparkSession
    convs, sequences = rebuilt(turns)
    path = written(paths(sequences), "paths")
    root = [F.lit(x) for x in _root_name(spark)]
    nodes = written(fold(path.withColumns({"w1": F.lit(1), "w2": F.col("total")})), "prefixes")

    whole = convs.agg(F.count("*").alias("n"), F.min("conv_id").alias("low")).first()
    bytes_all = path.where("depth = 1").agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0]
    children = nodes.groupBy("p1", "p2").agg(F.count("*").alias("n_children")).select(F.col("p1").alias("k1"), F.col("p2").alias("k2"), "n_children")
    nodes = written(nodes.join(children, ["k1", "k2"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "prefixes")
    owners = written(
        nodes.groupBy(F.col("low").alias("conv_id")).agg(
            (F.min("depth") - 1).alias("shared"), F.max("depth").alias("n"), F.sum("n_bytes").alias("owned"), F.max("upto").alias("end"),
            F.max(F.when(F.col("n_children") == 0, 1).otherwise(0)).alias("leaf"),
        ),
        "owners",
    )
    sums = owners.agg(F.sum("owned").alias("owned"), F.sum("leaf").alias("leaves"), F.count("*").alias("n")).first()

    def by_stretch(low: str, high: str) -> DataFrame:
        """The owners by stretch of depths, so that a long conversation's prefixes are not one key."""
        return owners.where(f"{high} >= {low}").withColumn("s", F.explode(F.expr(f"sequence(({low} - 1) div {STRETCH}, ({high} - 1) div {STRETCH})")))

    above = path.join(by_stretch("1L", "shared").select("conv_id", "s", "shared", "leaf", "owned"), ["conv_id", "s"]).where("depth <= shared")
    hanging = fold(above.withColumns({"w1": F.col("leaf").cast("long"), "w2": F.col("owned")})).select(
        "k1", "k2", F.col("w1").alias("leaves_below"), F.col("w2").alias("bytes_below")
    )
    last = path.groupBy("conv_id").agg(F.max_by(F.struct("k1", "k2"), "depth").alias("k"))
    ends = convs.join(last, "conv_id", "left").select(F.coalesce("k.k1", root[0]).alias("k1"), F.coalesce("k.k2", root[1]).alias("k2"), "conv_id")

    own = by_stretch("shared + 1", "n").select(F.col("conv_id").alias("low"), "s", "shared", "end", "leaf")
    each = nodes.withColumn("s", F.expr(f"(depth - 1) div {STRETCH}")).join(own, ["low", "s"]).join(hanging, ["k1", "k2"], "left")
    before = F.col("upto") - F.col("n_bytes")
    each = each.select(
        "k1", "k2", "p1", "p2", F.col("low").alias("conv_id"), "depth", F.col("w1").alias("n_convs"), "n_children",
        (F.col("leaf") + F.coalesce("leaves_below", F.lit(0))).alias("n_leaves"),
        (F.col("w2") - F.col("w1") * before - (F.col("end") - before + F.coalesce("bytes_below", F.lit(0)))).alias("saved_tokens"),
        (F.col("depth") == F.col("shared") + 1).alias("attached"),
    )
    each = written(each, "prefixes")

    # an owner's first prefix hangs on another's
    inner, outer = each.where("not attached or depth = 1"), each.where("attached and depth > 1")
    names = nodes.where("n_children > 0").select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("low").alias("parent_conv_id"), "n_children")
    limit = max(hot_children, (sums["n"] or 0) // 2000)
    hot, cold = names.where(F.col("n_children") > limit).drop("n_children"), names.where(F.col("n_children") <= limit).drop("n_children")
    hung = outer.join(F.broadcast(hot), ["p1", "p2"]).unionByName(outer.join(F.broadcast(hot), ["p1", "p2"], "left_anti").join(cold, ["p1", "p2"]))
    inner = inner.withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.lit(whole["low"]).cast("long")).otherwise(F.col("conv_id")))
    top = spark.range(1 if whole["n"] else 0).select(
        root[0].alias("k1"), root[1].alias("k2"), F.lit(whole["low"]).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("depth"),
        F.lit(None).cast("long").alias("parent_conv_id"), F.lit(whole["n"]).alias("n_convs"),
        F.lit(nodes.where("depth = 1").count()).alias("n_children"), F.lit(max(1, sums["leaves"] or 0)).cast("long").alias("n_leaves"),
        F.lit(bytes_all - (sums["owned"] or 0)).cast("long").alias("saved_tokens"),
    )
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    every = hung.unionByName(inner).select("k1", "k2", *columns).unionByName(top)
    nobody = hashlib.sha256(b"").hexdigest()
    found = every.join(ends_digest(ends), ["k1", "k2"], "left")
    return found.select(*[F.col(c).cast("long").alias(c) for c in columns], F.coalesce("ends_sha256", F.lit(nobody)).alias("ends_sha256"))


def _root_name(spark) -> tuple[int, int]:
    text = hashlib.md5(b"0,0,0,0,0").hexdigest()
    return int(text[:15], 16), int(text[16:31], 16)
