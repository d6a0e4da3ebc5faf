"""Benchmark decontamination with a generalised suffix automaton over the words of all items.

Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased. The automaton is built from the items and the
words of a document are streamed through it, which keeps the length of the longest suffix read so far that occurs in some
item. Once that length reaches the window (10 words), or the whole of an item shorter than that, the words of the occurrence
are hit, and the state tells which items hold the window.

Items are taken in blocks of about ``block_words`` words, which bounds an automaton; a benchmark beyond one block is run
block by block over all documents and the hits are joined, so a benchmark of any size gives the same result.

Null text has no words. Items of null id hit like others and are left out of the items named. Items without words never match; repeated items count once; items with equal text are all reported.
Repeated documents are returned as often as they come. Without items nothing is hit.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_bytes, raw_texts, text_of, trimmed, written

WINDOW = 10
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_RAW_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")  # the same words before lower-casing
#: A-Z to lower case, all other bytes outside words to blanks.
_FLAT = bytes(c + 32 if 65 <= c <= 90 else c if _WORD.match(bytes([c])) else 32 for c in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(_FLAT).split()


class Automaton:
    """A generalised suffix automaton over word sequences; state 0 is the root."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        sequences: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            ids = tuple(self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text))
            if ids:
                sequences.setdefault(ids, set()).add(item)
        for ids in sequences:
            last = 0
            for w in ids:
                last = self._extend(last, w)
        self._mark(sequences)

    def _state(self, following: dict[int, int], link: int, length: int) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, above: int, w: int, below: int) -> int:
        """A copy of ``below`` that ends the shorter strings reached from ``above``."""
        copy = self._state(dict(self.next[below]), self.link[below], self.length[above] + 1)
        self.link[below] = copy
        while above >= 0 and self.next[above].get(w) == below:
            self.next[above][w] = copy
            above = self.link[above]
        return copy

    def _extend(self, last: int, w: int) -> int:
        there = self.next[last].get(w)
        if there is not None:
            return there if self.length[there] == self.length[last] + 1 else self._split(last, w, there)
        new, above = self._state({}, 0, self.length[last] + 1), last
        while above >= 0 and w not in self.next[above]:
            self.next[above][w] = new
            above = self.link[above]
        if above >= 0:
            there = self.next[above][w]
            self.link[new] = there if self.length[there] == self.length[above] + 1 else self._split(above, w, there)
        return new

    def _mark(self, sequences: dict[tuple[int, ...], set[str]]) -> None:
        """Which states end a whole short item, which hold a window and of what items, and from what length on each matters."""
        self.short: dict[int, tuple[int, set[str]]] = {}
        self.holders: dict[int, set[str]] = {}
        for ids, names in sequences.items():
            for i, state, length in self._run(ids):
                if len(ids) < self.window:
                    if i == len(ids) - 1:
                        self.short[state] = (len(ids), names)
                elif length >= self.window:
                    self.holders.setdefault(self._window_state(state), set()).update(names)
        self.least = [1 << 60] * len(self.next)
        for state in sorted(range(len(self.next)), key=self.length.__getitem__):
            own = self.short[state][0] if state in self.short else 1 << 60
            above = self.least[self.link[state]] if state else 1 << 60
            held = self.window if self.length[state] >= self.window and self._window_state(state) in self.holders else 1 << 60
            self.least[state] = min(own, above, held)
        self.seen: dict[tuple[int, int], tuple[int, frozenset[str]]] = {}

    def _window_state(self, state: int) -> int:
        while self.length[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def _run(self, ids) -> Iterator[tuple[int, int, int]]:
        """Position, state and matched length wherever a window or a whole short item may end."""
        following, link, lengths, least = self.next, self.link, self.length, getattr(self, "least", None)
        state = matched = 0
        for i, w in enumerate(ids):
            there = following[state].get(w)
            if there is not None:
                state, matched = there, matched + 1
            elif state:
                state = link[state]
                while state and w not in following[state]:
                    state = link[state]
                there = following[state].get(w)
                if there is None:
                    state = matched = 0
                else:
                    matched, state = lengths[state] + 1, there
            if least is None or matched >= least[state]:
                yield i, state, matched

    def _what(self, state: int, matched: int) -> tuple[int, frozenset[str]]:
        """Words hit at the end of a match, and the items whose windows end here."""
        key = (state, min(matched, self.window))
        if key not in self.seen:
            hit, names, at = 0, set(), state
            if matched >= self.window and (held := self.holders.get(self._window_state(state))):
                hit, names = self.window, set(held)
            while at > 0:
                n, own = self.short.get(at, (1 << 60, ()))
                if n <= matched:
                    hit = max(hit, n)
                    names.update(own)
                at = self.link[at]
            self.seen[key] = hit, frozenset(names)
        return self.seen[key]

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Number of words, ranges of hit words in order, and the items found."""
        own = words(text)
        find = self.vocabulary.get
        spans: list[tuple[int, int]] = []
        names: set[str] = set()
        for i, state, matched in self._run([find(w, 0) for w in own]):
            hit, found = self._what(state, matched)
            if hit:
                names |= found
                low = i + 1 - hit
                while spans and spans[-1][1] >= low:
                    low = min(low, spans.pop()[0])
                spans.append((low, i + 1))
        return len(own), spans, names


_automata: dict[str, Automaton] = {}
_SCANNED = [
    T.StructField("n_words", T.LongType()), T.StructField("starts", T.ArrayType(T.LongType())), T.StructField("ends", T.ArrayType(T.LongType())),
    T.StructField("items", T.ArrayType(T.StringType())),
]
_WITHOUT_HITS = T.StructField("cut", T.StringType())


def _scan(batches: Iterator[pa.RecordBatch], key: str, items, window: int, cut: bool) -> Iterator[pa.RecordBatch]:
    """What is found in each row, with ``cut`` also the cut text of rows with hits: a task needs one Python worker for both."""
    if key not in _automata:
        _automata.clear()
        _automata[key] = Automaton(items.value, window)
    automaton = _automata[key]
    for batch in by_bytes(batches):
        texts = raw_texts(batch.column("text"))
        found = [automaton.scan(t) for t in texts]
        columns = {
            "row": batch.column("row"), "n_words": pa.array([x[0] for x in found], type=pa.int64()),
            "starts": pa.array([[s for s, _ in x[1]] for x in found], type=pa.list_(pa.int64())),
            "ends": pa.array([[e for _, e in x[1]] for x in found], type=pa.list_(pa.int64())),
            "items": pa.array([sorted(x[2] - {None}) for x in found], type=pa.list_(pa.string())),
        }
        if cut:
            kept = [cut_spans(t, *zip(*x[1], strict=True)).decode() if x[1] else None for t, x in zip(texts, found, strict=True)]
            columns["cut"] = pa.array(kept, type=pa.string())
        yield pa.RecordBatch.from_pydict(columns)


def _blocks(items: DataFrame, block_words: int) -> list[DataFrame]:
    """The items in blocks of about ``block_words`` words, a longer item alone; each block is read when its turn comes."""
    sized = items.select(
        F.col("item_id").cast("string").alias("item"), text_of().cast("binary").alias("text"),
        F.pmod(F.xxhash64(F.col("item_id"), text_of()), F.lit(1 << 20)).alias("cell"),
        (F.octet_length(text_of()) / 4 + 1).alias("size"),
    )
    cells = sized.groupBy("cell").agg(F.sum("size").alias("size"))  # 2^20 rows at most
    before = F.sum("size").over(W.orderBy("cell").rowsBetween(W.unboundedPreceding, 0)) - F.col("size")
    placed = written(sized.drop("size").join(cells.select("cell", F.floor(before / block_words).alias("block")), "cell"), "items")
    numbers = [r.block for r in placed.select("block").distinct().sort("block").collect()]
    return [placed.where(F.col("block") == b).select("item", "text").distinct() for b in numbers]


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_words: int = 150_000, whole: bool = False) -> DataFrame:
    """Per row of ``docs``: ``row``, n_words, starts and ends of hit word ranges, items (sorted).

    ``row`` is the doc_id, with ``whole`` a struct of all columns; then ``cut`` is the text without its hit ranges, null without hits.
    """
    spark = docs.sparkSession
    rows = docs.select(F.struct("*").alias("row")) if whole else docs.select(F.col("doc_id").alias("row"), text_of().alias("text"))
    schema = T.StructType([rows.schema["row"], *_SCANNED, *([_WITHOUT_HITS] if whole else [])])

    def scanned(rows, block, schema, cut=False):
        # a block holds about block_words words, whatever the benchmark's size
        held = spark.sparkContext.broadcast([(r.item, bytes(r.text)) for r in block.collect()] if block is not None else [])
        key = uuid.uuid4().hex
        return rows.mapInArrow(lambda batches: trimmed(_scan(batches, key, held, window, cut)), schema)

    blocks = _blocks(items, block_words) or [None]
    if len(blocks) == 1:
        return scanned(rows, blocks[0], schema, whole)
    # copies of a row are scanned alike, so a row's hits in all blocks meet by its id and hash, and copies are put back after
    if whole:
        rows = rows.withColumn("text", F.col("row.text"))
    keyed = rows.select(F.struct("row", F.xxhash64("row", "text").alias("hash")).alias("row"), "text")
    parts = [scanned(keyed, b, T.StructType([keyed.schema["row"], *_SCANNED])) for b in blocks]
    ranges = F.arrays_zip("starts", "ends")
    merged = None
    for part in parts:
        part = part.select("row", "n_words", ranges.alias("spans"), "items")
        merged = part if merged is None else merged.unionByName(part)
    grouped = merged.groupBy("row").agg(
        F.max("n_words").alias("n_words"), (F.count("*") / len(blocks)).cast("int").alias("copies"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("spans")))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    empty = F.array().cast("array<struct<starts:long,ends:long>>")
    joined = F.aggregate(
        "spans", empty,
        lambda done, s: F.when(
            (F.size(done) > 0) & (F.element_at(done, -1)["ends"] >= s["starts"]),
            F.concat(
                F.slice(done, 1, F.size(done) - 1),
                F.array(F.struct(F.element_at(done, -1)["starts"].alias("starts"), F.greatest(F.element_at(done, -1)["ends"], s["ends"]).alias("ends"))),
            ),
        ).otherwise(F.concat(done, F.array(s))),
    )
    out = grouped.withColumn("spans", joined).withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).select(
        F.col("row.row").alias("row"), "n_words", F.col("spans.starts").alias("starts"), F.col("spans.ends").alias("ends"), "items"
    )
    if not whole:
        return out
    return out.withColumn("text", F.when(F.size("starts") > 0, F.col("row.text"))).mapInArrow(lambda batches: trimmed(_cut(batches)), schema)


def hit_words() -> Column:
    return F.aggregate(F.zip_with("starts", "ends", lambda s, e: e - s), F.lit(0).cast("long"), lambda a, x: a + x)


def cut_spans(text: bytes, starts: Sequence[int], ends: Sequence[int]) -> bytes:
    """The text without the hit ranges of words and what stands inside them; all around stays."""
    places = [m.span() for m in _RAW_WORD.finditer(text)]
    out, at = [], 0
    for low, high in zip(starts, ends, strict=True):
        out.append(text[at:places[low][0]])
        at = places[high - 1][1]
    return b"".join([*out, text[at:]])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Instead of the text the cut text of rows with hits, null for the others, whose text is not sent."""
    for batch in batches:
        columns = (raw_texts(batch.column("text")), batch.column("starts").to_pylist(), batch.column("ends").to_pylist())
        cut = [cut_spans(t, s, e).decode() if s else None for t, s, e in zip(*columns, strict=True)]
        rest = {n: batch.column(n) for n in batch.schema.names if n != "text"}
        yield pa.RecordBatch.from_pydict({**rest, "cut": pa.array(cut, type=pa.string())})


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, max_coverage: float = 0.5) -> DataFrame:
    """``docs`` without benchmark passages: hit spans are cut from the text and ``n_chars`` follows; a document whose hit words
    exceed ``max_coverage`` of its words goes. Documents without a hit are passed on untouched."""
    found = contamination(docs, items, window, whole=True)
    kept, out = found.where(hit_words() <= F.col("n_words") * max_coverage), []
    for f in docs.schema.fields:
        own = F.col("row").getField(f.name)
        new = {"text": F.col("cut"), "n_chars": F.length("cut").cast(f.dataType)}.get(f.name)
        out.append((own if new is None else F.coalesce(new, own)).alias(f.name))
    return kept.select(*out)
