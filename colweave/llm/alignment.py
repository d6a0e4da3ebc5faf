"""Which tokens of two tokenizers cover the same bytes, and how often each pair of ids does so in the corpus.

Either tokenizer cuts the bytes of a blank and the text into tokens. Offsets where both end a token part them into groups; tokens
of the two that overlap are linked. Work is done once per distinct unit of a batch (a blank and what follows up to the next
blank that neither tokenizer merges over), in numpy over all units end to end.

The first pass counts, per batch of rows, in how many documents an id pair is linked. The distinct pairs are cut into
``SHARDS`` by the first id, each shard gets a minimal perfect hash (levels of bit maps; a slot is the rank of its bit) with the full
pair in its slot. Counts are then added up in dense vectors indexed by slot, one per task, in blocks, and the vectors
are summed in a tree of two levels. The second pass aligns the documents again and looks every link up: the slot's pair
is compared, its count taken. A shard holds all pairs of its first ids, so their highest counts are known beside it, and at
most vocabulary / SHARDS x vocabulary pairs. Shards go to the tasks in segments of at most ``segment_pairs`` pairs (24 bytes
each); where there are several, there is one second pass for each, adding to what the one before has written.

A text is without tokens where it is null, empty, or where a tokenizer's bytes are not those of blank and text: zeros and the empty
string. Repeated rows are documents of their own. An empty table gives an empty result. Extra columns are ignored unless in ``row``.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_bytes, list_array, text_of, written

SHARDS = 512
_BLOCK = 4096
_BATCH = 8 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)

# -- tokenizers

#: Fixed value: the pre-tokenizer's pattern of byte-level vocabularies.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: First bytes below this one start characters up to U+023F, whose kinds all versions of Unicode agree on.
_PLAIN_BELOW = 0xC9
_SPACES = r"[\s\x0b\x1c-\x1f\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: Blanks that neither tokenizer merges over stand behind something else than white space and are not the last character.
_UNSAFE_BLANK = re.compile(r"(?:^|\s) | \Z")
_SAFE_BLANK = re.compile(r"(?<=\S) (?!\Z)")
#: Byte-level vocabularies write visible bytes as themselves and the others, in order, as the characters from 256.
_VISIBLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_TEXT_OF_BYTE = {**{b: chr(b) for b in _VISIBLE}, **{b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _VISIBLE)}}


class ByteLevel:
    """Tokenizer A, from the text of its tokenizers file.

    Plain text is merged by tiktoken's routine under the file's own ranks where the file is of the fixed kind (merges numbered in
    order, this pattern); all else goes to the tokenizers library.
    """

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(spec)
        self.library.encode_special_tokens = True
        parts = json.loads(spec)
        vocabulary, merges = parts["model"]["vocab"], parts["model"]["merges"]
        byte_of = {c: b for b, c in _TEXT_OF_BYTE.items()}
        added = {t["content"]: t["id"] for t in parts["added_tokens"]}
        self.bytes = [b""] * (max([*vocabulary.values(), *added.values()]) + 1)
        for token, i in vocabulary.items():
            self.bytes[i] = token.encode() if token in added else bytes([byte_of[c] for c in token])
        joined = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in merges]
        cut = parts.get("pre_tokenizer") or {}
        self.fast = None
        if (
            parts["model"]["type"] == "BPE" and parts.get("normalizer") is None and cut.get("type") == "ByteLevel" and cut.get("use_regex")
            and not cut["add_prefix_space"] and all(vocabulary[m] == 256 + i for i, m in enumerate(joined))
            and all(vocabulary[_TEXT_OF_BYTE[b]] < 256 for b in range(256))
        ):
            import tiktoken

            ranks = {self.bytes[i]: i for i in range(256 + len(merges))}
            self.fast = tiktoken.Encoding("a", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def plain(self, text: str) -> np.ndarray:
        return np.array(self.fast.encode_ordinary(text), dtype=np.int64)

    def any(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]


class Pieces:
    """Tokenizer B, from the bytes of its sentencepiece file; texts are given without the blank that it puts before them.

    Plain text is merged by tiktoken's routine under ranks made from the pieces' scores where these allow it: no piece has a blank
    behind another character, scores differ but for runs of blanks, and every character of a piece is a piece; all else goes
    to sentencepiece.
    """

    def __init__(self, model: bytes):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        lib, count = self.library, self.library.get_piece_size()
        of_byte = {int(lib.id_to_piece(i)[3:5], 16): i for i in range(count) if lib.is_byte(i)}
        normal = {
            lib.id_to_piece(i).replace("▁", " "): i for i in range(count) if not (lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i))
        }
        self.bytes = [b""] * count
        for b, i in of_byte.items():
            self.bytes[i] = bytes([b])
        for piece, i in normal.items():
            self.bytes[i] = piece.encode()
        single = {p: i for p, i in normal.items() if len(p) == 1}
        longer = {p: i for p, i in normal.items() if len(p) > 1 and all(c < "ɀ" for c in p)}
        scores = [lib.get_score(i) for p, i in longer.items() if p.strip(" ")]
        self.fast = None
        if (
            len(of_byte) == 256 and len(set(scores)) == len(scores) and not any(re.search(r"[^ ] ", p) for p in normal)
            and all(c in single for p in longer for c in p) and lib.encode("a  b ", out_type=str) == lib.encode("a", out_type=str) + ["▁", "▁b", "▁"]
        ):
            import tiktoken

            order = [single.get(chr(b), of_byte[b]) if b < 128 else of_byte[b] for b in range(256)]
            ranks = {bytes([b]): b for b in range(256)}
            for piece in [p for p in single if "\x80" <= p < "ɀ"] + sorted(longer, key=lambda p: -lib.get_score(longer[p])):
                ranks[piece.encode()] = len(order)
                order.append(normal[piece])
            self.id_of_rank = np.array(order, dtype=np.int64)
            self.fast = tiktoken.Encoding("b", pat_str=r" *[^ ]+| +", mergeable_ranks=ranks, special_tokens={})

    def plain(self, text: str) -> np.ndarray:
        return self.id_of_rank[np.array(self.fast.encode_ordinary(text), dtype=np.int64)]

    def any(self, texts: list[str]) -> list[list[int]]:
        return self.library.encode(texts, num_threads=1)


@dataclass
class Units:
    """The distinct units of a batch, aligned; ``links`` are codes a * vocabulary of B + b, unit by unit."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_links: np.ndarray
    odd: np.ndarray
    links: np.ndarray
    groups: list[bytes] | None


class Aligner:
    def __init__(self, spec: str, model: bytes):
        self.a, self.b = ByteLevel(spec), Pieces(model)
        self.size_b = len(self.b.bytes)
        self.length_a = np.array([len(x) for x in self.a.bytes], dtype=np.int64)
        self.length_b = np.array([len(x) for x in self.b.bytes], dtype=np.int64)
        self.fast = self.a.fast is not None and self.b.fast is not None
        numbers = [str(i).encode() for i in range(max(len(self.a.bytes), self.size_b))]
        self.parts = [n + s for n in numbers for s in (b",", b"|", b";")]
        self.part_lengths = np.array([len(p) for p in self.parts], dtype=np.int64)

    def units(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """Per text the number of its units, of all units their place among the distinct, and these without their first blank."""
        split = pc.split_pattern(texts, " ")
        counts = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = split.flatten().dictionary_encode()
        slots, distinct = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
        if pc.any(pc.match_substring_regex(texts, f"(^|{_SPACES}) | $")).as_py():
            place = {u: i for i, u in enumerate(distinct.to_pylist())}
            ends, parts = np.cumsum(counts), []
            for i, text in enumerate(texts.to_pylist()):
                if _UNSAFE_BLANK.search(text):
                    own = np.array([place.setdefault(u, len(place)) for u in _SAFE_BLANK.split(text)], dtype=np.int64)
                    counts[i] = len(own)
                else:
                    own = slots[ends[i] - counts[i]:ends[i]]
                parts.append(own)
            slots, distinct = np.concatenate(parts), pa.array(place, pa.string())
        return counts, slots, distinct

    def _plain(self, distinct: pa.Array) -> np.ndarray:
        """The units that can be encoded end to end: characters below U+0240, no blanks in a row, none at the end."""
        if not self.fast or not len(distinct):
            return np.zeros(len(distinct), dtype=bool)
        data, offsets = np.frombuffer(distinct.buffers()[2] or b"", dtype=np.uint8), np.frombuffer(distinct.buffers()[1], dtype=np.int32)
        starts, ends = (offsets[distinct.offset + i:][:len(distinct)] for i in (0, 1))
        filled, top = ends > starts, np.zeros(len(distinct), dtype=np.uint8)
        if filled.any():
            top[filled] = np.maximum.reduceat(data[:ends[-1]], starts[filled])
        unfit = pc.or_(pc.match_substring_regex(distinct, f"^ |  |{_SPACES}$"), pc.equal(pc.binary_length(distinct), 0))
        return (top < _PLAIN_BELOW) & ~unfit.to_numpy(zero_copy_only=False)

    def align(self, distinct: pa.Array, with_groups: bool) -> Units:
        plain = self._plain(distinct)
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])  # place -> unit
        together = distinct.filter(pa.array(plain)).to_pylist()
        text = " " + " ".join(together)
        a_ids, b_ids = ([self.a.plain(text)], [self.b.plain(text)]) if together else ([], [])
        sizes = pc.binary_length(distinct).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        odd, others = np.zeros(len(distinct), dtype=bool), np.flatnonzero(~plain)
        rest = distinct.take(pa.array(others)).to_pylist()
        found = zip(self.a.any([" " + u for u in rest]), self.b.any(rest), strict=True) if rest else ()
        for i, unit, (x, y) in zip(others, rest, found, strict=True):
            raw = b" " + unit.encode()
            if b"".join([self.a.bytes[t] for t in x]) != raw or b"".join([self.b.bytes[t] for t in y]) != raw:
                odd[i], sizes[i] = True, 0
                continue
            a_ids.append(np.array(x, dtype=np.int64))
            b_ids.append(np.array(y, dtype=np.int64))
        none = np.zeros(0, dtype=np.int64)
        a, b = np.concatenate([none, *a_ids]), np.concatenate([none, *b_ids])
        end_a, end_b, unit_ends = np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b]), np.cumsum(sizes[order])
        ends = np.concatenate([end_a, end_b])
        ends.sort(kind="stable")
        ends = ends[np.diff(ends, prepend=-1) > 0]
        links = a[np.searchsorted(end_a, ends)] * self.size_b + b[np.searchsorted(end_b, ends)]

        def per_unit(at: np.ndarray) -> np.ndarray:
            out = np.zeros(len(distinct), dtype=np.int64)
            out[order] = np.bincount(np.searchsorted(unit_ends, at), minlength=len(distinct))
            return out

        n_a, n_b, n_links = per_unit(end_a), per_unit(end_b), per_unit(ends)
        groups = self._groups(a, b, end_a, end_b, unit_ends, order) if with_groups else None
        if not np.array_equal(order, np.arange(len(order))):  # links in the order of the units
            starts = np.concatenate([[0], np.cumsum(n_links[order])])
            at = np.empty(len(order), dtype=np.int64)
            at[order] = starts[:-1]
            links = links[_runs(at, n_links)]
        return Units(n_a, n_b, n_links, odd, links, groups)

    def _groups(self, a, b, end_a, end_b, unit_ends, order) -> list[bytes]:
        """Per unit the text of its groups, each with a semicolon behind."""
        shared = np.intersect1d(end_a, end_b, assume_unique=True)
        group_a, group_b = np.searchsorted(shared, end_a), np.searchsorted(shared, end_b)
        last_a, last_b = shared[group_a] == end_a if len(a) else np.zeros(0, bool), shared[group_b] == end_b if len(b) else np.zeros(0, bool)
        code = np.concatenate([a * 3 + last_a, b * 3 + 2 * last_b])
        sequence = code[np.argsort(np.concatenate([group_a, group_b]), kind="stable")]
        joined = b"".join(map(self.parts.__getitem__, sequence.tolist()))
        of_unit = np.searchsorted(unit_ends, np.concatenate([end_a, end_b]))
        lengths = np.bincount(of_unit, weights=self.part_lengths[code], minlength=len(order)).astype(np.int64)
        ends = np.cumsum(lengths).tolist()
        out = [b""] * len(order)
        for unit, start, end in zip(order.tolist(), [0, *ends], ends, strict=False):
            out[unit] = joined[start:end]
        return out


def _runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of all runs, end to end."""
    total = int(lengths.sum())
    ahead = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    return ahead + np.arange(total, dtype=np.int64)


def _distinct(values: np.ndarray) -> np.ndarray:
    """The distinct non-negative values in order; ``values`` is used up."""
    values.sort()
    return values[np.diff(values, prepend=-1) > 0]


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of the given lengths."""
    upto = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(counts)
    return upto[ends] - upto[ends - counts]


_aligners: dict[int, Aligner] = {}


def _aligner(files) -> Aligner:
    key = hash(files.value)
    if key not in _aligners:
        _aligners.clear()
        _aligners[key] = Aligner(*files.value)
    return _aligners[key]


def _aligned(batch: pa.RecordBatch, aligner: Aligner, with_groups: bool):
    """Units per text, slots, the aligned units, and which texts have tokens."""
    texts = batch.column("text").cast(pa.string())
    counts, slots, distinct = aligner.units(texts)
    units = aligner.align(distinct, with_groups)
    empty = pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    good = ~empty & (_sums(units.odd[slots].astype(np.int64), counts) == 0)
    return counts, slots, units, good


# -- first pass: distinct pairs and counts

def _document_pairs(batches: Iterator[pa.RecordBatch], files) -> Iterator[pa.RecordBatch]:
    """Per batch its distinct pairs and in how many documents each is linked."""
    aligner = _aligner(files)
    for batch in by_bytes(batches, most=_BATCH):
        counts, slots, units, good = _aligned(batch, aligner, with_groups=False)
        doc = np.repeat(np.arange(batch.num_rows, dtype=np.int64), counts)
        n_units = max(1, len(units.n_a))
        seen = _distinct((doc * n_units + slots)[good[doc]])
        doc, unit = seen // n_units, seen % n_units
        starts = np.cumsum(units.n_links) - units.n_links
        code, pairs = pd.factorize(units.links)
        linked = code[_runs(starts[unit], units.n_links[unit])]
        n_pairs = max(1, len(pairs))
        n = np.bincount(_distinct(np.repeat(doc, units.n_links[unit]) * n_pairs + linked) % n_pairs, minlength=len(pairs))
        yield pa.RecordBatch.from_arrays([list_array(x, [len(pairs)], pa.int64()) for x in (pairs, n)], names=["pairs", "n"])


class PairHash:
    """Minimal perfect hashes of several shards of distinct non-negative integers, looked up together.

    ``sizes`` (shards x levels) are bits per level, ``words`` their bit maps, each level filled up to whole words; slots number
    the bits that are set, so those of a shard follow each other.
    """

    def __init__(self, sizes: np.ndarray, words: np.ndarray):
        self.sizes, self.words = sizes, words
        spans = (sizes + 63) // 64
        self.offsets = (np.cumsum(spans.reshape(-1)) - spans.reshape(-1)).reshape(spans.shape)
        set_bits = np.bitwise_count(words).astype(np.int64)
        self.ranks = np.cumsum(set_bits) - set_bits
        self.size = int(set_bits.sum())

    @staticmethod
    def _place(keys: np.ndarray, level: int, size) -> np.ndarray:
        mixed = (keys.astype(np.uint64) + np.uint64((level + 1) * 0xD1B54A32D192ED03 % 2**64)) * _ODD
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(29)
        return ((mixed >> np.uint64(1)) % np.asarray(size).astype(np.uint64)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray, spread: float = 2.0) -> PairHash:
        """The hash of one shard."""
        sizes, words, left = [], [], keys
        while len(left):
            size = max(1, int(np.ceil(spread * len(left))))
            at = cls._place(left, len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            bits = np.zeros(-(-size // 64) * 64, dtype=bool)
            bits[:size] = alone
            sizes.append(size)
            words.append(np.packbits(bits, bitorder="little").view("<u8"))
            left = left[~alone[at]]
            if len(sizes) > 200:
                raise ValueError("keys are not distinct")
        none = np.zeros(0, dtype=np.uint64)
        return cls(np.array([sizes], dtype=np.int64).reshape(1, -1), np.concatenate([none, *words]).astype(np.uint64))

    @classmethod
    def joined(cls, hashes: list[tuple[np.ndarray, np.ndarray]]) -> PairHash:
        """Several shards, given as their sizes and words, as one."""
        levels = max([len(s) for s, _ in hashes], default=0)
        sizes = np.zeros((len(hashes), levels), dtype=np.int64)
        for i, (s, _) in enumerate(hashes):
            sizes[i, :len(s)] = s
        return cls(sizes, np.concatenate([np.zeros(0, dtype=np.uint64), *[w for _, w in hashes]]))

    def slots(self, shard: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """The slot of each key in its shard, -1 where no level claims it; a key outside the set may get any slot."""
        out, left = np.full(len(keys), -1, dtype=np.int64), np.arange(len(keys))
        for level in range(self.sizes.shape[1]):
            left = left[self.sizes[shard[left], level] > 0]
            if not len(left):
                break
            at = self._place(keys[left], level, self.sizes[shard[left], level])
            word, bit = self.offsets[shard[left], level] + (at >> 6), (at & 63).astype(np.uint64)
            held = self.words[word]
            hit = (held >> bit) & np.uint64(1) == 1
            below = held[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            out[left[hit]] = self.ranks[word[hit]] + np.bitwise_count(below)
            left = left[~hit]
        return out


def _index(pdf: pd.DataFrame) -> pd.DataFrame:
    """A shard of the index: the hash and, slot by slot, the pairs."""
    keys = np.sort(pdf["pair"].to_numpy(dtype=np.int64))
    built = PairHash.build(keys)
    placed = np.empty_like(keys)
    placed[built.slots(np.zeros(len(keys), dtype=np.int64), keys)] = keys
    return pd.DataFrame({
        "shard": [pdf["shard"].iloc[0]], "sizes": [built.sizes[0].tolist()], "words": [built.words.astype("<u8").tobytes()],
        "pairs": [placed.astype("<i8").tobytes()], "n": [len(keys)],
    })


class Segment:
    """A run of shards: hash, pairs by slot, and once counted, counts and whether they are the highest of their first id."""

    def __init__(self, rows: list, vocabulary: int):
        rows = sorted(rows, key=lambda r: r.shard)
        self.vocabulary = vocabulary
        self.row_of = np.full(SHARDS, -1, dtype=np.int64)
        self.row_of[np.array([r.shard for r in rows], dtype=np.int64)] = np.arange(len(rows))
        self.hash = PairHash.joined([(np.array(r.sizes, dtype=np.int64), np.frombuffer(r.words, "<u8")) for r in rows])
        self.pairs = np.concatenate([np.zeros(0, dtype=np.int64), *[np.frombuffer(r.pairs, "<i8") for r in rows]])
        self.counts = self.best = None

    def find(self, pairs: np.ndarray) -> np.ndarray:
        """The slot of each pair, verified; -1 for those of other segments."""
        row = self.row_of[pairs // self.vocabulary % SHARDS]
        out, own = np.full(len(pairs), -1, dtype=np.int64), np.flatnonzero(row >= 0)
        slots = self.hash.slots(row[own], pairs[own])
        known = (slots >= 0) & (self.pairs[np.maximum(slots, 0)] == pairs[own])
        out[own[known]] = slots[known]
        return out

    def count(self, counts: np.ndarray) -> None:
        first = self.pairs // self.vocabulary
        top = np.zeros(int(first.max(initial=0)) + 1, dtype=np.int64)
        np.maximum.at(top, first, counts)
        self.counts, self.best = counts, counts == top[first]


def _vectors(batches: Iterator[pa.RecordBatch], held) -> Iterator[pa.RecordBatch]:
    """The task's dense count vector, in blocks that are not all zero."""
    segment = held.value
    total = np.zeros(-(-len(segment.pairs) // _BLOCK) * _BLOCK, dtype=np.int64)
    for batch in batches:
        pairs, n = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("pairs", "n"))
        slots = segment.find(pairs)
        np.add.at(total, slots[slots >= 0], n[slots >= 0])
    blocks = total.reshape(-1, _BLOCK)
    used = np.flatnonzero(blocks.any(axis=1))
    yield pa.RecordBatch.from_pydict({
        "block": pa.array(used, pa.int64()), "branch": pa.array(np.full(len(used), TaskContext.get().partitionId() % 64), pa.int64()),
        "counts": pa.array([blocks[i].astype("<i8").tobytes() for i in used], pa.binary()),
    })


def _add(pdf: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(_BLOCK, dtype=np.int64)
    for counts in pdf["counts"]:
        total += np.frombuffer(counts, "<i8")
    return pd.DataFrame({"block": [pdf["block"].iloc[0]], "branch": [pdf["branch"].iloc[0]], "counts": [total.astype("<i8").tobytes()]})


def _counted(found: DataFrame, segment: Segment) -> Segment:
    """Sum the tasks' vectors in two levels: within 64 branches, then over them."""
    held = found.sparkSession.sparkContext.broadcast(segment)
    schema = "block long, branch long, counts binary"
    vectors = found.mapInArrow(lambda b: _vectors(b, held), schema)
    branches = vectors.groupBy("block", "branch").applyInPandas(_add, schema)
    total = np.zeros(-(-len(segment.pairs) // _BLOCK) * _BLOCK, dtype=np.int64)
    for row in branches.groupBy("block").applyInPandas(_add, schema).select("block", "counts").collect():
        total[row.block * _BLOCK:(row.block + 1) * _BLOCK] = np.frombuffer(row.counts, "<i8")
    held.unpersist()
    segment.count(total[:len(segment.pairs)])
    return segment


# -- second pass

def _lookup(batches: Iterator[pa.RecordBatch], files, held, names: list[str]) -> Iterator[pa.RecordBatch]:
    aligner, segment = _aligner(files), held.value
    for batch in by_bytes(batches, most=_BATCH):
        counts, slots, units, good = _aligned(batch, aligner, with_groups="groups_sha256" in names)
        at = segment.find(units.links)
        known = at >= 0
        of_link = np.zeros((2, len(at)), dtype=np.int64)
        if len(segment.pairs):
            of_link[:, known] = segment.counts[at[known]], segment.best[at[known]]
        per_doc = lambda unit: _sums(np.where(np.repeat(good, counts), unit[slots], 0), counts)
        count_sum, n_best = (per_doc(_sums(x, units.n_links)) for x in of_link)
        out = {"row": batch.column("row"), "text": batch.column("text")}
        if "groups_sha256" in names:
            n_a, n_b, n_links = per_doc(units.n_a), per_doc(units.n_b), per_doc(units.n_links)
            ends, digests = np.cumsum(counts), []
            for fine, start, end in zip(good.tolist(), (ends - counts).tolist(), ends.tolist(), strict=True):
                text = b"".join(map(units.groups.__getitem__, slots[start:end].tolist())) if fine else b""
                digests.append(hashlib.sha256(memoryview(text)[:-1]).hexdigest() if fine else "")
            out |= {"n_a": n_a, "n_b": n_b, "n_groups": n_a + n_b - n_links, "n_links": n_links, "groups_sha256": digests}
        else:
            out |= {n: batch.column(n) for n in ("n_a", "n_b", "n_groups", "n_links", "groups_sha256")}
            n_best, count_sum = n_best + batch.column("n_best").to_numpy(), count_sum + batch.column("count_sum").to_numpy()
        out |= {"n_best": n_best, "count_sum": count_sum}
        yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in (out[n] for n in _NAMES if n in out)], names=[n for n in _NAMES if n in out])


_NAMES = ["row", "text", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def align(docs: DataFrame, row: Column, tokenizer_a: str, tokenizer_b: str, segment_pairs: int = 4_000_000) -> DataFrame:
    """``row``, tokens, groups and links of every row of ``docs``, and what the counts of its links come to.

    The tokenizers' files (A: tokenizers, byte level; B: sentencepiece) are read by the driver and sent to the tasks, a few MB
    whatever the input. Of the counts the driver holds one segment at a time.
    """
    spark = docs.sparkSession
    with open(tokenizer_a, encoding="utf-8") as a, open(tokenizer_b, "rb") as b:
        contents = a.read(), b.read()
    files, vocabulary = spark.sparkContext.broadcast(contents), len(Pieces(contents[1]).bytes)
    found = written(docs.select(text_of().alias("text")).mapInArrow(lambda x: _document_pairs(x, files), "pairs array<long>, n array<long>"), "pairs")
    distinct = found.select(F.explode("pairs").alias("pair")).distinct()
    shard = F.expr(f"cast((pair div {vocabulary}) % {SHARDS} as int)").alias("shard")
    index = written(
        distinct.select(shard, "pair").groupBy("shard").applyInPandas(_index, "shard int, sizes array<long>, words binary, pairs binary, n long"),
        "pair-index",
    )
    segments, size = [[]], 0
    for r in index.select("shard", "n").orderBy("shard").collect():  # at most SHARDS rows
        if segments[-1] and size + r.n > segment_pairs:
            segments.append([])
            size = 0
        segments[-1].append(r.shard)
        size += r.n
    base = docs.select(row.alias("row"), text_of().alias("text"))
    numbers = [T.StructField(n, T.LongType()) for n in _NAMES[2:-1]]
    schema = T.StructType([base.schema["row"], T.StructField("text", T.StringType()), *numbers, T.StructField("groups_sha256", T.StringType())])
    out = base
    for i, shards in enumerate(segments):
        segment = _counted(found, Segment(index.where(F.col("shard").isin(shards)).collect(), vocabulary))
        held, names = spark.sparkContext.broadcast(segment), _NAMES if i == 0 else _NAMES[:-1]
        out = out.mapInArrow(lambda x, held=held, names=names: _lookup(x, files, held, names), schema)
        if i + 1 < len(segments):
            out = written(out, "aligned")
            held.unpersist()
    return out.drop("text")
