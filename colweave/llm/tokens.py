"""Token ids as Parquet list columns that can be read selectively.

Rows are dealt by ranges of the id and sorted, so a file holds a range of documents in ascending order and the page
index of ``doc_id`` leads a reader to the pages it needs. Ids are delta or dictionary encoded; row groups and pages are
kept small enough that a few documents cost a few pages. A small index table beside the data holds one row per written
shard with the number of ids before it, from which the global start of every document follows.

Null text counts as empty. Rows sharing a ``doc_id`` are ordered by their text; equal rows get consecutive starts. A null
``doc_id`` comes first. An empty table gives empty files. Extra columns are kept only where ``keep`` names them, inside
the struct ``meta``, so their names cannot clash.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_bytes, list_array, text_of, trimmed

#: Ids of one shard and the part of its rows are found by these files of the output folder.
DATA, SHARDS = "data", "shards"

_encoders: dict[int, Encoder] = {}

# The parts of a tokenizer file under which the short way of ``Encoder`` holds.
_NORMALIZER = {
    "type": "Sequence",
    "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}],
}
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: Printable ASCII, the three line and tab characters and Latin-1 letters: what a plain unit is made of.
_OTHER = r"<\||[^\t\n\r\x20-\x7e\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}]"
_LOWER = bytes(32 if c in (9, 10, 13) else c + 32 if 65 <= c <= 90 or 0xC0 <= c <= 0xDE and c != 0xD7 else c for c in range(256))
_PRETOKEN = re.compile(rb"'(?:s|t|re|ve|m|ll|d)|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|\x00|[^\x00 0-9a-z\xdf-\xf6\xf8-\xff]+")
#: Byte-level vocabularies write visible bytes as themselves and the others, in order, as the characters from 256.
_VISIBLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_TEXT_OF_BYTE = {**{b: chr(b) for b in _VISIBLE}, **{b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _VISIBLE)}}
_BATCH = 4 << 20


class Encoder:
    """Encodes with the tokenizers library, each distinct unit of a batch once.

    For tokenizers of the fixed kind above nothing is merged or matched over a blank, so a text is the ids of its units between blanks.
    Units of printable ASCII and Latin-1 letters are cut into pre-tokens here and merged, all in one call, by tiktoken's
    routine under the file's ranks, a blank standing for the end of a word; other units go to the library. For other tokenizers
    every text goes to the library whole. Nothing is remembered between batches.
    """

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        parts = json.loads(spec)
        self.tokenizer = Tokenizer.from_str(spec)
        model, cut = parts["model"], (parts.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        self.short_way = (
            parts.get("normalizer") == _NORMALIZER and model["type"] == "BPE" and model.get("end_of_word_suffix") == "</w>" and len(cut) == 2
            and not model.get("ignore_merges") and not model.get("dropout")
            and cut[0] == {"type": "Split", "pattern": {"Regex": _PATTERN}, "behavior": "Removed", "invert": True}
            and cut[1]["type"] == "ByteLevel" and not cut[1]["add_prefix_space"] and not cut[1]["use_regex"]
            and all("<|" in t["content"] and " " not in t["content"] and not (t["lstrip"] or t["rstrip"] or t["single_word"]) for t in parts["added_tokens"])
        )
        if self.short_way:
            self.short_way = self._ranked(model["vocab"], ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]])

    def _ranked(self, vocabulary: dict[str, int], merges: list[str]) -> bool:
        """Set up the merging routine; False where the file does not number bytes, bytes that end words and merges in this order."""
        import tiktoken

        byte_of = {c: b for b, c in _TEXT_OF_BYTE.items()}
        single = sorted(vocabulary[c] for c in byte_of if c in vocabulary)
        final = sorted(vocabulary[f"{c}</w>"] for c in byte_of if f"{c}</w>" in vocabulary)
        if single != list(range(256)) or final != list(range(256, 512)) or [vocabulary[m] for m in merges] != list(range(512, 512 + len(merges))):
            return False
        as_bytes = lambda t: bytes(byte_of[c] for c in t.removesuffix("</w>")) + b" " * t.endswith("</w>")
        order = [vocabulary[_TEXT_OF_BYTE[b]] for b in range(256)] + final + list(range(512, 512 + len(merges)))
        token_of = {i: t for t, i in vocabulary.items()}
        ranks = {bytes([b]): b for b in range(256)}
        ranks.update((as_bytes(token_of[i]), rank) for rank, i in enumerate(order) if rank >= 256)
        self.id_of_rank = np.array(order, dtype=np.int32)
        self.merger = tiktoken.Encoding("words", pat_str="[^ ]+ ", mergeable_ranks=ranks, special_tokens={})
        self.unit_end = ranks[b"\x00 "]
        return len(ranks) == len(order)

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=np.int32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _plain_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of plain units end to end, and how many each has."""
        joined = ("\x00".join(units) + "\x00").encode("latin-1").translate(_LOWER)
        stream = b" ".join(_PRETOKEN.findall(joined)) + b" "
        ranks = np.array(self.merger.encode_ordinary(stream.decode("latin-1")), dtype=np.int32)
        end = ranks == self.unit_end
        lengths = np.diff(np.flatnonzero(end), prepend=-1) - 1
        return self.id_of_rank[ranks[~end]], lengths

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, and how many each text has."""
        none = np.zeros(0, dtype=np.int32)
        if not self.short_way:
            found = self._library(texts.to_pylist())
            return np.concatenate([none, *found]), np.array([len(x) for x in found], dtype=np.int64)
        split = pc.split_pattern(texts, " ")
        counts = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = split.flatten().dictionary_encode()
        slots, distinct = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
        other = pc.match_substring_regex(distinct, _OTHER)
        plain_at, other_at = (np.flatnonzero(m.to_numpy(zero_copy_only=False)) for m in (pc.invert(other), other))
        ids, plain_lengths = self._plain_units(distinct.take(pa.array(plain_at)).to_pylist()) if len(plain_at) else (none, none)
        found = self._library(distinct.take(pa.array(other_at)).to_pylist()) if len(other_at) else []
        lengths, starts = np.zeros(len(distinct), dtype=np.int64), np.zeros(len(distinct), dtype=np.int64)
        order = np.concatenate([plain_at, other_at])
        ids, by_place = np.concatenate([ids, *found]), np.concatenate([plain_lengths, [len(x) for x in found]]).astype(np.int64)
        lengths[order], starts[order] = by_place, np.cumsum(by_place) - by_place
        of_unit = lengths[slots]
        ahead = np.repeat(starts[slots] - (np.cumsum(of_unit) - of_unit), of_unit)
        upto = np.concatenate([[0], np.cumsum(of_unit)])
        ends = np.cumsum(counts)
        return ids[ahead + np.arange(len(ahead))], upto[ends] - upto[ends - counts]

    def encode(self, texts: list[str]) -> list[list[int]]:
        ids, lengths = self.encode_column(pa.array(texts, pa.string()))
        return [x.tolist() for x in np.split(ids, np.cumsum(lengths)[:-1])] if texts else []


def _encode(batches: Iterator[pa.RecordBatch], spec, end_id: int | None, keep: bool) -> Iterator[pa.RecordBatch]:
    key = hash(spec.value)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(spec.value)
    encoder, shard, start = _encoders[key], TaskContext.get().partitionId(), 0
    for batch in by_bytes(batches, most=_BATCH):
        flat, lengths = encoder.encode_column(batch.column("text").cast(pa.string()))
        if end_id is not None:
            flat, lengths = np.insert(flat, np.cumsum(lengths), end_id), lengths + 1
        before = start + np.cumsum(lengths) - lengths
        start += int(lengths.sum())
        columns = {
            "doc_id": batch.column("doc_id"), "shard": pa.array(np.full(len(lengths), shard, dtype=np.int32)),
            "shard_start": pa.array(before), "n_tokens": pa.array(lengths), "ids": list_array(flat, lengths, pa.int32()),
        }
        if keep:
            columns["meta"] = batch.column("meta")
        yield pa.RecordBatch.from_pydict(columns)


def write_tokens(
    docs: DataFrame, path: str, tokenizer_file: str, end_id: int | None = None, keep: tuple[str, ...] = (),
    encoding: str = "delta", row_group_bytes: int = 32 << 20, page_bytes: int = 256 << 10, page_rows: int = 2000,
) -> None:
    """Encode ``text`` of every row and write the ids below ``path``; see the module's text.

    ``encoding``: ``delta`` (DELTA_BINARY_PACKED) or ``dictionary`` for the ids. The tokenizer's file is read by the driver
    and sent to the tasks: a few MB whatever the input.
    """
    if encoding not in ("delta", "dictionary"):
        raise ValueError(f"unknown encoding {encoding}")
    spark = docs.sparkSession
    with open(tokenizer_file, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())
    columns = ["doc_id", text_of().alias("text")] + ([F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in keep]).alias("meta")] if keep else [])
    ranged = docs.select(*columns).repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(
        F.col("doc_id").asc_nulls_first(), "text"
    )
    kinds = {"shard": T.IntegerType(), "shard_start": T.LongType(), "n_tokens": T.LongType(), "ids": T.ArrayType(T.IntegerType())}
    schema = T.StructType([
        T.StructField("doc_id", docs.schema["doc_id"].dataType), *[T.StructField(n, k) for n, k in kinds.items()],
        *([ranged.schema["meta"]] if keep else []),
    ])
    encoded = ranged.mapInArrow(lambda batches: trimmed(_encode(batches, spec, end_id, bool(keep))), schema)
    encoded.write.options(
        **{
            "compression": "zstd", "parquet.writer.version": "PARQUET_2_0", "parquet.block.size": row_group_bytes,
            "parquet.page.size": page_bytes, "parquet.page.row.count.limit": page_rows,
            "parquet.enable.dictionary": encoding == "dictionary",
        }
    ).parquet(f"{path}/{DATA}")
    data = spark.read.schema(encoded.schema).parquet(f"{path}/{DATA}")
    totals = data.groupBy("shard").agg(
        F.min("doc_id").alias("first_doc_id"), F.max("doc_id").alias("last_doc_id"), F.count("*").alias("n_docs"),
        F.sum("n_tokens").alias("n_tokens"),
    )
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)  # a row per shard, in the order of the ranges
    totals.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).coalesce(1).write.parquet(f"{path}/{SHARDS}")


def read_tokens(
    spark: SparkSession, path: str, columns: tuple[str, ...] = ("doc_id", "start", "n_tokens", "ids"),
    first_doc_id: int | None = None, last_doc_id: int | None = None,
) -> DataFrame:
    """The named columns of the documents in a range of ids; only those columns' pages in that range are read.

    ``start`` counts the ids of all documents before, over the whole output. The shard table joined for it has one row per
    written shard, at most the number of shuffle partitions.
    """
    data = spark.read.parquet(f"{path}/{DATA}")
    if first_doc_id is not None:
        data = data.where(F.col("doc_id") >= first_doc_id)
    if last_doc_id is not None:
        data = data.where(F.col("doc_id") <= last_doc_id)
    if "start" in columns:
        shards = spark.read.parquet(f"{path}/{SHARDS}").select(F.col("shard"), F.col("start").alias("before"))
        data = data.join(F.broadcast(shards), "shard").withColumn("start", F.col("before") + F.col("shard_start"))
    return data.select(*columns)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("ids")
        flat, offsets = lists.values.to_numpy(zero_copy_only=False).astype("<u4"), lists.offsets.to_numpy()
        crcs = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        yield pa.RecordBatch.from_pydict({
            "doc_id": batch.column("doc_id"), "start": batch.column("start"),
            "n_tokens": pa.array(np.diff(offsets).astype(np.int64)), "ids_crc32": pa.array(crcs, type=pa.int64()),
        })


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: where its ids start, how many there are, and their crc32."""
    ids = read_tokens(spark, path, ("doc_id", "start", "ids"))
    kind = ids.schema["doc_id"].dataType.simpleString()
    return ids.mapInArrow(lambda batches: trimmed(_digest(batches)), f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")
