"""A deterministic sharded WARC writer, and a reader.

Records are put in order of the page id. Ids are counted by payload bytes in cells of ids with the same leading bits; a cell heavier
than a shard is cut by further bits, as often as it takes, and a single id that is still too heavy by the first bits of the
payload digests. Runs of cells make up shards of at most about twice ``shard_bytes``, however the ids lie; only equal payloads under one
id stay together, all but one of which have no body. The cuts depend on the rows alone, so the same input gives the same
files, byte by byte, whatever the partitioning. A shard is written by one task as files that are rolled once their compressed size reaches ``file_bytes``; each record
is a gzip member of its own with headers and digests made anew. Payloads of ``least`` bytes and more that are equal are stored
once, with the largest page id; the others are revisit records without a body. Which page holds a repeated payload is found from
digests alone; these notes (page id, digest, holder) are dealt with the pages and sort just before them, so payloads are
shuffled once.

Tasks write under temporary names and return a manifest row per file. After all have ended, the manifest is stored, tasks give
the files their names (safe to repeat), and leftovers of failed attempts are removed. What the manifest lists is the archive.

Null html is an empty payload, a null url an empty one. Of rows repeating a page id with the same payload, the first is
the response and the others revisit it; a null page id sorts first, is never referred to, and revisits where another id holds its payload.
An empty table gives an empty manifest. Ids are integers. Tasks open files through ``pyarrow.fs``, at the place that Spark
resolves ``path`` to.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colweave.scratch import file_system as _system
from colweave.scratch import qualified

from .common import by_bytes, text_of, written

_CELL_BITS, _DIGEST_CELLS = 12, 4096
_INFO = b"software: colweave\r\nformat: WARC File Format 1.1\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_FILE = "shard int, roll int, temporary string, name string, bytes long, records long, sha256 string"


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _member(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + f"Content-Length: {len(block)}\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head.encode() + block + b"\r\n\r\n") + packer.flush()


def _record_id(page_id, nth: int = 0, shard: int = 0) -> str:
    """The page's own number; of rows repeating it (``nth`` > 0) also their shard's and their own."""
    return f"<urn:page:{'null' if page_id is None else page_id}{f':{shard}:{nth}' if nth else ''}>"


def _record(page_id, nth: int, shard: int, url: str, payload: bytes, size: int, digest: str, refers_to, date: str) -> bytes:
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode() + payload
    uri = url.replace("\r", "%0D").replace("\n", "%0A")
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", _record_id(page_id, nth, shard)), ("WARC-Date", date), ("WARC-Target-URI", uri)]
    if refers_to is not None:
        fields += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", _record_id(refers_to))]
    payload_digest = "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()
    fields += [("WARC-Block-Digest", _sha1(block)), ("WARC-Payload-Digest", payload_digest), ("Content-Type", "application/http; msgtype=response")]
    return _member(fields, block)


class _Roll:
    """The file being written under a temporary name."""

    def __init__(self, path: str, shard: int, roll: int, date: str):
        self.system, root = _system(path)
        self.name = f"shard-{shard:06d}-{roll:04d}.warc.gz"
        self.temporary = f"{self.name}.{uuid.uuid4().hex}"
        self.shard, self.roll, self.records, self.bytes, self.hash = shard, roll, 0, 0, hashlib.sha256()
        self.system.create_dir(f"{root}/_temporary", recursive=True)
        self.stream = self.system.open_output_stream(f"{root}/_temporary/{self.temporary}", compression=None)
        self._put(_member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:file:{self.name}>"), ("WARC-Date", date), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")], _INFO))

    def _put(self, data: bytes) -> None:
        self.stream.write(data)
        self.hash.update(data)
        self.bytes += len(data)

    def add(self, data: bytes) -> None:
        self._put(data)
        self.records += 1

    def close(self) -> dict:
        self.stream.close()
        return {"shard": self.shard, "roll": self.roll, "temporary": self.temporary, "name": self.name, "bytes": self.bytes, "records": self.records, "sha256": self.hash.hexdigest()}


def _write(batches: Iterator[pa.RecordBatch], path: str, file_bytes: int, least: int, date: str) -> Iterator[pa.RecordBatch]:
    file, done, before, nth, note = None, [], None, 0, None
    for batch in by_bytes(batches, "payload"):
        for row in batch.to_pylist():
            key = row["page_id"], row["digest"], row["size"]
            if row["holder"] is not None:
                note = key, row["holder"]
                continue
            if file is not None and (file.shard != row["shard"] or file.bytes >= file_bytes):
                done.append(file.close())
                file = _Roll(path, row["shard"], file.roll + 1 if file.shard == row["shard"] else 0, date)
            file = file or _Roll(path, row["shard"], 0, date)
            same = before is not None and before[0] == row["page_id"]
            nth = nth + 1 if same else 0
            refers_to = note[1] if note is not None and note[0] == key else None
            payload = b"" if refers_to is not None else row["payload"].encode()
            if refers_to is None and same and before[1] == row["digest"] and row["size"] >= least and row["page_id"] is not None:
                refers_to, payload = row["page_id"], b""
            before = row["page_id"], row["digest"]
            file.add(_record(row["page_id"], nth, row["shard"], row["url"], payload, row["size"], row["digest"], refers_to, date))
    if file is not None:
        done.append(file.close())
    yield pa.RecordBatch.from_pylist(done, schema=_arrow_schema())


def _arrow_schema() -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split(" ") for x in _FILE.split(", "))])


def _publish(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    system, root = _system(path)
    for batch in batches:
        for row in batch.to_pylist():
            final, temporary = f"{root}/{row['name']}", f"{root}/_temporary/{row['temporary']}"
            there = system.get_file_info(final)
            if not (there.is_file and there.size == row["bytes"]):
                system.move(temporary, final)
        yield batch


def _cell(bits: int, digests: bool = False) -> Column:
    """The cell of a row: the least id with the same bits before the last ``bits``, and the first bits of the digest or none."""
    least = F.expr(f"shiftleft(shiftright(coalesce(cast(page_id as bigint), -9223372036854775808), {bits}), {bits})")
    part = F.conv(F.substring("digest", 1, 3), 16, 10).cast("int") if digests else F.lit(-1)
    return F.struct(least.alias("id"), part.alias("part"))


def _shards(rows: DataFrame, shard_bytes: int) -> DataFrame:
    """Cells (cell, bits: how it was cut), each with its shard.

    There are at most about 4096 cells, and for each shard's worth of bytes in a cell too heavy as many again; a row of
    numbers each.
    """
    weight = F.sum(F.when(F.col("size") > 0, F.col("size")).otherwise(0) + 400).alias("w")
    edges = rows.agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).first()
    span = (edges["last"] or 0) - (edges["first"] or 0)  # Python numbers do not overflow
    bits, digests, found, left = max(0, span.bit_length() - _CELL_BITS), False, [], rows.select("page_id", "digest", "size")
    while True:
        how = -1 if digests else bits
        cells = written(left.groupBy(_cell(bits, digests).alias("cell")).agg(weight).withColumn("bits", F.lit(how)), "warc-cells")
        if digests:
            return _runs(found + [cells], shard_bytes)
        heavy = cells.where(F.col("w") > shard_bytes).select("cell")
        found.append(cells.where(F.col("w") <= shard_bytes))
        if heavy.isEmpty():
            return _runs(found, shard_bytes)
        # the heavy cells: at most one for each shard's worth of bytes
        left = left.withColumn("cell", _cell(bits)).join(F.broadcast(heavy), "cell").drop("cell")
        bits, digests = max(0, bits - _CELL_BITS), bits == 0


def _runs(cells: list[DataFrame], shard_bytes: int) -> DataFrame:
    every = cells[0]
    for more in cells[1:]:
        every = every.unionByName(more)
    before = F.sum("w").over(W.orderBy("cell").rowsBetween(W.unboundedPreceding, 0)) - F.col("w")  # a row of numbers per cell
    return every.select("cell", "bits", F.floor(before / shard_bytes).cast("int").alias("number")).withColumn(
        "shard", (F.dense_rank().over(W.orderBy("number")) - 1).cast("int")
    ).drop("number")


def _in_cells(rows: DataFrame, shards: DataFrame) -> DataFrame:
    """``rows`` with the shard of their cell, on whatever level that was cut."""
    levels = sorted((r.bits for r in shards.select("bits").distinct().collect()), reverse=True)  # 6 at most
    # cells of a level are looked up among that level's alone; a row is in one level's
    for level in levels:
        own = shards.where(F.col("bits") == level).select(F.col("cell").alias(f"c{level}"), F.col("shard").alias(f"s{level}"))
        rows = rows.withColumn(f"c{level}", _cell(max(level, 0), level < 0)).join(F.broadcast(own), f"c{level}", "left")
    return rows.withColumn("shard", F.coalesce(*[F.col(f"s{level}") for level in levels], F.lit(0)))


def write_warc(
    pages: DataFrame, path: str, least: int = 1000, shard_bytes: int = 64 << 20, file_bytes: int = 64 << 20, date: str = "2024-01-01T00:00:00Z",
) -> DataFrame:
    """Write page_id, url and html of every row below ``path`` (new) and return the manifest."""
    spark, path = pages.sparkSession, qualified(pages.sparkSession, path)
    html = text_of("html")
    rows = pages.select(
        "page_id", text_of("url").alias("url"), html.alias("payload"), F.octet_length(html).cast("long").alias("size"), F.sha1(html.cast("binary")).alias("digest")
    )
    repeatable = rows.where(F.col("size") >= least).select("page_id", "size", "digest")
    held = repeatable.groupBy("digest", "size").agg(F.max("page_id").alias("holder"), F.count("*").alias("n")).where("n > 1").drop("n")
    notes = repeatable.join(held, ["digest", "size"]).where(F.col("holder").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("holder")))
    rows = rows.withColumn("holder", F.lit(None).cast(pages.schema["page_id"].dataType)).unionByName(notes, allowMissingColumns=True)

    shards = written(_shards(rows.where("payload is not null"), shard_bytes), "warc-shards")
    count = (shards.agg(F.max("shard")).first()[0] or 0) + 1
    dealt = _in_cells(rows, shards).select("shard", "page_id", "url", "payload", "size", "digest", "holder").repartitionById(count, F.col("shard"))
    dealt = dealt.sortWithinPartitions("shard", F.col("page_id").asc_nulls_first(), "digest", "size", F.col("holder").isNull(), "url")
    files = dealt.mapInArrow(lambda b: _write(b, path, file_bytes, least, date), _FILE)
    files.write.parquet(f"{path}/_pending")
    pending = spark.read.schema(files.schema).parquet(f"{path}/_pending")
    pending.repartition("name").mapInArrow(lambda b: _publish(b, path), _FILE).drop("temporary").write.parquet(f"{path}/manifest")
    system, root = _system(path)
    for spent in (f"{root}/_temporary", f"{root}/_pending"):
        if system.get_file_info(spent).type.name == "Directory":
            system.delete_dir(spent)
    return spark.read.parquet(f"{path}/manifest")


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of every gzip member of a stream."""
    held = b""
    while True:
        unpacker, parts = zlib.decompressobj(31), []
        while not unpacker.eof:
            held = held or stream.read(1 << 20)
            if not held:
                if parts:
                    raise ValueError("the last record is cut short")
                return
            parts.append(unpacker.decompress(held))
            held = unpacker.unused_data
        head, _, body = b"".join(parts).partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        yield fields, body[:int(fields["Content-Length"])]


def _page(record_id: str) -> int | None:
    found = record_id.strip("<>").split(":")[2]
    return None if found == "null" else int(found)


def _read(batches: Iterator[pa.RecordBatch], path: str, with_payload: bool) -> Iterator[pa.RecordBatch]:
    system, root = _system(path)
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * with_payload
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()] + [pa.binary()] * with_payload
    for batch in batches:
        for name in batch.column("name").to_pylist():
            out, size = [], 0
            with system.open_input_stream(f"{root}/{name}", compression=None) as stream:
                for fields, block in records(stream):
                    if fields["WARC-Type"] == "warcinfo":
                        continue
                    if _sha1(block) != fields["WARC-Block-Digest"]:
                        raise ValueError(f"{name}: {fields['WARC-Record-ID']} does not match its digest")
                    http, _, payload = block.partition(b"\r\n\r\n")
                    if fields["WARC-Type"] == "response" and _sha1(payload) != fields["WARC-Payload-Digest"]:
                        raise ValueError(f"{name}: {fields['WARC-Record-ID']} does not match its payload digest")
                    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.startswith(b"Content-Length:"))
                    refers_to = _page(fields["WARC-Refers-To"]) if "WARC-Refers-To" in fields else None
                    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                    out.append((_page(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], length, digest, fields["WARC-Type"], refers_to) + ((payload,) if with_payload else ()))
                    size += len(block) if with_payload else 200
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
                        out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)


def read_warc(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """Every record of the archives the manifest lists, digests checked: page_id, url, payload size and digest, type, refers_to."""
    path = qualified(spark, path)
    files = spark.read.parquet(f"{path}/manifest").select("name").repartition("name")
    more = ", payload binary" if with_payload else ""
    return files.mapInArrow(
        lambda b: _read(b, path, with_payload),
        f"page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long{more}",
    )
