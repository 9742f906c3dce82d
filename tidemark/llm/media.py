"""Media columns: content-addressed payloads in tar shards; rows hold digest, shard, offset and length.

A payload becomes an 8-bit greyscale PNG of WIDTH samples a row (lossless), a member of a tar shard named by the SHA-256 of its
bytes. A task writes a payload once; where several tasks hold the same payload, all rows point to the copy whose shard sorts
first. Metadata columns come from range reads of the first HEADER bytes; payloads are read back, decoded and measured once for
each digest.

Cases: a null text is an empty one, whose payload is one row of blanks; texts that differ in trailing blanks only can share a
payload, not n_bytes; repeated rows and null ids get a result each; an empty table gives an empty result; other columns are ignored, whatever their
names.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_type, small_batches, strings, table
from tidemark.llm.storage import Reader, Writer
from tidemark.session import materialize, scratch_path

WIDTH = 192
HEADER = 33
LEVEL = 1
#: Bytes after which a task begins another shard.
SHARD_BYTES = 256 << 20
MAGIC = b"\x89PNG\r\n\x1a\n"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def payload_of(text: str) -> tuple[bytes, int]:
    """UTF-8 bytes with blanks up to a positive multiple of WIDTH, and the length before."""
    raw = text.encode()
    return raw.ljust(max(1, -(-len(raw) // WIDTH)) * WIDTH, b" "), len(raw)


def encode(payload: bytes) -> bytes:
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)  # filter byte 0 before each row
    lines[:, 1:] = rows
    return MAGIC + _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def header(start: bytes) -> tuple[int, int, int, int]:
    """(width, height, bit depth, colour type) from the first HEADER bytes."""
    if start[:8] != MAGIC or start[12:16] != b"IHDR":
        raise ValueError("not a PNG header")
    return struct.unpack(">IIBB", start[16:26])


def decode(media: bytes) -> bytes:
    width, height, depth, colour = header(media[:HEADER])
    at, data = 8, []
    while at < len(media):
        (n,) = struct.unpack(">I", media[at : at + 4])
        if media[at + 4 : at + 8] == b"IDAT":
            data.append(media[at + 8 : at + 8 + n])
        at += n + 12
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width + 1)
    if depth != 8 or colour != 0 or lines[:, 0].any():
        raise ValueError("only unfiltered 8-bit greyscale is written here")
    return lines[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Mean, deviation, edges and distinct values of the samples."""
    x = np.frombuffer(payload, np.uint8)
    step = np.abs(np.diff(x.astype(np.int16)))
    n = np.bincount(x, minlength=256)
    mean = float(n @ np.arange(256)) / len(x)
    var = float(n @ (np.arange(256) - mean) ** 2) / len(x)
    return f"mean={mean:.3f};std={var**0.5:.3f};edge={float(step.mean()) if len(step) else 0.0:.3f};values={int((n > 0).sum())}"


def write_shards(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """A row for each of docs: doc_id, n_bytes, digest, shard, offset, length."""
    spark = docs.sparkSession
    small_batches(spark)
    folder = scratch_path(spark, "media")
    kind = arrow_type(docs, "doc_id")
    out = pa.schema([("doc_id", kind), ("n_bytes", pa.int64()), ("digest", pa.string()), ("shard", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, there = None, {}
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), strings(batch, "text")):
                payload, n = payload_of(text)
                key = hashlib.sha256(payload).digest()
                if key not in there:
                    media = encode(payload)
                    name = hashlib.sha256(media).hexdigest()
                    if shard is None:
                        shard = Writer(folder, ".tar")
                    entry = tarfile.TarInfo(f"{name}.png")
                    entry.size = len(media)
                    shard.write(entry.tobuf(tarfile.PAX_FORMAT))
                    there[key] = (name, shard.uri, shard.write(media), len(media))
                    shard.write(b"\0" * (-len(media) % 512))
                rows.append((doc, n, *there[key]))
                if shard is not None and shard.at >= shard_bytes:
                    shard.write(b"\0" * 1024)
                    shard.close()
                    shard, there = None, {}
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), out.types)], schema=out)
        if shard is not None:
            shard.write(b"\0" * 1024)
            shard.close()

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes bigint, digest string, shard string, offset bigint, length bigint"
    return materialize(docs.select("doc_id", "text").mapInArrow(run, schema), "media-rows")


def canonical(rows: DataFrame) -> DataFrame:
    """One place for each digest: (digest, shard, offset, length)."""
    return rows.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("p")).select("digest", "p.shard", "p.offset", "p.length")


def _placed(places: DataFrame) -> DataFrame:
    n = int(places.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return places.repartition(n, "shard").sortWithinPartitions("shard", "offset")


def read_headers(places: DataFrame) -> DataFrame:
    """places with width, height, bit_depth and colour, from range reads of HEADER bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = Reader()
        for batch in batches:
            found = [header(files.read(s, o, HEADER)) for s, o in zip(batch.column("shard").to_pylist(), batch.column("offset").to_pylist())]
            meta = list(zip(*found)) or [()] * 4
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(m, pa.int32()) for m in meta]], names=[*batch.schema.names, "width", "height", "bit_depth", "colour"])
        files.close()

    return _placed(places).mapInArrow(run, "digest string, shard string, offset bigint, length bigint, width int, height int, bit_depth int, colour int")


def read_media(headed: DataFrame) -> DataFrame:
    """Rows with the payload's and the media's digests, lengths and features, from the stored bytes."""
    fields = [("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = Reader()
        for batch in batches:
            found = []
            for d, s, o, n in zip(*[batch.column(c).to_pylist() for c in ("digest", "shard", "offset", "length")]):
                media = files.read(s, o, n)
                name = hashlib.sha256(media).hexdigest()
                if name != d:
                    raise ValueError(f"{s} at {o} does not hold {d}")
                payload = decode(media)
                found.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), name, feature(payload)))
            columns = list(zip(*found)) or [()] * len(fields)
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(c, t) for c, (_, t) in zip(columns, fields)]], names=[*batch.schema.names, *[n for n, _ in fields]])
        files.close()

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in headed.schema) + ", payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    return headed.mapInArrow(run, schema)


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = write_shards(table(spark, sf_dir, "documents"))
    read = read_media(read_headers(canonical(rows)))
    return rows.select("doc_id", "n_bytes", "digest").join(read, "digest").select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "shard", "offset", "length", "width", "height"
    )
