"""WARC archives with a two-level capture index.

Each page becomes a gzip member of an archive, after a warcinfo record: a response, or a revisit (its HTTP head only) of the page with the least id among those with
an equal payload of at least REVISIT_BYTES. Index lines, keyed by reversed host and path, are sorted over all parts and written in
compressed blocks of BLOCK lines; each part has a sparse directory of its blocks, and the parts' first keys are the top. A lookup
finds its part and then its block by binary search, reads that block's range, then the records' ranges.

Cases: a null html is an empty payload; a null url has the empty key; pages that repeat an id: all rows with a group's least id are
responses, and a row is returned for each record; a null id never is the id of a response that others revisit, but if all of a group have none, all are
responses; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import by_run, sieve, small_batches, strings, table
from tidemark.llm.storage import Reader, Writer
from tidemark.session import materialize, scratch_path

REVISIT_BYTES = 100
BLOCK = 256
LEVEL = 6
DATE = "2026-01-01T00:00:00Z"
#: Bytes after which a task begins another archive.
ARCHIVE_BYTES = 1 << 30


def url_key(url: str | None) -> str:
    """Host parts reversed, then path and query: org,example,www)/a?b. No scheme, port 80 or 443, user or fragment."""
    if not url:
        return ""
    try:
        parts = urlsplit(url if "//" in url else f"//{url}")
        host, port = (parts.hostname or "").lower(), parts.port
    except ValueError:
        return url
    return ",".join(reversed(host.split("."))) + (f":{port}" if port not in (None, 80, 443) else "") + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{digest}')}>"


def _member(lines: list[str], block: bytes) -> bytes:
    return gzip.compress("\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n", LEVEL, mtime=0)


def archive_head(name: str) -> bytes:
    """The record that an archive begins with."""
    lines = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Date: {DATE}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>", "Content-Type: application/warc-fields"]
    return _member(lines, b"software: tidemark\r\nformat: WARC File Format 1.1\r\n")


def write_record(url: str, page_id: int | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A page as a gzip member: an HTTP response; of a revisit only its head."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + (b"" if refers_to is not None else payload)
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Date: {DATE}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Payload-Digest: sha256:{digest}"]
    if url:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if page_id is not None:
        lines.append(f"X-Page: {page_id}")
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page: {refers_to}"]
    return _member([*lines, "Content-Type: application/http; msgtype=response"], block)


def read_record(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers by lower-case name, and the payload: what stands after the HTTP head of the block."""
    head, _, rest = gzip.decompress(member).partition(b"\r\n\r\n")
    names = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    headers = {k.lower(): v for k, v in names.items()}
    return headers, rest[: int(headers["content-length"])].partition(b"\r\n\r\n")[2]


def plan_records(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, digest, refers_to). Only payloads that may be shared are dealt out to meet the shared ones."""
    rows = pages.select(F.col("page_id").cast("long"), "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    first = rows.where(F.octet_length("payload") >= REVISIT_BYTES).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    first = materialize(first.withColumn("h", F.xxhash64("digest")), "shared-payloads")  # as a table it can meet a very frequent payload in parts
    rows = sieve(rows, F.xxhash64("digest"), first, "h")
    out = ["page_id", "url", "payload", "digest"]
    met = rows.where("__maybe").select(*out).join(first, "digest", "left")
    met = met.select(*out, F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))
    return met.unionByName(rows.where("NOT __maybe").select(*out, F.lit(None).cast("long").alias("refers_to")))


def write_archives(pages: DataFrame) -> DataFrame:
    """Index lines: key, page_id, file, offset, length."""
    spark = pages.sparkSession
    small_batches(spark)
    folder = scratch_path(spark, "warc")
    out = pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = None
        for batch in batches:
            rows = []
            for page, url, payload, digest, refers in zip(*[batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to")]):
                if archive is None:
                    archive = Writer(folder, ".warc.gz")
                    archive.write(archive_head(archive.uri))
                member = write_record(url or "", page, payload, digest, refers)
                rows.append((url_key(url), page, archive.uri, archive.write(member), len(member)))
                if archive.at >= ARCHIVE_BYTES:
                    archive.close()
                    archive = None
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), out.types)], schema=out)
        if archive is not None:
            archive.close()

    return materialize(plan_records(pages).mapInArrow(run, "key string, page_id bigint, file string, offset bigint, length bigint"), "warc-lines")


def write_index(lines: DataFrame) -> list[tuple]:
    """The top of the index: (first key, first page, file, directory offset, directory length) of each part, sorted; a row a part comes to the driver."""
    spark = lines.sparkSession
    folder = scratch_path(spark, "index")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, directory, block, files = None, [], [], {}

        def flush() -> None:
            data = zlib.compress("\n".join(block).encode(), LEVEL)
            first = json.loads(block[0])
            directory.append([first[0], first[1], part.write(data), len(data)])
            block.clear()

        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in ("key", "page_id", "file", "offset", "length")]):
                if part is None:
                    part = Writer(folder, ".cdx")
                block.append(json.dumps(row))
                if len(block) == BLOCK:
                    flush()
        if part is None:
            return
        if block:
            flush()
        data = json.dumps(directory).encode()
        at = part.write(data)
        part.close()
        first = directory[0]
        yield pa.RecordBatch.from_arrays([pa.array([x]) if x is not None else pa.array([None], pa.int64()) for x in (first[0], first[1], part.uri, at, len(data))], names=["key", "page_id", "file", "at", "size"])

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = lines.repartitionByRange(n, "key", "page_id").sortWithinPartitions("key", "page_id")
    tops = ordered.mapInArrow(run, "key string, page_id bigint, file string, at bigint, size bigint").collect()
    return sorted((tuple(t) for t in tops), key=lambda t: place(t[0], t[1]))


def place(key: str, page: int | None) -> tuple:
    """The order of the index: by UTF-8 bytes of the key, then by page, null first, as the sort of the parts has it."""
    return key.encode(), page is not None, page or 0


def lookup(wanted: DataFrame, tops: list[tuple]) -> DataFrame:
    """wanted (key, page_id), each once: the records there are for it, read from the archives."""
    spark = wanted.sparkSession
    firsts = [place(t[0], t[1]) for t in tops]
    parts = [t[2:] for t in tops]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = [bisect.bisect_right(firsts, place(k, p)) - 1 for k, p in zip(strings(batch, "key"), batch.column("page_id").to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part, pa.int32())], names=["key", "page_id", "part"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, index = Reader(), Reader(2)
        for group in by_run(batches, ["part"]):
            part = group.column("part")[0].as_py()
            if part < 0:
                continue
            uri, at, size = parts[part]
            directory = json.loads(index.read(uri, at, size))
            starts = [place(d[0], d[1]) for d in directory]
            held, lines = -1, []
            rows = []
            for key, page in zip(group.column("key").to_pylist(), group.column("page_id").to_pylist()):
                want = place(key, page)
                b = max(bisect.bisect_left(starts, want) - 1, 0)
                while b < len(directory) and starts[b] <= want:
                    if b != held:
                        held, lines = b, [json.loads(x) for x in zlib.decompress(index.read(uri, *directory[b][2:])).decode().split("\n")]
                    i = bisect.bisect_left(lines, want, key=lambda x: place(x[0], x[1]))
                    while i < len(lines) and place(lines[i][0], lines[i][1]) == want:
                        headers, payload = read_record(files.read(*lines[i][2:]))
                        kind, refers = headers["warc-type"], headers.get("x-refers-to-page")
                        digest = headers["warc-payload-digest"].partition(":")[2]
                        if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
                            raise ValueError(f"{lines[i]} does not hold {digest}")
                        number = headers.get("x-page")
                        rows.append((int(number) if number else None, len(payload) if kind == "response" else None, digest, kind, int(refers) if refers else None))
                        i += 1
                    b += 1
                if len(rows) >= 10_000:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)
        files.close()
        index.close()

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = wanted.mapInArrow(assign, "key string, page_id bigint, part int").repartition(n, "part").sortWithinPartitions("part", "key", "page_id")
    return dealt.mapInArrow(run, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")


_ROW = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ROW.types)], schema=_ROW)


def with_keys(pages: DataFrame) -> DataFrame:
    """(key, page_id), each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([url_key(u) for u in batch.column("url").to_pylist()], pa.string()), batch.column("page_id")], names=["key", "page_id"])

    return pages.select("url", F.col("page_id").cast("long").alias("page_id")).mapInArrow(run, "key string, page_id bigint").distinct()


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    lines = write_archives(pages)
    read = materialize(lookup(with_keys(pages), write_index(lines)), "warc-read")
    full = read.where("record_type = 'response'").groupBy(F.col("page_id").alias("__p"), F.col("payload_digest").alias("__d")).agg(F.first("payload_bytes").alias("__n"))
    rows = read.join(full, (F.col("refers_to") == F.col("__p")) & (F.col("payload_digest") == F.col("__d")), "left")
    return rows.select("page_id", F.coalesce("payload_bytes", "__n").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= {REVISIT_BYTES} GROUP BY 1)
SELECT page_id, payload_bytes, d.payload_digest, CASE WHEN first IS NULL OR page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM d LEFT JOIN f ON d.payload_digest = f.payload_digest
"""
