"""WARC archives with a two-level capture index.

Archives: one gzip member per record, many archives, one writer per task. Index: capture lines
sorted by reversed-host key in compressed blocks, a sparse directory with one entry per block, and
one entry per index part above it. A lookup bisects parts, directory and block, then reads the
record's byte range.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path
from ..sources.files import filesystem, qualified
from .common import slices, stash

REVISIT_BYTES = 1000
BLOCK_LINES = 2048
ARCHIVE_BYTES = 1 << 30
LEVEL = 3


def surt(url: Column) -> Column:
    """Reversed-host key: ``http://www.Example.com:80/a?b`` becomes ``com,example,www:80)/a?b``. Null is empty."""
    rest = F.regexp_replace(url, r"^[^:/?#]*://", "")
    host = F.lower(F.regexp_extract(rest, r"^[^/?#]*", 0))
    name, port = F.regexp_extract(host, r"^([^:]*)", 1), F.regexp_extract(host, r"^[^:]*(:.*)?$", 1)
    key = F.concat(F.array_join(F.reverse(F.split(name, r"\.")), ","), port, F.lit(")"), F.regexp_extract(rest, r"^[^/?#]*([^#]*)", 1))
    return F.coalesce(F.translate(key, "\t\n\r", ""), F.lit(""))


def capture_key(url: Column, page_id: Column) -> Column:
    """The index key: reversed-host key, then the page's number so that many captures of one URL still
    sort apart and can be dealt over parts. Nulls come first."""
    number = F.lpad((page_id.cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("string"), 20, "0")
    return F.concat(surt(url), F.lit("\t"), F.coalesce(number, F.lit("")))


def with_revisits(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, bytes, digest, record_type, refers_to).

    Of equal payloads of at least 1000 bytes the largest page_id is the response (rows repeating it
    all are), the rest revisit it; a group without any page_id is all responses. Equality is SHA-1
    and length. The digests are grouped alone, without payloads; only groups of two or more are joined back.
    """
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"bytes": F.octet_length("payload").cast("long"), "digest": F.sha1("payload")})
    groups = rows.where(F.col("bytes") >= REVISIT_BYTES).groupBy("digest", "bytes")
    shared = groups.agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("original")).where("n > 1").drop("n")
    rows = rows.join(shared, ["digest", "bytes"], "left")
    again = F.col("original").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("original"))
    return rows.withColumns(
        {"record_type": F.when(again, "revisit").otherwise("response"), "refers_to": F.when(again, F.col("original"))}
    ).drop("original")


def _record(row: dict) -> bytes:
    """One record, compressed. Dates are fixed: pages carry none, and equal input gives equal archives."""
    url = (row["url"] or "").replace("\r", "%0D").replace("\n", "%0A")
    head = [
        "WARC/1.1",
        f"WARC-Type: {row['record_type']}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, row['key'])}>",
        f"WARC-Target-URI: {url}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{row['digest']}",
        f"X-Payload-Length: {row['bytes']}",
    ]
    if row["page_id"] is not None:
        head.append(f"X-Page-ID: {row['page_id']}")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    if row["record_type"] == "revisit":
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"X-Refers-To-Page-ID: {row['refers_to']}",
        ]
        block = http
    else:
        block = http + row["payload"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", LEVEL, mtime=0)


def read_record(data: bytes) -> dict:
    """Headers and payload of one compressed record; a response whose payload does not match its digest is an error."""
    raw = gzip.decompress(data)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    digest, size = fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(fields["X-Payload-Length"])
    if fields["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} is damaged")
    number = lambda name: int(fields[name]) if name in fields else None
    return {
        "page_id": number("X-Page-ID"), "url": fields["WARC-Target-URI"], "record_type": fields["WARC-Type"], "payload_bytes": size,
        "payload_digest": digest, "refers_to": number("X-Refers-To-Page-ID"), "payload": payload if fields["WARC-Type"] == "response" else None,
    }


CAPTURES = T.StructType([T.StructField(n, t) for n, t in (("key", T.StringType()), ("file", T.StringType()), ("offset", T.LongType()), ("length", T.LongType()))])
PARTS = T.StructType([T.StructField(n, T.StringType()) for n in ("first", "last", "file")])


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write every page as a record below ``folder``; (key, file, offset, length) per record.

    A task names its archives anew, so a repeated task leaves files that no capture points to.
    """
    rows = with_revisits(pages).withColumn("key", capture_key(F.col("url"), F.col("page_id")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, inner = filesystem(folder)
        fs.create_dir(inner, recursive=True)
        out = name = None
        at = 0
        try:
            for whole in batches:
                for b in slices(whole, "payload"):
                    found = {"key": [], "file": [], "offset": [], "length": []}
                    for row in b.to_pylist():
                        if out is None or at >= ARCHIVE_BYTES:
                            if out is not None:
                                out.close()
                            name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                            out = fs.open_output_stream(f"{inner}/{name}", compression=None)
                        data = _record(row)
                        out.write(data)
                        for k, v in (("key", row["key"]), ("file", name), ("offset", at), ("length", len(data))):
                            found[k].append(v)
                        at += len(data)
                    yield pa.RecordBatch.from_pydict(found, pa.schema([("key", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]))
        finally:
            if out is not None:
                out.close()

    return stash(rows.mapInArrow(run, CAPTURES), "captures")


def build_index(captures: DataFrame, folder: str) -> DataFrame:
    """Sort captures into blocks of compressed lines below ``folder``; (first, last, file) per index part.

    Each part is a range of keys: a file of blocks and a file with their directory.
    """
    rows = captures.repartitionByRange("key", "file", "offset").sortWithinPartitions("key", "file", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, inner = filesystem(folder)
        fs.create_dir(inner, recursive=True)
        name = uuid.uuid4().hex
        blocks: list[list] = []
        lines: list[tuple] = []
        out, at = None, 0

        def flush():
            nonlocal at
            data = zlib.compress("\n".join(f"{k}\t{f}\t{o}\t{n}" for k, f, o, n in lines).encode())
            out.write(data)
            blocks.append([lines[0][0], lines[-1][0], at, len(data)])
            at += len(data)
            lines.clear()

        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("key", "file", "offset", "length")), strict=True):
                if out is None:
                    out = fs.open_output_stream(f"{inner}/{name}.blocks", compression=None)
                lines.append(row)
                if len(lines) == BLOCK_LINES:
                    flush()
        if lines:
            flush()
        if out is not None:
            out.close()
            with fs.open_output_stream(f"{inner}/{name}.directory", compression=None) as d:
                d.write(zlib.compress(json.dumps(blocks).encode()))
            yield pa.RecordBatch.from_pydict({"first": [blocks[0][0]], "last": [blocks[-1][1]], "file": [name]})

    return stash(rows.mapInArrow(run, PARTS), "index-parts")


class _Reader:
    """Range reads that keep a few files open, and the last directory and block decoded."""

    def __init__(self, index: str, archives: str, parts: list[tuple[str, str, str]]):
        self.index, self.archives = filesystem(index), filesystem(archives)
        self.parts = sorted(parts)
        self.firsts = [p[0] for p in self.parts]
        self.open: dict[str, object] = {}
        self.directory: tuple[str, list] = ("", [])
        self.block: tuple[tuple, list] = ((), [])

    def _range(self, fs, path: str, offset: int, length: int) -> bytes:
        if path not in self.open:
            if len(self.open) >= 64:
                self.open.pop(next(iter(self.open))).close()
            self.open[path] = fs.open_input_file(path)
        f = self.open[path]
        f.seek(offset)
        return f.read(length)

    def captures(self, key: str) -> Iterator[tuple[str, int, int]]:
        """(file, offset, length) of every capture with this key; equal keys may span blocks and parts."""
        fs, root = self.index
        i = max(0, bisect_left(self.firsts, key) - 1)
        while i < len(self.parts) and self.parts[i][0] <= key:
            first, last, name = self.parts[i]
            i += 1
            if last < key:
                continue
            if self.directory[0] != name:
                with fs.open_input_stream(f"{root}/{name}.directory", compression=None) as d:
                    self.directory = (name, json.loads(zlib.decompress(d.read())))
            blocks = self.directory[1]
            j = max(0, bisect_left(blocks, [key]) - 1)
            while j < len(blocks) and blocks[j][0] <= key:
                lo, hi, offset, length = blocks[j]
                j += 1
                if hi < key:
                    continue
                if self.block[0] != (name, offset):
                    text = zlib.decompress(self._range(fs, f"{root}/{name}.blocks", offset, length)).decode()
                    self.block = ((name, offset), [x.rsplit("\t", 3) for x in text.split("\n")])
                lines = self.block[1]
                k = bisect_left(lines, [key])
                while k < len(lines) and lines[k][0] == key:
                    yield lines[k][1], int(lines[k][2]), int(lines[k][3])
                    k += 1

    def record(self, file: str, offset: int, length: int) -> dict:
        fs, root = self.archives
        return read_record(self._range(fs, f"{root}/{file}", offset, length))


RECORDS = T.StructType(
    [
        T.StructField(n, t)
        for n, t in (
            ("page_id", T.LongType()), ("url", T.StringType()), ("record_type", T.StringType()), ("payload_bytes", T.LongType()),
            ("payload_digest", T.StringType()), ("refers_to", T.LongType()), ("payload", T.BinaryType()),
        )
    ]
)


def lookup(keys: DataFrame, parts: DataFrame, index: str, archives: str, payload: bool = True) -> DataFrame:
    """The records of every distinct ``key`` of ``keys``, found through the index.

    Keys are sorted into ranges, so a task's bisections stay within few directories and blocks. The
    part list (one row per task that wrote the index) goes to every task; directories and blocks
    are read as needed.
    """
    known = keys.sparkSession.sparkContext.broadcast([tuple(r) for r in parts.select("first", "last", "file").collect()])
    schema = RECORDS if payload else T.StructType(RECORDS.fields[:-1])
    rows = keys.select("key").distinct().repartitionByRange("key").sortWithinPartitions("key")
    arrow = [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())]
    arrow = pa.schema(arrow + [("payload", pa.binary())] * payload)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader(index, archives, known.value)
        for b in batches:
            out, size = [], 0
            for key in b.column("key").to_pylist():
                for where in reader.captures(key):
                    r = reader.record(*where)
                    out.append({n: r[n] for n in arrow.names})
                    size += r["payload_bytes"] if payload else 100
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(out, arrow)
                        out, size = [], 0
            yield pa.RecordBatch.from_pylist(out, arrow)

    return rows.mapInArrow(run, schema)


def archive(pages: DataFrame) -> tuple[DataFrame, str, str]:
    """Write ``pages`` (page_id, url, html) and their index into the shared folder: (parts, index, archives).

    Null html is an empty payload, a null url an empty key; rows that repeat are records that repeat.
    """
    spark = pages.sparkSession
    archives, index = (qualified(spark, scratch_path(spark, x)) for x in ("warc", "warc-index"))
    return build_index(write_archives(pages, archives), index), index, archives
