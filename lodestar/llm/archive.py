"""Legacy archive converter: ARC (versions 1 and 2) to WARC.

``write_arc`` writes a table of pages as gzipped ARC files.  ``convert`` parses
their version block, the record lines of that version and the declared lengths,
and writes equivalent WARC files: a record id from the file, offset and url, an
ISO timestamp from the 14-digit date, a content type, and SHA-256 digests of
block and payload.  Equal payloads of at least MIN_REVISIT bytes are stored
once: the record with the smallest page id is the response, the others are
revisits of it with their HTTP headers only.  ``read_warc`` reads the WARC files
back.  Files are in the shared scratch folder, written and read through the
file system its address names; a task's files get an attempt's own names and
count only when the task's manifest rows are committed, so retried and
speculative tasks do no harm.

Results for odd input: null html is an empty payload; null url becomes
``urn:page:<id>``, spaces in urls are percent-encoded; a null page id comes back
null and is the last choice for a response; rows that share an id get a record
each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import time
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.base import lookup, query, read, store
from lodestar.session import scratch_path

MIN_REVISIT = 100
FILE_BYTES = 64 << 20          # payload bytes of one archive
EPOCH = 1_200_000_000          # pages carry no date: their archive date is EPOCH plus the id in seconds
FIELDS = {                     # fixed values: record line fields of the two versions
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
ID_HEADER, OF_HEADER = "X-Page-Id", "X-Refers-To-Page-Id"


def _open(uri: str):
    return pafs.FileSystem.from_uri(uri)


def _member(raw: bytes) -> bytes:
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def _inflate(stream):
    """Uncompressed pieces of a file of gzip members."""
    z = zlib.decompressobj(31)
    while chunk := stream.read(1 << 20):
        while chunk:
            yield z.decompress(chunk)
            chunk = z.unused_data
            if z.eof:
                z = zlib.decompressobj(31)


class _Reader:
    """Lines and declared lengths from pieces of bytes."""

    def __init__(self, pieces):
        self.pieces, self.buffer, self.offset = pieces, bytearray(), 0

    def _more(self) -> bool:
        piece = next(self.pieces, None)
        if piece is not None:
            self.buffer += piece
        return piece is not None

    def take(self, n: int) -> bytes:
        while len(self.buffer) < n:
            if not self._more():
                raise ValueError("archive ends inside a record")
        out = bytes(self.buffer[:n])
        del self.buffer[:n]
        self.offset += n
        return out

    def line(self) -> bytes | None:
        at = 0
        while (end := self.buffer.find(b"\n", at)) < 0:
            at = len(self.buffer)
            if not self._more():
                return self.take(len(self.buffer)) if self.buffer else None
        return self.take(end + 1).rstrip(b"\r\n")


class _Writer:
    """Archives of about FILE_BYTES in ``folder``; names are the attempt's own."""

    def __init__(self, folder: str, kind: str):
        self.fs, self.folder = _open(folder)
        self.fs.create_dir(self.folder, recursive=True)
        self.kind, self.out, self.done, self.made = kind, None, [], 0
        self.context = TaskContext.get()

    def start(self, head):
        name = f"{self.kind}-{self.context.partitionId():06d}-{self.context.taskAttemptId()}-{self.made:04d}.{self.kind}.gz"
        self.made, self.bytes, self.n, self.name = self.made + 1, 0, 0, name
        self.out = self.fs.open_output_stream(f"{self.folder}/{name}", compression=None)
        self.out.write(_member(head(name)))

    def add(self, raw: bytes, head):
        if self.out is None:
            self.start(head)
        self.out.write(_member(raw))
        self.bytes, self.n = self.bytes + len(raw), self.n + 1
        if self.bytes >= FILE_BYTES:
            self.close()

    def close(self):
        if self.out is not None:
            self.out.close()
            self.done.append((self.name, self.n))
            self.out = None

    def manifest(self):
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in self.done], pa.string()), pa.array([x[1] for x in self.done], pa.int64())],
                                          names=["name", "n"])


def _date(t: int) -> str:
    return time.strftime("%Y%m%d%H%M%S", time.gmtime(t))


def _arc_head(version: int):
    def head(name: str) -> bytes:
        block = f"{version} 0 lodestar\n{FIELDS[version]}\n".encode()
        middle = "200 - - 0 " + name + " " if version == 2 else ""
        return f"filedesc://{name} 0.0.0.0 {_date(EPOCH)} text/plain {middle}{len(block)}\n".encode() + block + b"\n"
    return head


def _write_arc(folder: str):
    def run(batches):
        version = 1 + TaskContext.get().partitionId() % 2      # both versions occur
        out, offset = _Writer(folder, "arc"), 0
        for batch in batches:
            for page, url, html in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                body = (html or "").encode()
                url = "%20".join((url or f"urn:page:{page}").split()) or f"urn:page:{page}"
                who = f"{ID_HEADER}: {page}\r\n" if page is not None else ""
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n{who}\r\n".encode()
                line = f"{url} 0.0.0.0 {_date(EPOCH + abs(page or 0) % (1 << 31))} text/html "
                if version == 2:
                    line += f"200 {zlib.crc32(body):08x} - {offset} {out.made} "
                raw = f"{line}{len(http) + len(body)}\n".encode() + http + body + b"\n"
                out.add(raw, _arc_head(version))
                offset += len(raw)
        out.close()
        yield out.manifest()
    return run


def parse_arc(pieces):
    """(offset, url, date, mime, block) of each record; the version block says
    which fields a record line has."""
    r = _Reader(pieces)
    first = r.line()
    if first is None:
        return
    if not first.startswith(b"filedesc://"):
        raise ValueError("no ARC version block")
    block = r.take(int(first.split(b" ")[-1])).decode()
    version = int(block.split(" ", 1)[0])
    names = FIELDS[version].split()
    while (offset := r.offset, line := r.line())[1] is not None:
        if not line:
            continue
        got = line.decode().split(" ")
        if len(got) != len(names):
            raise ValueError(f"record line of {len(got)} fields in a version {version} archive")
        field = dict(zip(names, got, strict=True))
        yield offset, field["URL"], field["Archive-date"], field["Content-type"], r.take(int(field["Archive-length"]))


def _http(block: bytes) -> tuple[bytes, dict[str, str], bytes]:
    head, _, body = block.partition(b"\r\n\r\n")
    lines = head.decode("latin-1").split("\r\n")[1:]
    return head + b"\r\n\r\n", dict(x.split(": ", 1) for x in lines if ": " in x), body


def _page(headers: dict, name: str):
    return int(headers[name]) if name in headers else None


def _records(folder: str):
    """ARC names to (name, idx, page_id, bytes, digest) rows."""
    def run(batches):
        fs, base = _open(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows = []
                with fs.open_input_stream(f"{base}/{name}", compression=None) as f:
                    for i, (_, _, _, _, block) in enumerate(parse_arc(_inflate(f))):
                        _, headers, body = _http(block)
                        rows.append((name, i, _page(headers, ID_HEADER), len(body), hashlib.sha256(body).hexdigest()))
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                    cols, (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["name", "idx", "page_id", "bytes", "digest"])
    return run


def _record_id(name: str, offset: int, url: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name}#{offset}#{url}')}>"


def _warc_record(kind: str, fields: dict[str, str], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields.items())
    return f"WARC/1.1\r\nWARC-Type: {kind}\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def _warc_head(name: str) -> bytes:
    block = b"format: WARC File Format 1.1\r\n"
    return _warc_record("warcinfo", {"WARC-Record-ID": _record_id(name, 0, "info"), "WARC-Date": "2008-01-10T21:20:00Z",
                                     "WARC-Filename": name, "Content-Type": "application/warc-fields"}, block)


def _convert(arcs: str, folder: str):
    def run(batches):
        fs, base = _open(arcs)
        out = _Writer(folder, "warc")
        for batch in batches:
            for name, revisits in zip(batch.column("name").to_pylist(), batch.column("revisits").to_pylist(), strict=True):
                of = {r["idx"]: r for r in revisits or []}
                with fs.open_input_stream(f"{base}/{name}", compression=None) as f:
                    for i, (offset, url, date, _mime, block) in enumerate(parse_arc(_inflate(f))):
                        http, headers, body = _http(block)
                        stored = http if i in of else block
                        fields = {
                            "WARC-Record-ID": _record_id(name, offset, url),
                            "WARC-Date": f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z",
                            "WARC-Target-URI": url, "Content-Type": "application/http;msgtype=response",
                            "WARC-Block-Digest": f"sha256:{hashlib.sha256(stored).hexdigest()}",
                            "WARC-Payload-Digest": f"sha256:{hashlib.sha256(body).hexdigest()}"}
                        if i in of:
                            fields["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
                            if of[i]["of_page"] is not None:
                                fields[OF_HEADER] = str(of[i]["of_page"])
                        out.add(_warc_record("revisit" if i in of else "response", fields, stored), _warc_head)
        out.close()
        yield out.manifest()
    return run


def parse_warc(pieces):
    """(headers, block) of each record."""
    r = _Reader(pieces)
    while (line := r.line()) is not None:
        if not line:
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("no WARC record")
        headers = {}
        while line := r.line():
            k, _, v = line.decode().partition(": ")
            headers[k] = v
        yield headers, r.take(int(headers["Content-Length"]))


def _read_warc(folder: str):
    def run(batches):
        fs, base = _open(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows = []
                with fs.open_input_stream(f"{base}/{name}", compression=None) as f:
                    for headers, block in parse_warc(_inflate(f)):
                        kind = headers["WARC-Type"]
                        if kind == "warcinfo":
                            continue
                        if f"sha256:{hashlib.sha256(block).hexdigest()}" != headers["WARC-Block-Digest"]:
                            raise ValueError(f"block digest of {headers['WARC-Record-ID']}")
                        _, http, body = _http(block)
                        digest = headers["WARC-Payload-Digest"].removeprefix("sha256:")
                        if kind == "response" and hashlib.sha256(body).hexdigest() != digest:
                            raise ValueError(f"payload digest of {headers['WARC-Record-ID']}")
                        size = len(body) if kind == "response" else int(http["Content-Length"])
                        rows.append((_page(http, ID_HEADER), size, digest, kind, _page(headers, OF_HEADER), headers["WARC-Record-ID"],
                                     headers["WARC-Target-URI"], headers["WARC-Date"]))
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 8
                types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)],
                                                 names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "url", "date"])
    return run


def _spread(manifest: DataFrame) -> DataFrame:
    """A file a task, as far as there are cores for it."""
    files = manifest.count()
    return manifest.repartition(max(1, min(files, 4 * manifest.sparkSession.sparkContext.defaultParallelism)), "name")


def write_arc(pages: DataFrame, folder: str) -> DataFrame:
    """Manifest (name, n) of the ARC files written for (page_id, url, html)."""
    return store(pages.select(F.col("page_id").cast("bigint"), "url", "html").mapInArrow(_write_arc(folder), "name string, n bigint"), "arc-manifest")


def convert(manifest: DataFrame, arcs: str, folder: str) -> DataFrame:
    """Manifest of the WARC files made from the ARC files."""
    records = store(_spread(manifest.select("name")).mapInArrow(
        _records(arcs), "name string, idx bigint, page_id bigint, bytes bigint, digest string"), "arc-records")
    large = records.where(F.col("bytes") >= MIN_REVISIT)
    rank = F.struct(F.col("page_id").isNull(), "page_id", "name", "idx")
    groups = large.groupBy("digest").agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("size")).where("size > 1")
    total = max(1, records.count())
    found = lookup(large, groups, "digest", "size", total, F.struct("name", "idx")).where("size is not null")
    found = found.where((F.col("name") != F.col("first.name")) | (F.col("idx") != F.col("first.idx")))
    revisits = found.groupBy("name").agg(F.collect_list(F.struct("idx", F.col("first.page_id").alias("of_page"))).alias("revisits"))
    work = _spread(store(manifest.select("name").join(revisits, "name", "left"), "arc-work"))
    return store(work.mapInArrow(_convert(arcs, folder), "name string, n bigint"), "warc-manifest")


def read_warc(manifest: DataFrame, folder: str) -> DataFrame:
    return _spread(manifest.select("name")).mapInArrow(
        _read_warc(folder), "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, "
                            "record_id string, url string, date string")


def round_trip(pages: DataFrame) -> DataFrame:
    spark = pages.sparkSession
    arcs, warcs = scratch_path(spark, "arc"), scratch_path(spark, "warc")
    return read_warc(convert(write_arc(pages, arcs), arcs, warcs), warcs)


@query("op7_arc_converter", f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
     f AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, sha256(html) AS payload_digest,
       CASE WHEN n >= {MIN_REVISIT} AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= {MIN_REVISIT} AND page_id <> first THEN first END AS refers_to
FROM f""")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(read(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
