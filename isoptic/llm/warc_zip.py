"""WARC records in ZIP packages.

A package is a ZIP file of stored members: WARC files, each record compressed
on its own, and an index of the records. The reader finds the members by the
central directory (ZIP64 included), reads the index, and then only the byte
ranges of records; nothing is extracted. Packages are reached by pyarrow's file
systems, so they can lie in a local, HDFS or object store that all executors see.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .skew import SALTS, salted_join, tasks
from .store import keep, make_dir

MIN_PAYLOAD = 1000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URN = "urn:isoptic:page:"
#: Bytes of WARC in one member, and of records that are read at a time.
MEMBER_BYTES, CHUNK_BYTES = 64 << 20, 1 << 20
#: Packages of which one task reads the indexes, and bytes of packages to a task
#: that reads records.
PACKAGES, TASK_BYTES = 4, 16 << 20
_EOCD, _EOCD64, _LOCATOR, _CENTRAL, _LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:") or path.startswith("/"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


# Reading


@dataclass
class Member:
    name: str
    method: int
    header: int  # where its local header is
    size: int


def _central(read: Callable[[int, int], bytes], size: int) -> Iterator[Member]:
    tail_at = max(0, size - 65_557)  # the end record and the longest comment
    tail = read(tail_at, size - tail_at)
    at = tail.rfind(_EOCD, 0, max(0, len(tail) - 18))
    while at >= 0 and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail):
        at = tail.rfind(_EOCD, 0, at)  # these bytes can be part of the comment
    if at < 0:
        raise ValueError("not a ZIP file: no end of central directory")
    n, length, start = struct.unpack_from("<HII", tail, at + 10)
    locator = read(tail_at + at - 20, 20) if tail_at + at >= 20 else b""
    if locator[:4] == _LOCATOR:
        end = read(struct.unpack_from("<Q", locator, 8)[0], 56)
        if end[:4] != _EOCD64:
            raise ValueError("ZIP64 end record missing")
        n, length, start = struct.unpack_from("<QQQ", end, 32)
    block, at = read(start, length), 0
    for _ in range(n):
        if block[at : at + 4] != _CENTRAL:
            raise ValueError("damaged central directory")
        flags, method = struct.unpack_from("<HH", block, at + 8)
        packed, plain, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", block, at + 20)
        header = struct.unpack_from("<I", block, at + 42)[0]
        name = block[at + 46 : at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra, k = block[at + 46 + n_name : at + 46 + n_name + n_extra], 0
        while k + 4 <= len(extra):
            kind, long = struct.unpack_from("<HH", extra, k)
            if kind == 1:  # holds, in this order, those that overflowed
                wide = list(struct.unpack_from(f"<{long // 8}Q", extra, k + 4))
                plain = wide.pop(0) if plain == 0xFFFFFFFF else plain
                packed = wide.pop(0) if packed == 0xFFFFFFFF else packed
                header = wide.pop(0) if header == 0xFFFFFFFF else header
            k += 4 + long
        yield Member(name, method, header, packed)
        at += 46 + n_name + n_extra + n_comment


def members(read: Callable[[int, int], bytes], size: int) -> dict[str, tuple[int, int]]:
    """Where the bytes of each stored member are: (offset, length) by name."""
    out = {}
    for m in _central(read, size):
        if m.method:
            continue  # a compressed member has no ranges to read
        head = read(m.header, 30)
        if head[:4] != _LOCAL:
            raise ValueError(f"no local header of {m.name}")
        n_name, n_extra = struct.unpack_from("<HH", head, 26)
        out[m.name] = (m.header + 30 + n_name + n_extra, m.size)
    return out


def _ranges(path: str, size: int, chunk: int) -> Iterator[tuple[int, int]]:
    """Offset and length of chunks of records, from the package's indexes."""
    system, name = _open(path)
    with system.open_input_file(name) as f:
        found = members(lambda at, n: f.read_at(n, at), size)
        for index, (at, n) in found.items():
            if not index.startswith("indexes/"):
                continue
            begin = end = None
            for line in f.read_at(n, at).splitlines():
                x = json.loads(line)
                base = found[f"archive/{x['filename']}"][0] + x["offset"]
                if begin is not None and (base != end or end + x["length"] - begin > chunk):
                    yield begin, end - begin
                    begin = None
                begin, end = base if begin is None else begin, base + x["length"]
            if begin is not None:
                yield begin, end - begin


def _records(raw: bytes) -> Iterator[tuple[dict[str, str], dict[str, str], bytes]]:
    """WARC headers, HTTP headers and payload of records that stand one after
    the other, each a gzip member."""
    while raw:
        d = zlib.decompressobj(31)
        block = d.decompress(raw) + d.flush()
        raw = d.unused_data
        head, _, rest = block.partition(b"\r\n\r\n")
        warc = _headers(head)
        http, _, payload = rest[: int(warc["content-length"])].partition(b"\r\n\r\n")
        yield warc, _headers(http), payload


def _headers(block: bytes) -> dict[str, str]:
    lines = block.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


RECORD = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def read_packages(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row for each record of the packages below ``path``.

    ``payload_bytes`` and ``payload_digest`` are taken from the payload; a
    revisit has none of its own and says them in its headers. Packages and
    then chunks of records are dealt out, to as many tasks as there are bytes
    for, so one large package is read by many tasks. An empty folder gives an
    empty result.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("path", "length")
    chunk = CHUNK_BYTES
    packages, size = files.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                got = list(_ranges(x["path"], x["length"], chunk))
                yield pa.record_batch([pa.array([x["path"]] * len(got), pa.string()), pa.array([a for a, _ in got], pa.int64()), pa.array([n for _, n in got], pa.int64())], names=["path", "at", "n"])

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                system, name = _open(x["path"])
                with system.open_input_file(name) as f:
                    rows = [_row(*r, with_payload) for r in _records(f.read_at(x["n"], x["at"]))]
                yield pa.RecordBatch.from_pylist(rows, SCHEMA)

    # A number given outright isn't packed into fewer tasks by the rows' bytes,
    # which say nothing of what is read for them.
    spread = files.repartition(tasks(packages, PACKAGES, 1), "path").mapInArrow(ranges, "path string, at long, n long")
    return spread.repartition(tasks(size, TASK_BYTES), "path", "at").mapInArrow(records, RECORD)


SCHEMA = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def _row(warc: dict[str, str], http: dict[str, str], payload: bytes, with_payload: bool) -> dict:
    own = warc["warc-type"] == "response"
    page, refers = (warc.get(k, "").strip("<>").removeprefix(URN) for k in ("warc-record-id", "warc-refers-to"))
    page = page.split(":")[0]
    return {
        "page_id": int(page) if page and page != "null" else None,
        "url": warc.get("warc-target-uri"),
        "record_type": warc["warc-type"],
        "payload_bytes": len(payload) if own else int(http["content-length"]),
        "payload_digest": hashlib.sha1(payload).hexdigest() if own else warc["warc-payload-digest"].removeprefix("sha1:"),
        "refers_to": int(refers) if refers else None,
        "payload": payload if own and with_payload else None,
    }


# Writing


def _record(page: int | None, url: str | None, payload: bytes, sha1: str, refers: int | None, level: int) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers is None else 'revisit'}", f"WARC-Record-ID: <{URN}{'null' if page is None else page}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}")
    lines.append(f"WARC-Payload-Digest: sha1:{sha1}")
    if refers is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{URN}{refers}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(lines).encode() + block + b"\r\n\r\n") + z.flush()


def revisits(pages: DataFrame, id_col: str, html: str, min_payload: int = MIN_PAYLOAD, salts: int = SALTS) -> DataFrame:
    """Id, payload's SHA-256 and ``refers_to`` of the pages that revisit another."""
    payload = F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")
    rows = keep(pages.select(F.col(id_col).alias("_id"), payload.alias("p")).where(F.octet_length("p") >= min_payload).select("_id", F.sha2("p", 256).alias("_sha")), "payloads")
    groups = rows.groupBy("_sha").agg(F.max("_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1").select("_sha", "refers_to")
    return salted_join(rows, groups, ["_sha"], ["_id"], how="inner", salts=salts).where("_id <> refers_to or _id is null").distinct()


def write_packages(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_payload: int = MIN_PAYLOAD, level: int = 4) -> int:
    """Write one record for each of ``pages`` in packages below ``path``; how many.

    Of equal payloads of at least ``min_payload`` bytes the one with the
    largest id is a response and the others revisit it. A null payload is
    empty. Rows that repeat an id are records of their own; if theirs is the
    largest, each is a response. A null id is written as such. A task writes
    its package under a name of the attempt and then renames it, so a repeated
    task replaces what a lost executor left. Tables without rows give no package.
    """
    payload = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    again = keep(revisits(pages, id_col, html_col, min_payload), "revisits")
    rows = pages.select(F.col(id_col).cast("long").alias("_id"), F.col(url_col).alias("url"), payload.alias("payload")).withColumn("_sha", F.sha2("payload", 256))
    rows = rows.join(again.select(F.col("_id").cast("long").alias("_i"), F.col("_sha").alias("_s"), F.col("refers_to").cast("long").alias("refers_to")), F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_sha") == F.col("_s")), "left")
    rows = rows.select("_id", "url", "payload", F.sha1("payload").alias("sha1"), "refers_to")

    make_dir(pages.sparkSession, path)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, context, package = 0, TaskContext.get(), None
        system, folder = _open(path)
        name = f"{folder}/pages-{context.partitionId():06d}.zip"
        attempt = f"{name}.{context.taskAttemptId()}"
        for batch in batches:
            if package is None and batch.num_rows:
                package = Package(system.open_output_stream(attempt))
            for page, url, body, sha1, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                package.add(page, _record(page, url, body, sha1, refers, level))
                n += 1
        if package is not None:
            package.close()
            system.move(attempt, name)
        yield pa.record_batch([pa.array([n], pa.int64())], names=["n"])

    return rows.mapInArrow(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


class Package:
    """Writes a ZIP file to a stream that only goes forward."""

    def __init__(self, stream) -> None:
        self.stream = stream
        self.zip = zipfile.ZipFile(stream, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.member, self.count, self.at, self.index = None, 0, 0, []

    def add(self, page: int | None, record: bytes) -> None:
        if self.member is None or self.at + len(record) > MEMBER_BYTES and self.at:
            self._end()
            self.name = f"data-{self.count:04d}.warc.gz"
            self.member = self.zip.open(zipfile.ZipInfo(f"archive/{self.name}"), "w", force_zip64=True)
        self.member.write(record)
        self.index.append(json.dumps({"page_id": page, "filename": self.name, "offset": self.at, "length": len(record)}))
        self.at += len(record)

    def _end(self) -> None:
        if self.member is not None:
            self.member.close()
            self.zip.writestr(zipfile.ZipInfo(f"indexes/index-{self.count:04d}.jsonl"), "\n".join(self.index) + "\n")
            self.member, self.count, self.at, self.index = None, self.count + 1, 0, []

    def close(self) -> None:
        self._end()
        self.zip.close()
        self.stream.close()
