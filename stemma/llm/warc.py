"""WARC archives packaged as ZIP, written from pages and read back by ranges.

Writing: pages with equal payloads are found by digest; the one with the smallest id becomes a response record, the
others revisit records that carry no payload. Each task packs its records into archives of about ARCHIVE_BYTES: a ZIP
with a stored WARC member, its records packed each by itself if gzip is asked, and a stored CDXJ index. Reading: the end
of central directory is located in the archive's tail, ZIP64 records are followed where there are any, the central
directory gives the members, their local headers give the data's place, and each record named by an index member (any
below indexes/, plain or gzip) is read by its range from the stored member below archive/ that the index names; nothing is
extracted.

Archives are rows (name, content), so Spark's own writers and readers move them to and from any store. unpack_files reads
archives that lie in a folder as files: Spark lists them, and each is opened once and read by ranges, never whole.

Null html is an empty payload; a very long one is one record, which may make its archive longer than usual; null urls have no target header and read back as null; null ids lose against all others.
The target header has a url's control characters and white space percent-encoded; the index has the url itself.
Of rows that agree in id and payload one is the response. Payloads shorter than least_bytes are never revisits.
Truncated or compressed members and damaged directories are errors, not skipped. Other columns may have any names.
"""

from __future__ import annotations

import base64
import gzip as zipped
import hashlib
import json
import os
import struct
import urllib.parse
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stemma.llm.bit_filter import BitFilter
from stemma.llm.common import pieces, workers_find_package
from stemma.sources.shared import materialize

ARCHIVE_BYTES = 16 << 20
ARCHIVE, INDEXES, WARC_NAME = "archive/", "indexes/", "data.warc"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Signatures of the ZIP format.
LOCAL, CENTRAL, END, END64, LOCATOR64 = b"PK\3\4", b"PK\1\2", b"PK\5\6", b"PK\6\6", b"PK\6\7"
BIG, MANY = 0xFFFFFFFF, 0xFFFF


def pack_zip(members: list[tuple[str, bytes]], zip64: bool = False) -> bytes:
    """A ZIP of stored members; zip64: with 64-bit sizes and offsets even where 32 bits would do."""
    import zlib

    out, central = bytearray(), bytearray()
    for name, data in members:
        at, raw, crc = len(out), name.encode(), zlib.crc32(data)
        large = zip64 or max(len(data), at) >= BIG
        size = BIG if large else len(data)
        extra = struct.pack("<HHQQ", 1, 16, len(data), len(data)) if large else b""
        out += LOCAL + struct.pack("<HHHHHIIIHH", 45 if large else 20, 0x800, 0, 0, 0x21, crc, size, size, len(raw), len(extra)) + raw + extra + data
        extra = struct.pack("<HHQQQ", 1, 24, len(data), len(data), at) if large else b""
        central += CENTRAL + struct.pack("<HHHHHHIIIHHHHHII", 45, 45 if large else 20, 0x800, 0, 0, 0x21, crc, size, size, len(raw), len(extra), 0, 0, 0, 0, BIG if large else at) + raw + extra
    at, large = len(out), zip64 or len(out) >= BIG or len(members) >= MANY
    out += central
    if large:
        end = len(out)
        out += END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, len(members), len(members), len(central), at)
        out += LOCATOR64 + struct.pack("<IQI", 0, end, 1)
    n = MANY if large else len(members)
    out += END + struct.pack("<HHHHIIH", 0, 0, n, n, BIG if large else len(central), BIG if large else at, 0)
    return bytes(out)


@dataclass
class Member:
    name: str
    size: int
    stored: bool
    header: int


class RangeZip:
    """A ZIP's members by range reads: read(offset, length) is all that it needs."""

    def __init__(self, size: int, read: Callable[[int, int], bytes]):
        self.read = read
        tail_at = max(0, size - 22 - MANY)
        tail = read(tail_at, size - tail_at)
        found = len(tail)
        while True:  # a comment may hold the signature: the right one's comment ends with the file
            found = tail.rfind(END, 0, found)
            if found < 0:
                raise ValueError("no end of central directory")
            if len(tail) - found >= 22 and found + 22 + struct.unpack_from("<H", tail, found + 20)[0] == len(tail):
                break
        count, length, start = struct.unpack_from("<HII", tail, found + 10)
        locator = tail_at + found - 20
        if locator >= 0 and (raw := read(locator, 20))[:4] == LOCATOR64:
            end64 = read(struct.unpack_from("<Q", raw, 8)[0], 56)
            if end64[:4] != END64:
                raise ValueError("no ZIP64 end of central directory")
            count, length, start = struct.unpack_from("<QQQ", end64, 32)
        elif MANY == count or BIG in (length, start):
            raise ValueError("no ZIP64 locator")
        self.members = dict(self._directory(read(start, length), count))

    @staticmethod
    def _directory(raw: bytes, count: int) -> Iterator[tuple[str, Member]]:
        at = 0
        for _ in range(count):
            if raw[at : at + 4] != CENTRAL:
                raise ValueError("damaged central directory")
            method, = struct.unpack_from("<H", raw, at + 10)
            packed, size, n, m, k = struct.unpack_from("<IIHHH", raw, at + 20)
            header, = struct.unpack_from("<I", raw, at + 42)
            name = raw[at + 46 : at + 46 + n].decode()
            extra = raw[at + 46 + n : at + 46 + n + m]
            while len(extra) >= 4:
                tag, width = struct.unpack_from("<HH", extra)
                if tag == 1:  # holds those of size, packed size and offset that are marked, in this order
                    values = iter(struct.unpack_from(f"<{width // 8}Q", extra, 4))
                    size = next(values) if size == BIG else size
                    packed = next(values) if packed == BIG else packed
                    header = next(values) if header == BIG else header
                extra = extra[4 + width :]
            yield name, Member(name, size, method == 0 and packed == size, header)
            at += 46 + n + m + k

    def start(self, name: str) -> int:
        """Where the data of a stored member begins in the archive."""
        member = self.members[name]
        if not member.stored:
            raise ValueError(f"{name} is compressed")
        head = self.read(member.header, 30)
        if head[:4] != LOCAL:
            raise ValueError(f"no local header for {name}")
        return member.header + 30 + sum(struct.unpack_from("<HH", head, 26))

    def member(self, name: str) -> bytes:
        return self.read(self.start(name), self.members[name].size)


def _fields(head: bytes) -> dict[str, str]:
    return dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:] if ": " in line)


def _written(url: str) -> str:
    return "".join(urllib.parse.quote(c, errors="surrogatepass") if c.isspace() or not c.isprintable() else c for c in url)


def _record(kind: str, page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:x-page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    lines += [] if url is None else [f"WARC-Target-URI: {_written(url)}"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response"]
    lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:x-page:{'' if refers_to is None else refers_to}>"] * (kind == "revisit")
    return "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def decide(pages: DataFrame, html: str = "html", page_id: str = "page_id", least_bytes: int = 0) -> DataFrame:
    """pages' rows as (page_id, url-less) struct columns __row, with __type and __refers_to."""
    payload = F.coalesce(F.col(html), F.lit(""))
    narrow = pages.select(F.sha1(payload).alias("digest"), F.col(page_id).alias("id"), F.octet_length(payload).alias("n")).where(F.col("n") >= least_bytes)
    per_id = narrow.groupBy("digest", "id").agg(F.count(F.lit(1)).alias("ties"))
    order = F.struct(F.col("id").isNull().alias("null"), F.col("id").alias("id"), F.col("ties").alias("ties"))
    firsts = per_id.groupBy("digest").agg(F.min(order).alias("first"), F.sum("ties").alias("copies")).where("copies > 1")
    firsts = materialize(firsts.select("digest", F.col("first.id").alias("first"), "first.ties"), "warc_payloads")
    rows = pages.select(F.struct("*").alias("__row"), F.sha1(payload).alias("digest"), F.col(page_id).alias("id"))
    # Only pages whose payload has copies move. Too many payloads with copies for a filter: all pages meet them, once.
    copied = BitFilter(firsts, "digest")
    hits, alone = (rows, None) if copied.exact else copied.split(rows, "digest")
    met = hits.join(firsts, "digest", "left")
    is_first = F.col("ties").isNull() | F.col("id").eqNullSafe(F.col("first"))
    plain = met.where(~(is_first & (F.coalesce("ties", F.lit(1)) > 1)))
    done = plain.select("__row", F.when(is_first, "response").otherwise("revisit").alias("__type"), F.when(~is_first, F.col("first")).alias("__refers_to"))
    if not firsts.where("ties > 1").isEmpty():
        place = F.row_number().over(Window.partitionBy("digest", "id").orderBy(F.lit(1)))
        tied = met.where(is_first & (F.col("ties") > 1)).withColumn("place", place)
        done = done.union(tied.select("__row", F.when(F.col("place") == 1, "response").otherwise("revisit"), F.when(F.col("place") > 1, F.col("first"))))
    return done if alone is None else done.union(alone.select("__row", F.lit("response"), F.lit(None).cast(pages.schema[page_id].dataType)))


def pack(pages: DataFrame, html: str = "html", page_id: str = "page_id", url: str = "url", archive_bytes: int = ARCHIVE_BYTES, zip64: bool = False, least_bytes: int = 0, gzip: bool = False) -> DataFrame:
    """Archives (name, content) that hold a record for each row of pages."""
    workers_find_package(pages.sparkSession)
    decided = decide(pages, html, page_id, least_bytes)
    rows = decided.select(F.col(f"__row.`{page_id}`").cast("string").alias("id"), F.col(f"__row.`{url}`").alias("url"), F.col(f"__row.`{html}`").alias("html"), "__type", F.col("__refers_to").cast("string").alias("__refers_to"))

    def write(batches):
        part, made = TaskContext.get().partitionId(), 0
        warc, index = bytearray(), []
        named = WARC_NAME + ".gz" * gzip

        def archive():
            nonlocal made
            name = f"part-{part:06d}-{made:04d}.wacz"
            content = pack_zip([(ARCHIVE + named, bytes(warc)), (INDEXES + "index.cdxj", "\n".join(index).encode("utf-8", "surrogatepass"))], zip64)
            made += 1
            warc.clear()
            index.clear()
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([content], pa.binary())], names=["name", "content"])

        for batch in (part for whole in batches for part in pieces(whole)):
            for i, link, body, kind, refers in zip(*(batch.column(n).to_pylist() for n in ("id", "url", "html", "__type", "__refers_to"))):
                payload = (body or "").encode("utf-8", "surrogatepass")
                digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                record = _record(kind, i, link, payload, digest, refers)
                record = zipped.compress(record, 6, mtime=0) if gzip else record
                about = {"url": link, "digest": f"sha1:{digest}", "mime": "text/html", "filename": named, "offset": len(warc), "length": len(record)}
                index.append(f"{digest} {DATE[:4]}0101000000 {json.dumps(about)}")
                warc.extend(record)
                if len(warc) >= archive_bytes:
                    yield archive()
        if index:
            yield archive()

    return rows.mapInArrow(write, "name string, content binary")


def _unzipped(raw: bytes) -> bytes:
    return zipped.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw


def read_records(size: int, read: Callable[[int, int], bytes]) -> Iterator[dict]:
    """The records of one archive, in the order of its index."""
    archive = RangeZip(size, read)
    indexes = sorted(n for n in archive.members if n.startswith(INDEXES) and n.removesuffix(".gz").endswith((".cdx", ".cdxj")))
    if not indexes:
        raise ValueError("no index of records")
    starts: dict[str, int] = {}
    for line in (line for n in indexes for line in _unzipped(archive.member(n)).decode("utf-8", "surrogatepass").split("\n")):
        if "{" not in line:  # blank, or a header
            continue
        about = json.loads(line[line.index("{") :])
        member = about["filename"] if about["filename"] in archive.members else ARCHIVE + about["filename"]
        if member not in archive.members:
            raise ValueError(f"the index names {about['filename']}, which is no member")
        if member not in starts:
            starts[member] = archive.start(member)
        at, length = int(about["offset"]), int(about["length"])
        if at + length > archive.members[member].size:
            raise ValueError("the index points beyond its member")
        raw = _unzipped(read(starts[member] + at, length))
        head, _, rest = raw.partition(b"\r\n\r\n")
        warc = _fields(head)
        block = rest[: int(warc["Content-Length"])]
        http, _, payload = block.partition(b"\r\n\r\n")
        n = int(_fields(http)["Content-Length"])
        digest = warc["WARC-Payload-Digest"].removeprefix("sha1:")
        full = warc["WARC-Type"] == "response"
        if full and (len(payload) != n or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
            raise ValueError(f"a payload doesn't fit its record {warc['WARC-Record-ID']}")
        link = warc.get("WARC-Target-URI")
        page = lambda x: x[len("<urn:x-page:") : -1] or None
        yield {"page_id": page(warc["WARC-Record-ID"]), "url": about.get("url", link), "payload_bytes": n, "payload_digest": digest,
               "record_type": warc["WARC-Type"], "refers_to": page(warc["WARC-Refers-To"]) if "WARC-Refers-To" in warc else None, "payload": payload if full else None}


FIELDS = {"page_id": pa.string(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.string(), "payload": pa.binary()}


def _batches(found: Iterator[dict], payloads: bool) -> Iterator[pa.RecordBatch]:
    """Records in batches of bounded size."""
    rows = lambda held: pa.RecordBatch.from_arrays([pa.array([x[n] for x in held], kind) for n, kind in FIELDS.items()], names=list(FIELDS))
    held, size = [], 0
    for record in found:
        held.append(record if payloads else record | {"payload": None})
        size += len(held[-1]["payload"] or b"")
        if size > ARCHIVE_BYTES or len(held) > 10_000:
            yield rows(held)
            held, size = [], 0
    if held:
        yield rows(held)


RECORD = "page_id string, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to string, payload binary"


def unpack(archives: DataFrame, content: str = "content", payloads: bool = True) -> DataFrame:
    """The records of archives: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload (null for
    revisits, or for all if payloads is false)."""
    workers_find_package(archives.sparkSession)

    def read(batches):
        for batch in batches:
            for cell in batch.column(0):
                whole = memoryview(cell.as_buffer())
                yield from _batches(read_records(len(whole), lambda at, n: bytes(whole[at : at + n])), payloads)

    return archives.select(content).mapInArrow(read, RECORD)


def unpack_files(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of the archives that lie as files in a folder of any store that workers can open by its address. Only
    names and lengths pass through Spark."""
    workers_find_package(spark)
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.wacz").load(path).select("path", "length")

    def read(batches):
        from pyarrow import fs

        for batch in batches:
            for where, size in zip(batch.column("path").to_pylist(), batch.column("length").to_pylist()):
                store, name = fs.FileSystem.from_uri(where if "://" in where else where.replace("file:/", "file:///", 1))
                with store.open_input_file(name) as f:
                    yield from _batches(read_records(size, lambda at, n: f.read_at(n, at)), payloads)

    return listed.mapInArrow(read, RECORD)


def export(archives: DataFrame, folder: str) -> None:
    """Writes archives as files into a folder that all executors have mounted; a retried task writes the same files."""
    def write(batches):
        for batch in batches:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist()):
                part = os.path.join(folder, f".{name}.{TaskContext.get().taskAttemptId()}")
                with open(part, "wb") as f:
                    f.write(content)
                os.replace(part, os.path.join(folder, name))
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    archives.select("name", "content").mapInArrow(write, "n bigint").count()
