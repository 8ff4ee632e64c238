"""WARC records in ZIP packages, read by range without extraction.

``write_packages`` stores each page as a gzip member of a WARC file; the WARC file, its CDXJ index (sorted by
reversed host and path, then time) and a description are *stored* (uncompressed) members of a ZIP archive, so
that an offset in the index plus the member's own offset is an offset in the archive. ``ZipDirectory`` parses
the end record, the ZIP64 end record and locator and the central directory from range reads;
``read_packages`` follows the index to each record and reads just its range.

A record's id is unique (a name-based UUID of the folder, the task and the position, so that a task that runs again
gives the same); the page's own id is a field of its own, and a revisit names the page, address and time of its response.

Of records with equal payloads of at least ``min_revisit_bytes``, those with the smallest page id are
responses and the others revisits that name it. Digests are grouped with partial aggregation; the
join that brings each page its response's id is a sort-merge join on the digest that adaptive
execution splits where one payload is very frequent.

Edge cases: null or empty html is an empty payload; payloads below the limit are always responses;
a null page id is never the one referred to, unless all of a group are null, and then all are
responses; rows that repeat the smallest page id are all responses; an empty table gives no archive; a null or
malformed address is kept as it is (line ends become blanks) and indexed by its own text; a page of any length
is one record, held whole by its task (a package closes once it exceeds ``package_bytes``); further columns are
ignored, whatever their names.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import struct
import uuid
import zlib
from datetime import UTC, datetime
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.shared import ByteStore, read_at, shared_dir, written

#: Fixed values of the ZIP format.
LOCAL, CENTRAL, END, END64, LOCATOR64 = 0x04034B50, 0x02014B50, 0x06054B50, 0x06064B50, 0x07064B50
_NOT32, _NOT16, _ZIP64_EXTRA = 0xFFFFFFFF, 0xFFFF, 1

WARC_MEMBER, INDEX_MEMBER, ABOUT_MEMBER = "archive/data.warc.gz", "indexes/index.cdxj", "datapackage.json"
MANIFEST_SCHEMA = "package string, n_records bigint"
RECORD_SCHEMA = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string, payload binary"


class ZipDirectoryWriter:
    """A ZIP archive of stored members in memory. With ``zip64`` all sizes and offsets are ZIP64 fields."""

    def __init__(self, zip64: bool = True):
        self.out, self.entries, self.zip64 = io.BytesIO(), [], zip64

    def _extra(self, *values: int) -> bytes:
        return struct.pack(f"<HH{len(values)}Q", _ZIP64_EXTRA, 8 * len(values), *values) if self.zip64 else b""

    def add(self, name: str, data: bytes) -> None:
        raw, at, crc = name.encode(), self.out.tell(), zlib.crc32(data)
        size = _NOT32 if self.zip64 else len(data)
        extra = self._extra(len(data), len(data))
        self.out.write(struct.pack("<IHHHHHIIIHH", LOCAL, 45, 0x800, 0, 0, 0x21, crc, size, size, len(raw), len(extra)) + raw + extra + data)
        self.entries.append((raw, crc, len(data), at))

    def close(self) -> bytes:
        start = self.out.tell()
        for raw, crc, size, at in self.entries:
            extra = self._extra(size, size, at)
            s, o = (_NOT32, _NOT32) if self.zip64 else (size, at)
            self.out.write(struct.pack("<IHHHHHHIIIHHHHHII", CENTRAL, 45, 45, 0x800, 0, 0, 0x21, crc, s, s, len(raw), len(extra), 0, 0, 0, 0, o) + raw + extra)
        end, n = self.out.tell(), len(self.entries)
        if self.zip64:
            self.out.write(struct.pack("<IQHHIIQQQQ", END64, 44, 45, 45, 0, 0, n, n, end - start, start))
            self.out.write(struct.pack("<IIQI", LOCATOR64, 0, end, 1))
            self.out.write(struct.pack("<IHHHHIIH", END, 0, 0, _NOT16, _NOT16, _NOT32, _NOT32, 0))
        else:
            self.out.write(struct.pack("<IHHHHIIH", END, 0, 0, n, n, end - start, start, 0))
        return self.out.getvalue()


class ZipDirectory:
    """Members of a ZIP archive behind an open handle: name -> (compression, stored size, offset of the local header)."""

    def __init__(self, handle):
        self.handle = handle
        size = handle.size()
        tail_at = max(0, size - 22 - 65535 - 20)
        tail = read_at(handle, tail_at, size - tail_at)
        at = tail.rfind(struct.pack("<I", END))
        # the record ends where its comment does; a signature within the comment doesn't
        while at >= 0 and (at + 22 > len(tail) or at + 22 + struct.unpack("<H", tail[at + 20 : at + 22])[0] != len(tail)):
            at = tail.rfind(struct.pack("<I", END), 0, at + 3)
        if at < 0:
            raise ValueError("no end record: not a ZIP archive")
        n, length, start = struct.unpack("<HII", tail[at + 10 : at + 20])
        if (n == _NOT16 or length == _NOT32 or start == _NOT32) and at >= 20 and tail[at - 20 : at - 16] == struct.pack("<I", LOCATOR64):
            (where,) = struct.unpack("<Q", tail[at - 12 : at - 4])
            end64 = read_at(handle, where, 56)
            if struct.unpack("<I", end64[:4])[0] != END64:
                raise ValueError("the ZIP64 end record is damaged")
            n, length, start = struct.unpack("<QQQ", end64[32:56])
        self.members: dict[str, tuple[int, int, int]] = {}
        directory, p = read_at(handle, start, length), 0
        for _ in range(n):
            mark, method, packed, plain, n_name, n_extra, n_note, offset = struct.unpack("<I6xH8xIIHHH8xI", directory[p : p + 46])
            if mark != CENTRAL:
                raise ValueError("the central directory is damaged")
            name = directory[p + 46 : p + 46 + n_name].decode()
            extra, q = directory[p + 46 + n_name : p + 46 + n_name + n_extra], 0
            while q + 4 <= len(extra):
                kind, m = struct.unpack("<HH", extra[q : q + 4])
                if kind == _ZIP64_EXTRA:  # holds, in this order, those fields that don't fit
                    wide = iter(struct.unpack(f"<{m // 8}Q", extra[q + 4 : q + 4 + m // 8 * 8]))
                    plain = next(wide) if plain == _NOT32 else plain
                    packed = next(wide) if packed == _NOT32 else packed
                    offset = next(wide) if offset == _NOT32 else offset
                q += 4 + m
            self.members[name] = (method, packed, offset)
            p += 46 + n_name + n_extra + n_note

    def locate(self, name: str) -> tuple[int, int]:
        """Offset and length of a stored member's own bytes in the archive."""
        method, packed, offset = self.members[name]
        if method != 0:
            raise ValueError(f"{name} isn't stored, so it has no ranges")
        head = read_at(self.handle, offset, 30)
        n_name, n_extra = struct.unpack("<HH", head[26:30])
        return offset + 30 + n_name + n_extra, packed

    def read(self, name: str) -> bytes:
        return read_at(self.handle, *self.locate(name))


def url_key(url: str) -> str:
    """The sort key of an address in the index: reversed host, then path and query, in lower case and without blanks."""
    try:
        parts = urlsplit(url.strip())
        host = (parts.hostname or "").removeprefix("www.")
    except ValueError:
        host = ""
    if not host:
        return "".join(url.split()).lower() or "-"
    path = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return "".join((",".join(reversed(host.split("."))) + ")" + path).split()).lower()


def one_line(url: str | None) -> str:
    return (url or "").replace("\r", " ").replace("\n", " ")


def warc_record(record_id: str, page_id, url: str | None, payload: bytes, digest: str, refers_to, date: str, refers_url: str | None = None) -> bytes:
    """One record as a gzip member; a revisit (``refers_to``: its response's page id) has no block."""
    fields = [
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:uuid:{record_id}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {one_line(url)}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Payload-Length: {len(payload)}",
        f"WARC-Page-ID: {'' if page_id is None else page_id}",
        "Content-Type: text/html",
    ]
    if refers_to is not None:
        fields += [
            f"WARC-Refers-To-Page-ID: {refers_to}", f"WARC-Refers-To-Target-URI: {one_line(refers_url)}", f"WARC-Refers-To-Date: {date}",
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
        ]
    block = payload if refers_to is None else b""
    head = "\r\n".join(["WARC/1.1", *fields, f"Content-Length: {len(block)}", "", ""])
    return gzip.compress(head.encode() + block + b"\r\n\r\n", 1, mtime=0)


def parse_record(member: bytes) -> tuple[dict[str, str], bytes]:
    """Fields and block of a record."""
    data = gzip.decompress(member)
    at = data.index(b"\r\n\r\n")
    version, *lines = data[:at].decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines)
    n = int(fields["Content-Length"])
    return fields, data[at + 4 : at + 4 + n]


def with_revisits(pages: DataFrame, min_revisit_bytes: int = 100) -> DataFrame:
    """pages (page_id, url, html) with digest, refers_to (null: a response) and refers_url."""
    p = pages.selectExpr("cast(page_id as bigint) page_id", "cast(url as string) url", "coalesce(cast(html as string), '') html")
    p = p.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    large = F.octet_length("html") >= min_revisit_bytes
    named = F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))
    firsts = p.filter(large).groupBy("digest").agg(F.min(named).alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url"))
    j = p.join(firsts, "digest", "left")
    revisit = large & F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return j.select("page_id", "url", "html", "digest", *(F.when(revisit, F.col(c)).alias(n) for c, n in (("first_id", "refers_to"), ("first_url", "refers_url"))))


def write_packages(pages: DataFrame, root: str, package_bytes: int = 16 << 20, zip64: bool = True, min_revisit_bytes: int = 100, date: str | None = None) -> DataFrame:
    """Manifest (MANIFEST_SCHEMA) of the archives written below ``root``; lazy, to be written before use.

    ``date``: the records' time as in 2024-01-31T12:00:00Z; None: now."""
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    stamp = "".join(c for c in date if c.isdigit())[:14]

    def pack(batches):
        store, done, n = ByteStore(root), [], 0
        task = TaskContext.get().partitionId()

        def close(body: io.BytesIO, index: list[str]) -> None:
            package = ZipDirectoryWriter(zip64)
            package.add(WARC_MEMBER, body.getvalue())
            package.add(INDEX_MEMBER, "".join(sorted(index)).encode())
            package.add(ABOUT_MEMBER, b'{"profile": "data-package", "resources": ["%s", "%s"]}' % (WARC_MEMBER.encode(), INDEX_MEMBER.encode()))
            name = f"package-{uuid.uuid4().hex}.zip"
            store.put(name, package.close())
            done.append((name, len(index)))

        body, index = io.BytesIO(), []
        for batch in batches:
            for page_id, url, html, digest, refers_to, refers_url in zip(*(c.to_pylist() for c in batch.columns)):
                record_id = str(uuid.uuid5(uuid.NAMESPACE_URL, f"{root}/{task}/{n}"))
                n += 1
                record = warc_record(record_id, page_id, url, html.encode(), digest, refers_to, date, refers_url)
                about = {"url": one_line(url), "mime": "text/html" if refers_to is None else "warc/revisit", "digest": f"sha256:{digest}", "length": len(record), "offset": body.tell(), "filename": WARC_MEMBER}
                index.append(f"{url_key(one_line(url))} {stamp} {json.dumps(about)}\n")
                body.write(record)
                if body.tell() >= package_bytes:
                    close(body, index)
                    body, index = io.BytesIO(), []
        if index:
            close(body, index)
        names, counts = zip(*done) if done else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(counts, pa.int64())], names=["package", "n_records"])

    return with_revisits(pages, min_revisit_bytes).mapInArrow(pack, MANIFEST_SCHEMA)


def read_packages(manifest: DataFrame, root: str, with_payload: bool = False) -> DataFrame:
    """Rows of RECORD_SCHEMA, a range read a record; payloads of responses are checked against their digest."""

    def read(batches):
        store = ByteStore(root)
        for batch in batches:
            for package in batch.column(0).to_pylist():
                handle = store.open(package)
                zipped, out = ZipDirectory(handle), []
                base, _ = zipped.locate(WARC_MEMBER)
                for line in zipped.read(INDEX_MEMBER).splitlines():
                    about = json.loads(line.split(b" ", 2)[2])
                    fields, block = parse_record(read_at(handle, base + int(about["offset"]), int(about["length"])))
                    kind = fields["WARC-Type"]
                    stored = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                    if f"sha256:{stored}" != about["digest"] or kind == "response" and hashlib.sha256(block).hexdigest() != stored:
                        raise ValueError(f"{package}: a record doesn't match its digest")
                    ids = [fields.get(k, "") for k in ("WARC-Page-ID", "WARC-Refers-To-Page-ID")]
                    n = len(block) if kind == "response" else int(fields["WARC-Payload-Length"])
                    out.append((int(ids[0]) if ids[0] else None, n, stored, kind, int(ids[1]) if ids[1] else None, fields["WARC-Target-URI"], block if with_payload else None))
                handle.close()
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=[x.split()[0] for x in RECORD_SCHEMA.split(", ")])

    return manifest.select("package").mapInArrow(read, RECORD_SCHEMA)


def warc_round_trip(pages: DataFrame, package_bytes: int = 16 << 20) -> DataFrame:
    """Write, commit the manifest, spread the archives over the tasks, read back."""
    spark = pages.sparkSession
    root = shared_dir(spark, "warc")
    manifest = written(write_packages(pages, root, package_bytes), "warc-manifest")
    return read_packages(manifest.repartition(max(1, spark.sparkContext.defaultParallelism), F.xxhash64("package")), root)
