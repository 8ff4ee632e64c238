"""Media columns: content-addressed payloads in tar shards.

``pack_media`` turns each text into 8-bit grey samples (a PNG image 64 samples wide), stores each
distinct image of a task once in tar shards under its SHA-256, and returns one index row per input
row: digest, shard, offset, length. ``probe_headers`` fills metadata columns from range reads of
the header alone; ``read_media`` reads the stored bytes, decodes them and computes features.

Texts are not shuffled: each task packs what it scans. Shards are written below the shared folder under names
that hold a token of the attempt; the index table is committed by Spark, so a lost task leaves at
most an unreferenced shard and the re-run writes its own. For the read-back the small index rows are dealt
by shard and range of ``range_bytes``, so that a task reads a bounded stretch of one shard, in order, whatever
the index's own files look like; rows of one member follow one another, and the task keeps only the last.

Edge cases: a null or empty text is the empty payload (64 zero bytes); a text of any length is one member, held
whole by its task; repeated rows and equal texts share one member per task (equal texts that different tasks
pack are stored once each, under the same digest) and give equal values; null ids are kept; an empty table gives
an empty index; further columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import io
import math
import struct
import tarfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.shared import ByteStore, read_at, shared_dir, written

#: Samples in a row of the image, and so the unit that payloads are padded to.
WIDTH = 64
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Signature and IHDR chunk: all that a header probe reads.
HEADER_BYTES = 33
_MAX_ROWS = 2**31 - 1

INDEX_SCHEMA = "doc_id bigint, n_bytes bigint, digest string, shard string, offset bigint, length bigint"
MEDIA_SCHEMA = (
    "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, "
    "media_bytes bigint, media_sha256 string, feature string, width int, height int, bit_depth int"
)
PROBE_SCHEMA = "doc_id bigint, digest string, width int, height int, bit_depth int, colour_type int"


def pad(payload: bytes) -> bytes:
    """Zeros appended up to a positive multiple of WIDTH."""
    return payload + bytes(max(WIDTH, -(-len(payload) // WIDTH) * WIDTH) - len(payload))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(payload: bytes, level: int = 1) -> bytes:
    """Lossless 8-bit grey PNG of a padded payload; filter 0 on every row."""
    height = len(payload) // WIDTH
    if not 0 < height <= _MAX_ROWS or len(payload) % WIDTH:
        raise ValueError("a payload holds a positive number of whole rows")
    rows = np.zeros((height, WIDTH + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(height, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, height, 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + _chunk(b"IEND", b"")


def parse_header(head: bytes) -> tuple[int, int, int, int]:
    """Width, height, bit depth and colour type of the first HEADER_BYTES of an image."""
    if head[:8] != _SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("not a stored image")
    return struct.unpack(">IIBB", head[16:26])


def decode_png(data: bytes) -> bytes:
    """The samples of an image that ``encode_png`` wrote."""
    width, height, _, _ = parse_header(data[:HEADER_BYTES])
    at, body = 8, []
    while at < len(data):
        (n,), kind = struct.unpack(">I", data[at : at + 4]), data[at + 4 : at + 8]
        if struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0] != zlib.crc32(data[at + 4 : at + 8 + n]):
            raise ValueError("a chunk is damaged")
        if kind == b"IDAT":
            body.append(data[at + 8 : at + 8 + n])
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, width + 1)
    return rows[:, 1:].tobytes()


def feature_of(payload: bytes) -> str:
    """Size, mean, entropy of the sample histogram and a 16-bin profile; a function of the samples alone."""
    counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    p = counts[counts > 0] / len(payload)
    mean = int((counts * np.arange(256)).sum()) / len(payload)
    profile = (counts.reshape(16, 16).sum(1) * 1000) // len(payload)
    return f"{WIDTH}x{len(payload) // WIDTH};mean={mean:.3f};entropy={max(0.0, float(-(p * np.log2(p)).sum())):.3f};profile={'-'.join(map(str, profile))}"


class _TarWriter:
    """Members under their digest, each once, in shards of about ``shard_bytes``."""

    def __init__(self, store: ByteStore, shard_bytes: int):
        self.store, self.limit, self.where, self.buffer = store, shard_bytes, {}, None

    def add(self, digest: str, media: bytes) -> tuple[str, int, int]:
        if digest not in self.where:
            if self.buffer is None:
                self.name, self.buffer = f"shard-{uuid.uuid4().hex}.tar", io.BytesIO()
                self.tar = tarfile.open(fileobj=self.buffer, mode="w", format=tarfile.USTAR_FORMAT)
            info = tarfile.TarInfo(f"{digest}.png")
            info.size = len(media)
            self.tar.addfile(info, io.BytesIO(media))
            end = self.tar.offset
            self.where[digest] = (self.name, end - -(-len(media) // tarfile.BLOCKSIZE) * tarfile.BLOCKSIZE, len(media))
            if end >= self.limit:
                self.flush()
        return self.where[digest]

    def flush(self) -> None:
        if self.buffer is not None:
            self.tar.close()
            self.store.put(self.name, self.buffer.getvalue())
            self.buffer = None


def pack_media(docs: DataFrame, root: str, shard_bytes: int = 32 << 20) -> DataFrame:
    """Index rows (INDEX_SCHEMA) of ``docs`` (doc_id, text); the shards are below ``root``.

    A task holds at most one shard and the digests of its own split. Its result is lazy and must be
    written before it is read more than once: each run packs anew.
    """

    def pack(batches):
        writer = _TarWriter(ByteStore(root), shard_bytes)
        known: dict[bytes, tuple] = {}
        ready: list = []
        for batch in batches:
            out = []
            for text in batch.column(1):
                raw = (text.as_py() or "").encode()
                key = hashlib.sha256(raw).digest()
                if key not in known:
                    media = encode_png(pad(raw))
                    digest = hashlib.sha256(media).hexdigest()
                    known[key] = (digest, *writer.add(digest, media))
                out.append((len(raw), *known[key]))
            cols = list(zip(*out)) if out else [[]] * 5
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
            ready.append(pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=_names(INDEX_SCHEMA)))
        writer.flush()  # index rows leave the task only once their shards are stored
        yield from ready

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").mapInArrow(pack, INDEX_SCHEMA)


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def probe_headers(index: DataFrame, root: str) -> DataFrame:
    """Metadata columns (PROBE_SCHEMA) from range reads of HEADER_BYTES a row."""

    def probe(batches):
        store, handles = ByteStore(root), {}
        for batch in batches:
            rows = batch.to_pydict()
            heads = [parse_header(read_at(_handle(store, handles, s), o, HEADER_BYTES)) for s, o in zip(rows["shard"], rows["offset"])]
            cols = list(zip(*heads)) if heads else [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("digest"), *(pa.array(c, pa.int32()) for c in cols)], names=_names(PROBE_SCHEMA))

    return index.mapInArrow(probe, PROBE_SCHEMA)


def _handle(store: ByteStore, handles: dict, name: str):
    """An open shard; a few stay open."""
    if name not in handles:
        if len(handles) >= 8:
            handles.pop(next(iter(handles))).close()
        handles[name] = store.open(name)
    return handles[name]


def by_place(index: DataFrame, range_bytes: int = 16 << 20) -> DataFrame:
    """Index rows dealt to tasks by shard and range, sorted by place; about a task a range of stored bytes."""
    stored = index.agg(F.sum("length")).first()[0] or 0  # of all rows, repeated members too: no less than is stored
    n = min(100_000, max(index.sparkSession.sparkContext.defaultParallelism, -(-stored // range_bytes)))
    return index.repartition(n, "shard", F.floor(F.col("offset") / range_bytes)).sortWithinPartitions("shard", "offset")


def read_media(index: DataFrame, root: str) -> DataFrame:
    """Rows of MEDIA_SCHEMA: header columns by a range read, then the member read back, checked and decoded."""

    def read(batches):
        store, handles, last, seen = ByteStore(root), {}, None, None
        for batch in batches:
            rows, out = batch.to_pydict(), []
            for digest, shard, offset, length in zip(rows["digest"], rows["shard"], rows["offset"], rows["length"]):
                if digest != last:
                    handle = _handle(store, handles, shard)
                    width, height, depth, _ = parse_header(read_at(handle, offset, HEADER_BYTES))
                    media = read_at(handle, offset, length)
                    stored = hashlib.sha256(media).hexdigest()
                    if stored != digest:
                        raise ValueError(f"{shard}@{offset} doesn't hold {digest}")
                    payload = decode_png(media)
                    last, seen = digest, (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(media), stored, feature_of(payload), width, height, depth)
                out.append(seen)
            cols = list(zip(*out)) if out else [[]] * 9
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=_names(MEDIA_SCHEMA))

    return index.select(*_names(INDEX_SCHEMA)).mapInArrow(read, MEDIA_SCHEMA)


def media_columns(docs: DataFrame, shard_bytes: int = 32 << 20) -> DataFrame:
    """Pack, commit the index, read back."""
    root = shared_dir(docs.sparkSession, "media")
    index = written(pack_media(docs, root, shard_bytes), "media-index")
    return read_media(by_place(index), root)
