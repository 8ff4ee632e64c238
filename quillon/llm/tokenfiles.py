"""Token ids in seekable zstandard files.

A file is a run of independent zstandard frames and ends with a seek table, so any zstandard tool decompresses it to the
plain ids (little-endian unsigned 32-bit) and a reader that wants a few documents decompresses their frames alone:

    frames            ids of whole documents up to ``frame_ids``; only a longer document spans several frames
    skippable frame   document table: ids of documents, their nulls, their first positions (deflated columns with an XXH64)
    skippable frame   seek table: per frame its size, its size decompressed, the low half of its content's XXH64
                      (zero for the document table), then the number of frames, a flag byte and the closing magic number

(the layout of the seek table is zstandard's published seekable format). Documents are in ascending order of id, nulls
first, across all files: texts are dealt by ranges of (id, hash of the text, place in the input), so that an id with a
third of all rows is split too, and each task tokenizes and writes its range as a stream; it holds one frame and the table of its own file. File
names hold a token of the attempt: what a lost attempt leaves is never named by the manifest, which is the table of
files (a row each) and what readers start from.

Tokenizing: a text is cut where a space or line break stands between two characters that aren't white space. The
byte-level pre-tokenizer always begins a new piece there, so the ids of the units, joined, are those of the text. Units
repeat as words do, so a worker keeps the ids of those it has seen, up to a bound. Strings of special tokens within a
text are ordinary text and never become their ids.

Edge cases: a null or empty text is the end id alone; documents with a null id come first, with the smallest starts;
repeated rows are documents of their own (equal ones lie in the order of their place in the input); texts of any length
are whole; of an empty table there is no file and no row; further columns are ignored.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.shared import ByteStore, read_at, shared_dir, written

SKIPPABLE, TABLE = 0x184D2A5E, 0x184D2A50
CLOSING, FLAGS = 0x8F92EAB1, 0x80
FOOTER = struct.Struct("<IBI")
ID = np.dtype("<u4")
MANIFEST_SCHEMA = "range int, file string, docs bigint, ids bigint, frames bigint, bytes bigint"
TOKENS_SCHEMA = "doc_id bigint, start bigint, n_tokens bigint, ids binary"
#: Between these, whatever the version of Unicode, a pre-token ends: neither side is white space.
SOLID = "!-~¡-ᙿᚁ-᠍᠏-῿‰-⁞⁠-⿿、-\U0010ffff"
UNIT = re.compile(f"(?<=[{SOLID}])(?=[ \n][{SOLID}])")
#: In Arrow's syntax: a space or line break without such a character on both sides.
UNEVEN = f"(?:^|[^{SOLID}])[ \n]|[ \n](?:[^{SOLID}]|$)"

#: The pre-tokenizer's pattern where a unit has ASCII and Latin letters alone.
LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
PLAIN = re.compile(f"[ \n]?[!-~{LETTERS}]+")
PIECE = re.compile(rf"'(?:[sdmt]|ll|ve|re)| ?[{LETTERS}]+| ?[0-9]+| ?[!-/:-@\[-`{{-~]+|\n")
#: How the byte-level alphabet writes bytes: printable ones as they are, others by characters from 256 on, in order.
SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTES = {x: chr(256 + i) for i, x in enumerate(sorted(set(range(256)) - set(SHOWN)))}


def units_of_texts(texts: pa.Array) -> pa.Array:
    """A list of units per text. Each but the first stands without its leading space, but with a leading line break;
    the first is marked by a leading NUL, with which no other begins."""
    uneven = pc.match_substring_regex(texts, UNEVEN)
    if not pc.any(uneven).as_py():
        return pc.split_pattern(pc.binary_join_element_wise("\0", pc.replace_substring(texts, "\n", " \n"), ""), " ")
    whole, parts = pc.if_else(uneven, "", texts), [None] * len(texts)
    for i in np.flatnonzero(uneven.to_numpy(zero_copy_only=False)):
        first, *more = UNIT.split(texts[i].as_py())
        parts[i] = ["\0" + first, *(u[1:] if u[0] == " " else u for u in more)]
    return pc.coalesce(pa.array(parts, pa.list_(pa.string())), units_of_texts(whole))


class Units:
    """Ids of texts by way of the ids, as bytes, of their units; what isn't known is tokenized and kept.

    Once ``most`` units are kept, further ones are tokenized anew each time; if these make more than a tenth of a run's
    text, the kept ones are out of date and are forgotten. Tokenizers that don't cut texts at the byte-level pattern
    alone get whole texts."""

    def __init__(self, tokenizer_json: str, most: int = 400_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.tokenizer.encode_special_tokens = True
        self.model, self.most, self.known, self.pieces = self.tokenizer.model, most, {}, {}
        parts = json.loads(tokenizer_json)
        cut = parts.get("pre_tokenizer") or {}
        self.by_unit = cut.get("type") == "ByteLevel" and cut.get("use_regex") and not cut.get("add_prefix_space") and not parts.get("normalizer")

    def whole(self, text: str) -> bytes:
        """Ids of a text that is given to the tokenizer as it is."""
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, ID).tobytes()

    def unit(self, unit: str) -> bytes:
        """Ids of a unit. Pieces of plain letters and signs go straight to the model, without the cost of offsets."""
        text = unit if unit[0] == "\n" else unit[1:] if unit[0] == "\0" else " " + unit
        if not PLAIN.fullmatch(text):
            return self.whole(text)
        return b"".join(map(self.piece, PIECE.findall(text)))

    def piece(self, piece: str) -> bytes:
        """Ids of what the pre-tokenizer gives the model as one."""
        found = self.pieces.get(piece)
        if found is None:
            shown = piece.replace(" ", BYTES[32]).replace("\n", BYTES[10]) if piece.isascii() else piece.encode().decode("latin-1").translate(BYTES)
            found = struct.pack(f"<{len(ids)}I", *ids) if (ids := [t.id for t in self.model.tokenize(shown)]) else b""
            if len(self.pieces) < self.most and len(piece) <= 64:
                self.pieces[piece] = found
        return found

    def ids(self, texts: pa.Array, at_once: int = 1 << 19) -> Iterator[np.ndarray]:
        """Ids of each whole text. Different units are looked up once for all ``texts``; ids are laid out for ``at_once`` units at a time."""
        if not self.by_unit:
            yield from (np.frombuffer(self.whole(t), ID) for t in texts.to_pylist())
            return
        lists = units_of_texts(texts)
        ends = np.cumsum(pc.list_value_length(lists).to_numpy())
        encoded = lists.flatten().dictionary_encode()
        used, codes = encoded.dictionary.to_pylist(), encoded.indices.to_numpy()
        found = list(map(self.known.get, used))
        missing = [i for i, x in enumerate(found) if x is None]
        if len(self.known) >= self.most and 10 * np.isin(codes, missing).sum() > len(codes):
            self.known.clear()
            self.pieces.clear()
        for i in missing:
            found[i] = self.unit(used[i])
            if len(self.known) < self.most and len(used[i]) <= 64:
                self.known[used[i]] = found[i]
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // ID.itemsize
        first, flat = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(found), ID)
        low = text = 0
        while text < len(ends):
            last = max(text + 1, int(np.searchsorted(ends, low + at_once, "right")))
            part = codes[low : ends[last - 1]]
            n = sizes[part]
            upto = np.cumsum(n)
            ids = flat[np.repeat(first[part] - upto + n, n) + np.arange(upto[-1])]
            yield from np.split(ids, np.append(0, upto)[ends[text : last - 1] - low])
            low, text = int(ends[last - 1]), last


_UNITS: dict[int, Units] = {}


def units_of(tokenizer_json: str) -> Units:
    """One table a worker process."""
    key = xxhash.xxh64_intdigest(tokenizer_json)
    if key not in _UNITS:
        _UNITS.clear()
        _UNITS[key] = Units(tokenizer_json)
    return _UNITS[key]


def low_hash(data: bytes) -> int:
    return xxhash.xxh64_intdigest(data) & 0xFFFFFFFF


def _column(values: np.ndarray) -> bytes:
    """Differences of a column, compressed."""
    return zstandard.ZstdCompressor(level=3).compress(np.diff(values, prepend=0).astype("<i8").tobytes())


class FrameWriter:
    """A file written as a stream."""

    def __init__(self, out, frame_ids: int):
        self.out, self.limit, self.held, self.held_ids = out, frame_ids, [], 0
        self.compressor = zstandard.ZstdCompressor(level=3)
        self.table: list[tuple[int, int, int]] = []
        self.keys: list[int] = []
        self.nulls: list[bool] = []
        self.starts: list[int] = []
        self.n_ids = self.n_bytes = 0

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.n_bytes += len(data)

    def _frame(self, raw: bytes) -> None:
        packed = self.compressor.compress(raw)
        self.table.append((len(packed), len(raw), low_hash(raw)))
        self._write(packed)

    def flush(self) -> None:
        if self.held:
            self._frame(b"".join(self.held))
            self.held, self.held_ids = [], 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        n, most = len(ids) // ID.itemsize, self.limit * ID.itemsize
        if self.held_ids and self.held_ids + n > self.limit:
            self.flush()
        self.keys.append(0 if doc_id is None else doc_id)
        self.nulls.append(doc_id is None)
        self.starts.append(self.n_ids)
        self.n_ids += n
        if n > self.limit:
            for low in range(0, len(ids), most):
                self._frame(ids[low : low + most])
        else:
            self.held.append(ids)
            self.held_ids += n

    def finish(self) -> None:
        self.flush()
        cols = [_column(np.array(x, np.int64)) for x in (self.keys, self.nulls, self.starts)]
        body = struct.pack("<4Q", len(self.keys), *map(len, cols)) + b"".join(cols)
        body += struct.pack("<Q", xxhash.xxh64_intdigest(body))
        frame = struct.pack("<II", TABLE, len(body)) + body
        self._write(frame)
        self.table.append((len(frame), 0, 0))
        seek = b"".join(struct.pack("<III", *x) for x in self.table) + FOOTER.pack(len(self.table), FLAGS, CLOSING)
        self._write(struct.pack("<II", SKIPPABLE, len(seek)) + seek)


class FrameReader:
    """Frames and documents of an open file, from its end: the seek table, the document table, then what is asked for."""

    def __init__(self, handle):
        self.handle = handle
        size = handle.size()
        n, flags, closing = FOOTER.unpack(read_at(handle, size - FOOTER.size, FOOTER.size))
        if closing != CLOSING or not flags & FLAGS:
            raise ValueError("no seek table with checksums")
        table = np.frombuffer(read_at(handle, size - FOOTER.size - 12 * n, 12 * n), ID).reshape(n, 3).astype(np.int64)
        self.at = np.concatenate([[0], np.cumsum(table[:, 0])])
        self.first = np.concatenate([[0], np.cumsum(table[:, 1])]) // ID.itemsize  # the first id of each frame
        self.sums, self.n_frames = table[:, 2], n - 1
        frame = read_at(handle, int(self.at[n - 1]), int(table[n - 1, 0]))
        magic, length = struct.unpack_from("<II", frame)
        body = frame[8:]
        if magic != TABLE or length != len(body) or struct.pack("<Q", xxhash.xxh64_intdigest(body[:-8])) != body[-8:]:
            raise ValueError("the document table is damaged")
        self.n_docs, *lengths = struct.unpack_from("<4Q", body)
        cuts = np.cumsum([32, *lengths])
        self.keys, self.nulls, self.starts = (np.cumsum(np.frombuffer(zstandard.ZstdDecompressor().decompress(body[a:b]), "<i8")) for a, b in zip(cuts, cuts[1:]))
        self.ends = np.append(self.starts[1:], self.first[self.n_frames])
        self._last: tuple[int, bytes] = (-1, b"")
        self.frames_read = 0

    def frame(self, k: int) -> bytes:
        """A frame's content, checked; the last one is kept."""
        if self._last[0] != k:
            low, high = int(self.at[k]), int(self.at[k + 1])
            raw = zstandard.ZstdDecompressor().decompress(read_at(self.handle, low, high - low))
            if low_hash(raw) != self.sums[k]:
                raise ValueError(f"frame {k} doesn't have its checksum")
            self._last = (k, raw)
            self.frames_read += 1
        return self._last[1]

    def document(self, i: int) -> bytes:
        """Ids of the i-th document of the file: its frames alone are read."""
        low, high = int(self.starts[i]), int(self.ends[i])
        k, parts = int(np.searchsorted(self.first, low, "right")) - 1, []
        while low < high:
            begin, end = int(self.first[k]), min(int(self.first[k + 1]), high)
            parts.append(self.frame(k)[(low - begin) * ID.itemsize : (end - begin) * ID.itemsize])
            low, k = end, k + 1
        return b"".join(parts)

    def in_frames(self, low: int, high: int) -> range:
        """The documents that begin in frames [low, high)."""
        return range(*(int(np.searchsorted(self.starts, self.first[k], "left")) for k in (low, min(high, self.n_frames))))

    def with_id(self, doc_id: int | None) -> range:
        """The documents with this id: the table is sorted, nulls first."""
        n = int(self.nulls.sum())
        return range(n) if doc_id is None else range(*(n + int(np.searchsorted(self.keys[n:], doc_id, side)) for side in ("left", "right")))


def pieces(batch: pa.RecordBatch, limit: int = 32 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about ``limit`` bytes, at least a row each."""
    rows = max(1, limit * batch.num_rows // max(1, batch.nbytes))
    return (batch.slice(low, rows) for low in range(0, batch.num_rows, rows))


def write_tokens(docs: DataFrame, root: str, tokenizer: str, end_id: int = 0, file_bytes: int = 64 << 20, frame_ids: int = 1 << 18) -> DataFrame:
    """The stored manifest (MANIFEST_SCHEMA) of the files below ``root`` with the ids of ``docs`` (doc_id, text).

    ``tokenizer`` is the path of a tokenizer file on the driver; tasks get its content. A file takes the texts of about
    ``file_bytes``."""
    with open(tokenizer, encoding="utf-8") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary: a few MB whatever the input
    end = np.array([end_id], ID).tobytes()
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0]
    n = max(1, min(100_000, -(-(size or 0) // file_bytes)))

    def write(batches):
        writer = out = None
        units = units_of(model.value)
        for batch in batches:
            for part in pieces(batch):
                if writer is None:
                    number, name = part.column(2)[0].as_py(), f"tokens-{uuid.uuid4().hex}.zst"
                    store = ByteStore(root)
                    store.create()
                    out = store.fs.open_output_stream(f"{store.base}/{name}", compression=None)
                    writer = FrameWriter(out, frame_ids)
                for doc_id, ids in zip(part.column(0), units.ids(part.column(1))):
                    writer.add(doc_id.as_py(), ids.tobytes() + end)
        if writer is not None:
            writer.finish()
            out.close()  # a file is named only once it is whole
            row = {"range": number, "file": name, "docs": len(writer.keys), "ids": writer.n_ids, "frames": len(writer.table) - 1, "bytes": writer.n_bytes}
            kinds = [pa.int32(), pa.string(), *[pa.int64()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row.values(), kinds)], names=list(row))

    place = texts.withColumn("tie", F.xxhash64("text")).withColumn("place", F.monotonically_increasing_id())
    order = [F.col("doc_id").asc_nulls_first(), "tie", "place"]
    ranged = place.repartitionByRange(n, *order).sortWithinPartitions(*order)
    return written(ranged.select("doc_id", "text", F.spark_partition_id().alias("range")).mapInArrow(write, MANIFEST_SCHEMA), "tokens-manifest")


def with_bases(manifest: DataFrame) -> DataFrame:
    """The manifest with ``base``, the ids in all files before. A row a file, so one ordered window is small."""
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("ids").over(before), F.lit(0)))


def _rows(found: Iterable[tuple], limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of TOKENS_SCHEMA of bounded size."""
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
    out, held = [], 0
    for row in found:
        out.append(row)
        held += len(row[-1]) + 32
        if held >= limit:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["doc_id", "start", "n_tokens", "ids"])
            out, held = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["doc_id", "start", "n_tokens", "ids"])


def _document(reader: FrameReader, i: int, base: int) -> tuple:
    ids = reader.document(i)
    return (None if reader.nulls[i] else int(reader.keys[i]), base + int(reader.starts[i]), len(ids) // ID.itemsize, ids)


def read_tokens(manifest: DataFrame, root: str, task_frames: int = 16) -> DataFrame:
    """Rows of TOKENS_SCHEMA, one per document of all files; a task reads runs of ``task_frames`` frames."""
    runs = with_bases(manifest).select("file", "base", F.explode(F.sequence(F.lit(0).cast("long"), F.col("frames") - 1, F.lit(task_frames).cast("long"))).alias("low"))
    total = manifest.agg(F.sum(F.ceil(F.col("frames") / task_frames))).first()[0] or 1

    def read(batches):
        store = ByteStore(root)
        for batch in batches:
            for run in batch.to_pylist():
                with store.open(run["file"]) as handle:
                    reader = FrameReader(handle)
                    yield from _rows(_document(reader, i, run["base"]) for i in reader.in_frames(run["low"], run["low"] + task_frames))

    return runs.repartition(min(100_000, total), "file", "low").mapInArrow(read, TOKENS_SCHEMA)


def read_documents(manifest: DataFrame, root: str, wanted: DataFrame) -> DataFrame:
    """Rows of TOKENS_SCHEMA of the documents whose ids are in ``wanted`` (doc_id; a row an id): only their frames are decompressed.

    Files hold ranges of ids, so each wanted id is looked up in the files whose range it is in; these come from the document tables."""

    def ends(batches):
        store = ByteStore(root)
        for batch in batches:
            rows = batch.to_pylist()
            for row in rows:
                with store.open(row["file"]) as handle:
                    r = FrameReader(handle)
                    keys = r.keys[r.nulls == 0]
                    row |= {"low": int(keys[0]) if len(keys) else None, "high": int(keys[-1]) if len(keys) else None, "has_null": bool(r.nulls.any())}
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("file", pa.string()), ("base", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("has_null", pa.bool_())]))

    def read(batches):
        store = ByteStore(root)
        for batch in batches:
            rows = batch.sort_by([("file", "ascending"), ("doc_id", "ascending")]).to_pylist()
            reader = name = handle = None
            for row in rows:
                if row["file"] != name:
                    if handle is not None:
                        handle.close()
                    name, handle = row["file"], store.open(row["file"])
                    reader = FrameReader(handle)
                yield from _rows(_document(reader, i, row["base"]) for i in reader.with_id(row["doc_id"]))
            if handle is not None:
                handle.close()

    files = with_bases(manifest).select("file", "base").mapInArrow(ends, "file string, base bigint, low bigint, high bigint, has_null boolean")
    ids = wanted.select(F.col("doc_id").cast("bigint").alias("doc_id")).distinct()
    inside = ids["doc_id"].between(files["low"], files["high"]) | (ids["doc_id"].isNull() & files["has_null"])
    return ids.join(F.broadcast(files), inside).select("file", "base", "doc_id").mapInArrow(read, TOKENS_SCHEMA)


def token_files(docs: DataFrame, tokenizer: str, end_id: int = 0, file_bytes: int = 64 << 20, frame_ids: int = 1 << 18) -> DataFrame:
    """Write ``docs`` (doc_id, text) and read all documents back: TOKENS_SCHEMA."""
    root = shared_dir(docs.sparkSession, "tokens")
    return read_tokens(write_tokens(docs, root, tokenizer, end_id, file_bytes, frame_ids), root)

