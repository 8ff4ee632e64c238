"""Fill-in-middle: texts cut in three at hash-drawn units, found through a sparse checkpoint index.

While the units of a text are counted, every ``step``-th leaves a checkpoint: its number, byte offset and code-point
offset. A cut is looked up by binary search among these (by unit, byte or code point) and a short rescan from the
checkpoint before it, so no list of all units is made, whatever the length of the text. Units are code points, or
the matches of a pattern (what it leaves out counts as units of one code point).

The cuts are drawn from the SHA-256 of seed and id, so the same rows give the same pieces in any layout. Output:
prefix-suffix-middle, suffix-prefix-middle, or the plain text. A text that holds one of the three marks is left
plain, so that an output can be taken apart again without doubt.

Edge cases: a null text is an empty one, and plain; a null id is drawn as the empty text; repeated rows are cut alike;
texts of any length and of any code points are taken whole; an empty table gives an empty result; further columns
are ignored.
"""

from __future__ import annotations

import bisect
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARKS = ("<P>", "<S>", "<M>")
FIM_SCHEMA = "doc_id bigint, n bigint, form string, prefix_units bigint, middle_units bigint, prefix_chars bigint, middle_chars bigint, prefix_bytes bigint, middle_bytes bigint, output string"
NAMES = [x.split()[0] for x in FIM_SCHEMA.split(", ")]
BLOCK = 1 << 16


class CheckpointIndex:
    """Offsets of every ``step``-th unit of a UTF-8 text, and the offsets of any unit from them."""

    def __init__(self, text: bytes, step: int = 512, unit: str | None = None):
        self.text, self.step = text, step
        self.pattern = re.compile(f"(?:{unit})|(?s:.)") if unit else None
        self.units, self.bytes, self.points = array("q", [0]), array("q", [0]), array("q", [0])
        self.raw = np.frombuffer(text, np.uint8)
        self.n = self._match() if unit else self._count()

    def _starts(self, low: int, high: int) -> np.ndarray:
        """Byte offsets at which a code point begins, in [low, high)."""
        return np.flatnonzero((self.raw[low:high] & 0xC0) != 0x80) + low

    def _count(self) -> int:
        n = 0
        for low in range(0, len(self.raw), BLOCK):
            starts = self._starts(low, low + BLOCK)
            first = -n % self.step or (self.step if n == 0 else 0)
            for k in range(first, len(starts), self.step):
                self._note(n + k, int(starts[k]), n + k)
            n += len(starts)
        self.n_points = n
        return n

    def _match(self) -> int:
        whole, n, at_byte, at_point = self.text.decode(), 0, 0, 0
        for n, m in enumerate(self._units_from(whole, 0)):
            if n and n % self.step == 0:
                at_byte += len(whole[at_point : m.start()].encode())
                at_point = m.start()
                self._note(n, at_byte, at_point)
        self.n_points = len(whole)
        return n + 1 if whole else 0

    def _units_from(self, text: str, at: int):
        return (m for m in self.pattern.finditer(text, at) if m.end() > m.start())

    def _note(self, unit: int, byte: int, point: int) -> None:
        self.units.append(unit)
        self.bytes.append(byte)
        self.points.append(point)

    def locate(self, at: int, by: str = "units") -> tuple[int, int, int]:
        """(unit, byte, code point) of the unit that holds this position, counted in ``units``, ``bytes`` or ``points``;
        the end of the text if it lies beyond."""
        k = bisect.bisect_right(getattr(self, by), at) - 1
        unit, byte, point = self.units[k], self.bytes[k], self.points[k]
        if self.pattern is None:
            high = byte + (at - unit + 1) * 4 if by != "bytes" else at + 1
            starts = self._starts(byte, high)
            i = at - unit if by != "bytes" else int(np.searchsorted(starts, at, "right")) - 1
            if i < len(starts) and at < (len(self.text) if by == "bytes" else self.n):
                return unit + i, int(starts[i]), point + i
            return self.n, len(self.text), self.n_points
        last = (unit, byte, point)
        end = self.bytes[k + 1] if k + 1 < len(self.bytes) else len(self.text)
        here = self.text[byte:end].decode()
        for m in self._units_from(here, 0):
            now = (unit, byte + len(here[: m.start()].encode()), point + m.start())
            if now[("units", "bytes", "points").index(by)] > at:
                return last
            last, unit = now, unit + 1
        beyond = {"units": self.n, "bytes": len(self.text), "points": self.n_points}[by]
        return (self.n, len(self.text), self.n_points) if at >= beyond else last


def arranged(form: str, prefix: bytes, middle: bytes, suffix: bytes, marks: tuple[bytes, bytes, bytes]) -> bytes:
    """The pieces in the order of ``form``."""
    p, s, m = marks
    return b"".join((p, prefix, s, suffix, m, middle) if form == "psm" else (s, suffix, p, prefix, m, middle))


def draws(doc_id: Column, seed: int = 1, n: int = 4) -> list[Column]:
    """``n`` unsigned 32-bit numbers from the SHA-256 of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(n)]


def fill_in_middle(docs: DataFrame, seed: int = 1, plain_percent: int = 10, spm_percent: int = 20, marks: tuple[str, str, str] = MARKS, unit: str | None = None, step: int = 512) -> DataFrame:
    """Rows of FIM_SCHEMA of ``docs`` (doc_id, text), one each, in one pass; the sizes of pieces are null where the text stays plain."""
    raw_marks = tuple(m.encode() for m in marks)

    def cut(text: bytes, h: list[int]) -> tuple:
        index = CheckpointIndex(text, step, unit)
        if not text or h[2] % 100 >= 100 - plain_percent or any(m in text for m in raw_marks):
            return (index.n, "plain", *[None] * 6, text)
        low, high = sorted((h[0] % (index.n + 1), h[1] % (index.n + 1)))
        a, b = index.locate(low), index.locate(high)
        form = "spm" if h[3] % 100 < spm_percent else "psm"
        sizes = (low, high - low, a[2], b[2] - a[2], a[1], b[1] - a[1])
        return (index.n, form, *sizes, arranged(form, text[: a[1]], text[a[1] : b[1]], text[b[1] :], raw_marks))

    def transform(batches):
        for batch in batches:
            ids, texts, *h = batch.columns
            rows, held, begin = [], 0, 0
            for i, (text, *draw) in enumerate(zip(texts, *h)):
                rows.append(cut(text.as_py(), [x.as_py() for x in draw]))
                held += len(rows[-1][-1])
                if held >= 8 << 20 or i + 1 == len(texts):
                    cols = list(zip(*rows))
                    kinds = (pa.int64(), pa.string(), *[pa.int64()] * 6, pa.binary())
                    out = [pa.array(c, k) for c, k in zip(cols, kinds)]
                    yield pa.RecordBatch.from_arrays([ids[begin : i + 1], *out[:-1], out[-1].cast(pa.string())], names=NAMES)
                    rows, held, begin = [], 0, i + 1

    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    return source.select("doc_id", "text", *[h.alias(f"h{i}") for i, h in enumerate(draws(F.col("doc_id"), seed))]).mapInArrow(transform, FIM_SCHEMA)


def restored(form: Column, output: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The exact text from an output and its form: marks never occur in its pieces, and none overlaps another."""
    part = F.split(output, "|".join(re.escape(m) for m in marks), -1)
    text = lambda *at: F.concat(*[part[i] for i in at])
    return F.when(form == "plain", output).when(form == "psm", text(1, 3, 2)).otherwise(text(2, 3, 1))
