"""Best-fit packing with several permitted sequence lengths.

A sequence of length c costs ``overhead + c + c * c / attention``: a fixed part, a part per position and the part of
attention, which grows with the square (``attention``: the length at which it equals the part per position). Long
sequences so cost more per word, short ones are harder to fill; the permitted lengths are chosen jointly:

Pieces are placed in order of decreasing size into the open bin with the least room that still fits (best fit).
Where none fits, the bin is opened whose cost per word is least, if it is filled as well as the pieces that are
still to come allow: largest first, from the histogram of their sizes. At last each bin is downsized to the
smallest permitted length that holds its contents. This is done with each length as the least that may be opened,
and the cheapest result is kept.

A document longer than the largest length is cut into pieces of that length and a remainder; all pieces are placed.
Equal pieces (id, number, start and length) are counted and numbered, and dealt by a hash of all these to shards of
about ``shard_pieces`` pieces; each shard is packed on its own, so that a task holds a bounded list of sizes and no
text, however often one id repeats. The same pieces give the same bins whatever files or partitions they come in.

Edge cases: documents without words (null or empty text) give one piece of length 0 without a bin
(bin null); null ids and repeated rows are pieces of their own; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.mixing import n_words
from quillon.llm.shared import written

LENGTHS = (256, 512, 1024, 2048, 4096)
PACKED_SCHEMA = "doc_id bigint, piece int, start bigint, length bigint, bin string, bin_length int, bin_start bigint"


def cost(length: int, overhead: float = 16, attention: float = 6144) -> float:
    """Cost of a sequence of this length, in positions."""
    return overhead + length + length * length / attention


class _Remaining:
    """Sizes still to be placed. They are placed in decreasing order, so what is left is the smallest ones."""

    def __init__(self, ascending: list[int]):
        self.sizes, self.begin = [], []
        for i, n in enumerate(ascending):
            if not self.sizes or self.sizes[-1] != n:
                self.sizes.append(n)
                self.begin.append(i)

    def fill(self, left: int, first: int, capacity: int) -> int:
        """Words in a bin of ``capacity`` that ``first`` opens, filled largest first from the ``left`` smallest."""
        used, at = first, bisect.bisect_left(self.begin, left) - 1  # the last size of which some are left
        while at >= 0 and used < capacity:
            at = min(at, bisect.bisect_right(self.sizes, capacity - used) - 1)
            if at < 0:
                break
            n = min(left, self.begin[at + 1] if at + 1 < len(self.begin) else left) - self.begin[at]
            used += self.sizes[at] * min(n, (capacity - used) // self.sizes[at])
            at -= 1
        return used


def _pack(sizes: list[int], order: list[int], remaining: _Remaining, opened: tuple[int, ...], price: dict[int, float]) -> tuple[list[int], list[tuple[int, int]]]:
    """Words per bin, and (bin, start) of each piece, if bins of the lengths ``opened`` are opened."""
    room: list[tuple[int, int]] = []  # (free, bin), sorted
    fill: list[int] = []
    place: list[tuple[int, int]] = [(0, 0)] * len(sizes)
    for k, i in enumerate(order):
        n = sizes[i]
        at = bisect.bisect_left(room, (n, -1))
        if at < len(room):
            free, b = room.pop(at)
        else:
            left = len(order) - k - 1
            capacity = min((c for c in opened if c >= n), key=lambda c: (price[c] / remaining.fill(left, n, c), c))
            free, b = capacity, len(fill)
            fill.append(0)
        place[i] = (b, fill[b])
        fill[b] += n
        if free > n:
            bisect.insort(room, (free - n, b))
    return fill, place


def pack(sizes: Iterable[int], lengths: tuple[int, ...] = LENGTHS, overhead: float = 16, attention: float = 6144) -> list[tuple[int, int, int]]:
    """(bin, bin length, start in the bin) of each piece; all sizes are positive and at most the largest length.

    The expected fill of a small bin is a hope: where too many are opened, the small pieces run out. So the packing is
    tried with each length as the least to be opened, and the cheapest after downsizing is taken."""
    sizes = list(sizes)
    lengths = tuple(sorted(lengths))
    price = {c: cost(c, overhead, attention) for c in lengths}
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    remaining = _Remaining([sizes[i] for i in reversed(order)])
    best: tuple[float, list, list] | None = None
    for i in range(len(lengths)):
        fill, place = _pack(sizes, order, remaining, lengths[i:], price)
        final = [lengths[bisect.bisect_left(lengths, x)] for x in fill]
        total = sum(price[c] for c in final)
        if best is None or total < best[0]:
            best = total, final, place
    return [(b, best[1][b], start) for b, start in best[2]]


def numbered(pieces: DataFrame, step: int = 10_000) -> DataFrame:
    """The rows of ``pieces`` with ``copy``: equal rows are numbered from 0. They are counted with partial sums and
    laid out again in runs of ``step``, so that no group of equal rows meets in a task."""
    counted = pieces.groupBy(*pieces.columns).agg(F.count("*").alias("copies"))
    runs = counted.withColumn("low", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(step).cast("long"))))
    return runs.withColumn("copy", F.explode(F.sequence("low", F.least(F.col("low") + step, F.col("copies")) - 1))).drop("copies", "low")


def pack_documents(docs: DataFrame, lengths: tuple[int, ...] = LENGTHS, overhead: float = 16, attention: float = 6144, shard_pieces: int = 20_000) -> DataFrame:
    """PACKED_SCHEMA rows, one per piece, of ``docs`` (doc_id, text)."""
    most = max(lengths)
    sized = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), n_words(F.col("text")).alias("n"))
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("n") - 1, F.lit(0).cast("long")), F.lit(most).cast("long"))
    pieces = sized.select("doc_id", "n", F.posexplode(starts).alias("piece", "start"))
    pieces = pieces.select("doc_id", "piece", "start", F.least(F.col("n") - F.col("start"), F.lit(most)).alias("length"))
    pieces = written(numbered(pieces), "pack-pieces")
    shards = max(1, -(-pieces.count() // shard_pieces))
    keyed = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "start", "length", "copy"), F.lit(shards)).cast("int"))

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece", "copy"], ascending=[False, True, True, True], kind="stable", na_position="last")
        full = rows["length"].to_numpy() > 0
        found = iter(pack(rows["length"].to_numpy()[full].tolist(), lengths, overhead, attention))
        places = [next(found) if x else None for x in full]
        return pd.DataFrame({
            "doc_id": rows["doc_id"].astype("Int64"), "piece": rows["piece"], "start": rows["start"], "length": rows["length"],
            "bin": [p and f"{key[0]}-{p[0]}" for p in places],
            "bin_length": pd.array([p and p[1] for p in places], "Int32"),
            "bin_start": pd.array([p and p[2] for p in places], "Int64"),
        })

    return keyed.groupBy("shard").applyInPandas(one, PACKED_SCHEMA)
