"""N-gram Jaccard join with count-vector R-trees.

A document's set holds its distinct word shingles. Shingles are hashed into groups; the counts per
group are a point, and two sets share at most the sum of the coordinate-wise minima of their points.
An R-tree over the points finds the pairs whose bound reaches the wanted overlap, and these are
verified on the sets themselves. All links but those of equal sets come from the trees.

How the trees are dealt out. One tree over all points would compare each document with all of similar
size, so the points are first dealt to buckets that no link can miss. Two linked sets of a + b
elements differ in at most D = (a + b)(1 - t) / (1 + t). Hash the shingles of a size band into more
than D groups: some group is the same in both, so the hash of a group's content is a bucket key. More
than that: if a set has more than D groups of at least m elements, one of *those* is the same, so only
they become keys, and one frequent shingle alone doesn't put texts together. A set with fewer such
groups emits all groups, and the empty ones too if it must. Sizes are split into bands of ratio 1 / t; a
document takes part in its own band's scheme and the one below, so that linked documents share a scheme.
Buckets with the same smallest member (their pivot) are one: a set has many keys, and this way its point
travels once a pivot, not once a key.

Equal sets are one class (their digest), settled without any pair. Two rounds thin out large groups of copies: in
each bucket's tree a member looks for the first member that its bound allows and that is in another component (the
pivot comes first, in the second round the order is that of a hash), so that there is at most one pair a member and
bucket; the pairs are verified and contracted. In the last round the trees of the buckets that still span components
emit all pairs across these. A bucket of more than ``block`` members is dealt to parts of that size: in the first
rounds each with the pivot, in the last to all pairs of parts whose sizes (in slices of a quarter of a band) can be linked,
so no bucket meets in one task and none is cut short. Unrelated texts that share a bucket in great number and are of
one size are still compared pair by pair, by their bounds.

Edge cases: texts of fewer words than a shingle are one shingle; without words (or text) the set is
empty and links with nothing; rows without an id link only through an equal set; rows that share an id
are one document; an empty table gives an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import itertools
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from quillon.llm.components import components
from quillon.llm.shared import broadcast_if_small, release, words_of, written

#: A point has 2 ** b groups, b between these; stored points, which travel with the buckets, at most 2 ** STORED_BITS.
LEAST_BITS, MOST_BITS, STORED_BITS = 5, 15, 13
PREPARED_SCHEMA = "doc_id bigint, digest binary, n bigint, point binary"
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 1_000_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


@functools.cache
def _bands(num: int, den: int, most: int = 1 << 40) -> list[int]:
    """Lower ends of the size bands."""
    ends = [1]
    while ends[-1] < most:
        ends.append(max(ends[-1] + 1, -(-ends[-1] * den // num)))
    return ends


def most_different(total: int, num: int, den: int) -> int:
    """The largest symmetric difference of two linked sets with so many elements together."""
    return total * (den - num) // (den + num)


@functools.cache
def _group_size(num: int, den: int) -> tuple[int, float]:
    """(least elements of a group that becomes a key, mean elements of a group): the largest least such that a
    set is expected to have more such groups than two linked sets can differ in, with a seventh to spare."""
    wanted = 1.15 * (1 + den / num) * (den - num) / (den + num)
    for least in range(8, 0, -1):
        share, mean = max((sum(math.exp(-m + j * math.log(m) - math.lgamma(j + 1)) for j in range(least, least + 60)) / m, m) for m in (x / 10 for x in range(10, 200)))
        if share >= wanted:
            return least, mean
    return 1, 1 / wanted


@functools.cache
def _scheme(i: int, num: int, den: int) -> int:
    """Number of groups of band i's scheme; above any difference of its linked sets."""
    ends = _bands(num, den)
    top = ends[i + 1] - 1
    return max(most_different(top + top * den // num, num, den) + 1, math.ceil(ends[i] / _group_size(num, den)[1]))


def bucket_keys(s: np.ndarray, num: int, den: int) -> np.ndarray:
    """Keys of a set, at least one of which any linked set has too."""
    one = Sets([], 1, _WordHashes())
    one.hashes, one.doc, one.sizes, one.begin = s, np.zeros(len(s), np.int64), np.array([len(s)]), np.array([0, len(s)])
    return one.keys(np.array([0]), num, den)[0]


def point_of(s: np.ndarray, most_bits: int = MOST_BITS) -> np.ndarray:
    """Counts of a set per group: 2 ** b groups by the top b bits of the hash, about as many as elements."""
    b = min(most_bits, max(LEAST_BITS, len(s).bit_length() - 1))
    return np.bincount((s >> np.uint64(64 - b)).astype(np.int64), minlength=1 << b)


def pack_point(p: np.ndarray) -> bytes:
    """One byte a group, or four where a count needs them; the first byte tells."""
    return b"\x01" + p.astype(np.uint8).tobytes() if p.max() < 256 else b"\x04" + p.astype(np.uint32).tobytes()


def unpack_point(x: bytes) -> np.ndarray:
    return np.frombuffer(x, np.uint8 if x[0] == 1 else np.uint32, offset=1).astype(np.int32)


def aligned(points: list[np.ndarray]) -> np.ndarray:
    """Points as rows with the coarsest point's groups: neighbouring groups of the finer ones add up."""
    least = min(map(len, points))
    return np.stack([p if len(p) == least else p.reshape(least, -1).sum(1) for p in points])


class CountTree:
    """A bulk-loaded R-tree over points: nodes keep the coordinate-wise maxima and the range of set sizes below."""

    LEAF = 16

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.points, self.sizes, self.nodes = points.astype(np.int64), sizes, []
        self.root = self._build(np.arange(len(points))) if len(points) else -1

    def _build(self, rows: np.ndarray) -> int:
        p, n = self.points[rows], self.sizes[rows]
        children = None
        if len(rows) > self.LEAF:
            spread = np.append(p.max(0) - p.min(0), n.max() - n.min())
            j = int(spread.argmax())
            o = np.argsort(n if j == p.shape[1] else p[:, j], kind="stable")
            children = [self._build(part) for part in np.array_split(rows[o], min(self.LEAF, -(-len(rows) // self.LEAF)))]
        self.nodes.append((p.max(0), int(n.min()), int(n.max()), rows, children))
        return len(self.nodes) - 1

    def search(self, point: np.ndarray, size: int, num: int, den: int) -> np.ndarray:
        """Rows whose bound allows num/den similarity: den * shared >= num * (a + b - shared)."""
        found, stack = [], [self.root] if self.root >= 0 else []
        point = point.astype(np.int64)
        while stack:
            high, least, most, rows, children = self.nodes[stack.pop()]
            if most * den < num * size or least * num > den * size:
                continue
            if int(np.minimum(high, point).sum()) * (den + num) < num * (size + max(least, -(-num * size // den))):
                continue
            if children is not None:
                stack += children
                continue
            shared = np.minimum(self.points[rows], point).sum(1)
            found.append(rows[shared * (den + num) >= num * (size + self.sizes[rows])])
        return np.concatenate(found) if found else np.empty(0, np.int64)


class Sets:
    """The sets of several documents at once: sorted distinct shingle hashes, document after document."""

    def __init__(self, words: list[list[bytes]], k: int, hashes: _WordHashes):
        lengths = np.array([len(w) for w in words], np.int64)
        h = np.fromiter(map(hashes.__getitem__, itertools.chain.from_iterable(words)), np.uint64, int(lengths.sum()))
        doc = np.repeat(np.arange(len(words)), lengths)
        begin = np.concatenate([[0], np.cumsum(lengths)])
        width = np.minimum(lengths, k)
        s = width[doc].astype(np.uint64)
        for j in range(int(width.max(initial=0))):
            moved = np.concatenate([h[j:], np.zeros(j, np.uint64)])
            s = np.where(j < width[doc], _mix(s * np.uint64(0x9E3779B97F4A7C15) + moved), s)
        whole = np.arange(len(h)) - begin[doc] <= (lengths - width)[doc]
        s, doc = s[whole], doc[whole]
        ends = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(words)))])
        for i, j in zip(ends, ends[1:]):
            s[i:j].sort()
        fresh = np.concatenate([[True], (s[1:] != s[:-1]) | (doc[1:] != doc[:-1])]) if len(s) else np.zeros(0, bool)
        self.hashes, self.doc = s[fresh], doc[fresh]
        self.sizes = np.bincount(self.doc, minlength=len(words))
        self.begin = np.concatenate([[0], np.cumsum(self.sizes)])

    def one(self, i: int) -> np.ndarray:
        return self.hashes[self.begin[i] : self.begin[i + 1]]

    def digests(self) -> list[bytes | None]:
        return [xxhash.xxh3_128_digest(self.one(i).tobytes()) if n else None for i, n in enumerate(self.sizes)]

    def keys(self, chosen: np.ndarray, num: int, den: int) -> list[np.ndarray]:
        """``bucket_keys`` of the chosen documents."""
        take = np.zeros(len(self.sizes), bool)
        take[chosen] = True
        rank = np.cumsum(take) - 1
        row = take[self.doc]
        s, doc = self.hashes[row], rank[self.doc[row]]
        sizes = self.sizes[chosen]
        own = np.searchsorted(_bands(num, den), sizes, side="right") - 1
        mixed, parts, least = _mix(s), [[] for _ in chosen], _group_size(num, den)[0]
        for shift in (0, 1):
            band = own - shift
            g = np.array([_scheme(int(i), num, den) if i >= 0 else 1 for i in band], np.int64)
            first = np.concatenate([[0], np.cumsum(g)])
            group = (s % g[doc].astype(np.uint64)).astype(np.int64)
            content = _bucket_sums(mixed, first[doc] + group, int(first[-1]))
            filled = np.bincount(first[doc] + group, minlength=int(first[-1]))
            at = np.repeat(np.arange(len(g)), g)
            label = (band + 1).astype(np.uint64)[at] * _M1 + (np.arange(int(first[-1])) - first[at]).astype(np.uint64)
            key = _mix(content ^ _mix(label))
            for i in range(len(g)):
                if band[i] >= 0:
                    f, n = filled[first[i] : first[i + 1]], int(sizes[i])
                    d = most_different(n + n * den // num, num, den)
                    # more groups of some size than there can be differences: one of them is untouched in both sets
                    size = next((m for m in (least, 1) if int((f >= m).sum()) > d), 0)
                    parts[i].append(key[first[i] : first[i + 1]][f >= size])
        return [np.concatenate(p) for p in parts]


def _bucket_sums(values: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit digest of the sum of values by bucket: exact sums of 22-bit parts (in double precision), then mixed."""
    out = np.zeros(n, np.uint64)
    for i in range(3):
        part = ((values >> np.uint64(22 * i)) & np.uint64(0x3FFFFF)).astype(np.float64)
        out = _mix(out + np.bincount(at, part, n).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return out


def _sets(batches, k: int, batch_words: int):
    """ids and Sets of the documents of Arrow batches (doc_id, text), so many words at a time."""
    hashes = _WordHashes()
    for b in batches:
        ids, words, n = [], [], 0
        for i, x in zip(b.column(0).to_pylist(), b.column(1)):
            ids.append(i)
            words.append(words_of(x.as_py()))
            n += len(words[-1])
            if n >= batch_words:
                yield ids, Sets(words, k, hashes)
                ids, words, n = [], [], 0
        if ids:
            yield ids, Sets(words, k, hashes)


def _input(docs: DataFrame) -> DataFrame:
    return docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text")


def prepare(docs: DataFrame, k: int, batch_words: int = 200_000) -> DataFrame:
    """PREPARED_SCHEMA rows; of equal sets in a task only the first has a point."""

    def run(batches):
        seen = set()
        for ids, sets in _sets(batches, k, batch_words):
            digests = sets.digests()
            point: list = [None] * len(ids)
            for i, d in enumerate(digests):
                if d is not None and ids[i] is not None and d not in seen:  # a class is known by its members with ids
                    seen.add(d)
                    point[i] = pack_point(point_of(sets.one(i), STORED_BITS))
            columns = [pa.array(ids, pa.int64()), pa.array(digests, pa.binary()), pa.array(sets.sizes, pa.int64()), pa.array(point, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in PREPARED_SCHEMA.split(", ")])

    return _input(docs).mapInArrow(run, PREPARED_SCHEMA)


def shared_buckets(docs: DataFrame, k: int, num: int, den: int, batch_words: int = 200_000) -> DataFrame:
    """key, node, pivot for the members of every bucket with more than one; pivot: its smallest.

    Of equal sets in a task only the first is a member: they'd share all buckets. Keys go from the scan
    straight to the shuffle and are stored nowhere else."""

    def emit(batches):
        seen = set()
        for ids, sets in _sets(batches, k, batch_words):
            chosen = []
            for i, d in enumerate(sets.digests()):
                if d is not None and ids[i] is not None and d not in seen:
                    seen.add(d)
                    chosen.append(i)
            if chosen:
                keys = sets.keys(np.array(chosen), num, den)
                nodes = np.repeat(np.array([ids[i] for i in chosen], np.int64), [len(x) for x in keys])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(nodes)], names=["key", "node"])

    def runs(batches):
        """Rows come sorted by key and node; the last row of a batch and the run's first node are carried over."""
        key = node = pivot = held = None

        def out(k, n, p):
            return pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(n, pa.int64()), pa.array(p, pa.int64())], names=["key", "node", "pivot"])

        for b in batches:
            k, n = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            if not len(k):
                continue
            if key is not None:  # the carried row again in front
                k, n = np.concatenate([[key], k]), np.concatenate([[node], n])
            new = np.concatenate([[True], k[1:] != k[:-1]])
            first = np.maximum.accumulate(np.where(new, np.arange(len(k)), 0))
            p = n[first]
            if key is not None:
                p = np.where(first == 0, pivot, p)
            again = np.concatenate([[False], ~new[1:] & (n[1:] == n[:-1])])
            # a run's first row is reported once another node follows it
            has_more = np.zeros(len(k), bool)
            np.logical_or.at(has_more, first, n != p)
            report = (n != p) & ~again
            start = new & has_more
            if key is not None:
                report[0] = False  # it was reported with its own batch, if at all
                start[0] = has_more[0] and not held
            sel = np.flatnonzero(report | start)
            head = start[sel]
            yield out(k[sel], np.where(head, p[sel], n[sel]), p[sel])
            last = len(k) - 1
            held = bool(has_more[first[last]]) or (first[last] == 0 and key is not None and bool(held))
            key, node, pivot = k[last], n[last], p[last]

    rows = _input(docs).mapInArrow(emit, "key bigint, node bigint")
    return rows.repartition("key").sortWithinPartitions("key", "node").mapInArrow(runs, "key bigint, node bigint, pivot bigint")


def _maybe(ids: DataFrame, column: str, bits: int = 26) -> Column:
    """A condition that holds for all values of ``ids.column`` and few others: a bitmap over hashed ids of a fixed
    size (2 ** bits), shipped as binary. It only spares the shuffle of texts that the join would not match."""
    hashed = F.shiftrightunsigned(F.xxhash64(column), 64 - bits)
    words = ids.select(F.shiftright(hashed, 5).cast("int").alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), (hashed % 32).cast("int")).alias("b"))
    rows = words.groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()  # 2 ** (bits - 5) rows at most
    bitmap = np.zeros(1 << (bits - 5), np.uint32)
    bitmap[rows["w"].to_numpy()] = rows["b"].to_numpy().astype(np.uint32)
    shared = ids.sparkSession.sparkContext.broadcast(bitmap)

    @F.pandas_udf(BooleanType())
    def has(h: pd.Series) -> pd.Series:
        x = h.to_numpy()
        return pd.Series((shared.value[x >> 5] >> (x & 31).astype(np.uint32)) & 1 == 1)

    return has(hashed)


def verify(docs: DataFrame, pairs: DataFrame, families: DataFrame, k: int, num: int, den: int, part: int = 64) -> DataFrame:
    """Links (u, v) that connect what the linked ones among ``pairs`` (u, v, stored) connect.

    Nodes are dealt to blocks of about ``part`` within their family (node, family: any grouping that puts most
    partners together); a task gets the texts of two blocks, once each however many pairs they have, and these pairs.
    It compares a pair's points, then the sets, and skips what its links connect already."""
    nodes = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct().join(families, "node", "left").withColumn("family", F.coalesce("family", "node"))
    nodes = written(nodes, "jaccard-nodes")
    large = written(nodes.groupBy("family").agg(F.ceil(F.count("*") / part).alias("parts")).filter("parts > 1"), "jaccard-parts")
    own = F.pmod(F.xxhash64("node"), F.coalesce("parts", F.lit(1)))
    blocks = nodes.join(broadcast_if_small(large), "family", "left").select("node", F.struct("family", own.alias("part")).alias("block"))
    p = pairs.join(blocks.select(F.col("node").alias("u"), F.col("block").alias("x")), "u").join(blocks.select(F.col("node").alias("v"), F.col("block").alias("y")), "v")
    p = written(p.select("u", "v", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")), "jaccard-dealt")
    wanted = written(p.select(F.explode(F.array("u", "v")).alias("node"), "a", "b").distinct(), "jaccard-wanted")
    texts = _input(docs).withColumnRenamed("doc_id", "node").filter(_maybe(wanted.select("node"), "node"))

    def check(rows: pd.DataFrame, of: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates("node").sort_values("node")
        ids, out = rows["node"].to_numpy(), []
        sets = Sets([words_of(x) for x in rows["text"]], k, _WordHashes())
        n, points, root = sets.sizes, {}, np.arange(len(ids))
        us, vs = np.searchsorted(ids, of["u"].to_numpy()), np.searchsorted(ids, of["v"].to_numpy())
        for i, j in zip(us, vs):
            if root[i] == root[j] or n[i] * den < num * n[j] or n[j] * den < num * n[i]:
                continue
            for x in (i, j):
                if x not in points:
                    points[x] = point_of(sets.one(x))
            x, y = aligned([points[i], points[j]])
            if int(np.minimum(x, y).sum()) * (den + num) < num * int(n[i] + n[j]):
                continue
            shared = len(np.intersect1d(sets.one(i), sets.one(j), assume_unique=True))
            if den * shared >= num * (int(n[i] + n[j]) - shared):
                out.append((ids[i], ids[j]))
                root[root == root[i]] = root[j]
        return pd.DataFrame(out, columns=["u", "v"])

    dealt = texts.join(wanted, "node").select("node", "text", "a", "b").groupBy("a", "b")
    return dealt.cogroup(p.groupBy("a", "b")).applyInPandas(lambda rows, of: check(rows, of), "u bigint, v bigint")


def _first_pairs(rows: list[tuple], pivot: int, turn: int, num: int, den: int) -> list[tuple[int, int]]:
    """For each member the first other that its bound allows and that is in another component."""
    nodes, sizes, points, parts = (list(c) for c in zip(*dict((r[0], r) for r in rows).values()))
    if len(set(parts)) == 1:
        return []
    nodes, sizes, parts = np.array(nodes), np.array(sizes), np.array(parts)
    rank = nodes if turn == 0 else (_mix(nodes.astype(np.uint64) + np.uint64(turn)) >> np.uint64(1)).astype(np.int64)
    rank = np.where(nodes == pivot, np.iinfo(np.int64).min, rank) if turn == 0 else rank
    tree, out = CountTree(aligned([unpack_point(x) for x in points]), sizes), []
    for i in range(len(nodes)):
        j = tree.search(tree.points[i], int(sizes[i]), num, den)
        j = j[parts[j] != parts[i]]
        if len(j):
            j = j[rank[j].argmin()]
            out.append((min(nodes[i], nodes[j]), max(nodes[i], nodes[j])))
    return out


def _all_pairs(rows: list[tuple], low: int, high: int, num: int, den: int) -> list[tuple[int, int]]:
    """All pairs across components that their bounds allow, one of part ``low`` and one of part ``high``."""
    nodes, sizes, points, parts, own = (list(c) for c in zip(*rows))
    if len(set(parts)) == 1:
        return []
    nodes, sizes, parts, own = np.array(nodes), np.array(sizes), np.array(parts), np.array(own)
    tree, out = CountTree(aligned([unpack_point(x) for x in points]), sizes), []
    for i in np.flatnonzero(own == low):
        j = tree.search(tree.points[i], int(sizes[i]), num, den)
        j = j[(parts[j] != parts[i]) & ((own[j] == high) if low != high else (nodes[j] > nodes[i]))]
        out += [(min(nodes[i], x), max(nodes[i], x)) for x in nodes[j]]
    return out


def _per_group(rows: DataFrame, work, n_keys: int) -> DataFrame:
    """Distinct pairs (u, v) of work(key, rows) over the groups of the first ``n_keys`` columns."""
    keys = rows.columns[:n_keys]

    def run(batches):
        """Rows come sorted by key; a group that a batch cuts is carried over."""
        key, group, done = None, [], set()

        def flush():
            batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*done) if done else ([], []))], names=["u", "v"])
            done.clear()
            return batch

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if row[:n_keys] != key:
                    if len(group) > 1:
                        done.update(work(key, group))
                    key, group = row[:n_keys], []
                    if len(done) > 100_000:
                        yield flush()
                group.append(row[n_keys:])
        if len(group) > 1:
            done.update(work(key, group))
        yield flush()

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "u bigint, v bigint").distinct()


def tree_pairs(members: DataFrame, classes: DataFrame, found: DataFrame | None, turn: int | None, num: int, den: int, block: int = 512) -> DataFrame:
    """Candidate pairs (u < v, distinct) of the R-trees over the buckets ``members`` (pivot, node; the pivot is one of
    them). found: node, component so far (absent: the node itself); turn: 0 or 1 for one pair a member, None for all."""
    m = members
    if found is None:
        m = m.withColumn("component", F.col("node"))
    else:
        m = written(m.join(found, "node", "left").withColumn("component", F.coalesce("component", "node")), "jaccard-placed")
    stats = m.groupBy("pivot").agg(F.count("*").alias("n_members"), F.min("component").alias("p"), F.max("component").alias("q")).filter("p <> q")
    stats = written(stats.select("pivot", "n_members"), "jaccard-open")
    hot = broadcast_if_small(stats.filter(F.col("n_members") > block))
    points = classes.select(F.col("rep").alias("node"), "n", "point")
    cold_rows = m.join(hot.select("pivot"), "pivot", "left_anti") if found is None else m.join(hot.select("pivot"), "pivot", "left_anti").join(stats, "pivot", "left_semi")
    hot_rows = m.join(hot, "pivot").withColumn("parts", F.ceil(F.col("n_members") / block).cast("int"))
    part = F.pmod(F.xxhash64("node"), F.col("parts"))
    if turn is not None:
        each = F.when(F.col("node") == F.col("pivot"), F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1)).otherwise(F.array(part))
        rows = cold_rows.select("pivot", F.lit(0).cast("long").alias("low"), "node", "component").union(hot_rows.select("pivot", F.explode(each).alias("low"), "node", "component"))
        rows = rows.join(points, "node").select("pivot", "low", "node", "n", "point", "component")
        return _per_group(rows, lambda key, group: _first_pairs(group, key[0], turn, num, den), 2)
    hot_rows = hot_rows.join(points, "node").withColumn("slice", F.floor(F.log("n") * 4 / math.log(den / num) + 1e-9) if num < den else F.col("n"))
    sizes = written(hot_rows.groupBy("pivot", "slice").agg(F.ceil(F.count("*") / block).alias("parts")), "jaccard-slices")
    sizes = broadcast_if_small(sizes)
    code = lambda a, b: F.col(a) * (1 << 32) + b
    near = 5 if num < den else 0  # slices that linked sizes can be apart; one more for rounding
    h = hot_rows.drop("parts").join(sizes, ["pivot", "slice"]).withColumn("own", code("slice", F.pmod(F.xxhash64("node"), F.col("parts")))).drop("parts")
    h = h.withColumn("other_slice", F.explode(F.sequence(F.col("slice") - near, F.col("slice") + near)))
    h = h.join(sizes.withColumnRenamed("slice", "other_slice"), ["pivot", "other_slice"]).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    h = h.withColumn("other", code("other_slice", F.col("other")))
    cols = ["pivot", "low", "high", "node", "n", "point", "component", "own"]
    h = h.select("pivot", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), *cols[3:])
    zero = F.lit(0).cast("long")
    c = cold_rows.join(points, "node").select("pivot", zero.alias("low"), zero.alias("high"), "node", "n", "point", "component", zero.alias("own"))
    return _per_group(c.union(h), lambda key, group: _all_pairs(group, key[1], key[2], num, den), 3)


def near_duplicates(docs: DataFrame, k: int = 3, num: int = 90, den: int = 100, block: int = 512) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs`` (doc_id, text); linked: den * |A and B| >= num * |A or B|."""
    if not den <= 2 * num <= 2 * den:
        raise ValueError("the similarity must be between a half and one")
    prepared = written(prepare(docs, k), "jaccard-sets")
    named = prepared.filter("digest is not null and doc_id is not null")
    classes = written(named.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.max("point").alias("point")), "jaccard-classes")
    shared = written(shared_buckets(docs, k, num, den).select("node", "pivot").distinct(), "jaccard-buckets")
    # members by their class's representative; most are it themselves
    other = named.select(F.col("doc_id").alias("node"), "digest").join(classes.select("digest", "rep"), "digest").filter("node <> rep").select("node", "rep").distinct()
    other = written(other.join(shared.select(F.explode(F.array("node", "pivot")).alias("node")).distinct(), "node", "left_semi"), "jaccard-members")
    small = broadcast_if_small(other)
    met = shared.join(small, "node", "left").select(F.coalesce("rep", "node").alias("node"), "pivot")
    met = met.join(small.select(F.col("node").alias("pivot"), "rep"), "pivot", "left").select(F.coalesce("rep", "pivot").alias("pivot"), "node").filter("pivot <> node").distinct()
    met = written(met, "jaccard-met")
    members = written(met.union(met.select("pivot", F.col("pivot").alias("node")).distinct()), "jaccard-groups")
    # partners mostly have the same smallest pivot
    families = written(members.groupBy("node").agg(F.min("pivot").alias("family")), "jaccard-families")
    release(docs.sparkSession, shared)

    links, found = [], None
    for turn in (0, 1, None):
        pairs = written(tree_pairs(members, classes, found, turn, num, den, block), "jaccard-pairs")
        links.append(written(verify(docs, pairs, families, k, num, den), "jaccard-links"))
        found = written(components(functools.reduce(DataFrame.union, links)), "jaccard-components")
    r = prepared.select("doc_id", F.col("n").alias("n_shingles"), "digest").join(classes.select("digest", "rep"), "digest", "left")
    r = r.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left")
    return r.select("doc_id", "n_shingles", F.coalesce("component", "rep", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of their component.

    Of rows that share an id, those with different texts all stay and those with equal texts are one. Rows without an
    id are given one by a hash of their text, so that they link as others do and stay only where no row of their group
    has an id; texts that are null or without words link with nothing, but of rows without id and with one such text
    one stays."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # beyond all other ids, so that rows with an id go before
    made = F.coalesce(F.col("doc_id").cast("bigint"), F.shiftrightunsigned(F.xxhash64(text), 2) + (1 << 62))
    whole = docs.select(F.struct(*docs.columns).alias("row"), made.alias("doc_id"), text.alias("text"))
    found = near_duplicates(whole.select("doc_id", "text"), k, num, den)
    fate = written(found.groupBy("doc_id").agg(F.max(F.col("doc_id") != F.col("component_id")).alias("gone"), (F.count("*") > 1).alias("again")).filter("gone or again"), "jaccard-fates")
    kept = whole.join(fate, "doc_id", "left").filter(~F.coalesce("gone", F.lit(False)))
    repeated = written(kept.filter("again"), "jaccard-repeated").dropDuplicates(["doc_id", "text"])
    return kept.filter(~F.coalesce("again", F.lit(False))).select("row.*").union(repeated.select("row.*"))
