"""Embedding near-duplicates with navigable small-world graphs.

Equal vectors are one class with a size; only classes are compared. Classes are dealt by a hash of their id to
shards of bounded bytes. A task builds one shard's hierarchical navigable small-world graph (Malkov and Yashunin,
2018) in batches, audits it and stores it in the shared folder. The audit runs known queries and widens the beam
until the walks find the wanted share of the links that an exhaustive scan of the shard finds: the shard's own vectors
in the order of a hash (all, if there are few), and queries planted at the wanted cosine of stored vectors, so that
every audit sees links. Self-links don't count. A graph that no beam repairs is scanned exhaustively.

Each unordered pair of shards is searched from one side, in blocks of queries; the work list is a table. Queries whose
beam is full of links are searched again with a wider one, and by a scan beyond ``WIDEST``. Similarities are single
precision; those within its error of the limit are decided in double precision from the stored exact rows.
A block reports a count and a tree root per vector, never its pairs, so that big groups don't grow the output
with their square. Counts are added, roots are joined to components.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components link with
nothing and form their own component, and so do rows without an id (component null, kept); vectors of
different length never link; rows that repeat an id are one vector (the smallest value counts) and all
get its result; an empty table gives an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import io
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.components import components
from quillon.llm.shared import ByteStore, broadcast_if_small, read_at, shared_dir, written

#: The widest beam of a walk; what is full of links even then is scanned.
WIDEST = 1024


class Graph:
    """A graph over unit vectors. ``layers[l]`` maps each node to its neighbours (-1: none)."""

    def __init__(self, x: np.ndarray, degree: int = 12, beam: int = 32, seed: int = 3):
        self.x = np.ascontiguousarray(x, np.float32)
        n = len(x)
        level = np.minimum((-np.log(np.random.default_rng(seed).random(n) + 1e-300) / np.log(degree)).astype(int), 6)
        order = np.argsort(-level, kind="stable")  # the upper layers are complete before the lower ones grow
        self.layers = [np.full((n, degree * (2 if l == 0 else 1)), -1, np.int32) for l in range(int(level.max(initial=0)) + 1)]
        self.entry = int(order[0]) if n else -1
        for l in range(len(self.layers) - 1, -1, -1):
            nodes, done = order[: int((level >= l).sum())], 0
            while done < len(nodes):
                part = nodes[done : done + max(64, min(2048, done // 2))]
                self._insert(part, nodes[:done], l, degree, beam)
                done += len(part)

    @classmethod
    def load(cls, x: np.ndarray, data: bytes) -> Graph:
        """The graph over ``x`` whose links ``dump`` wrote."""
        g = cls.__new__(cls)
        g.x = x
        with np.load(io.BytesIO(data)) as z:
            g.entry = int(z["entry"])
            g.layers = [z[f"l{i}"] for i in range(int(z["n"]))]
        return g

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, entry=self.entry, n=len(self.layers), **{f"l{i}": a for i, a in enumerate(self.layers)})
        return out.getvalue()

    def _insert(self, part: np.ndarray, before: np.ndarray, layer: int, degree: int, beam: int) -> None:
        q = self.x[part]
        ids = np.full((len(part), 0), -1, np.int64)
        sims = np.zeros((len(part), 0), np.float32)
        if len(before):
            ids, sims = self.search(q, beam, layer, skip=part)
        own = q @ q.T
        np.fill_diagonal(own, -np.inf)
        k = min(beam, len(part))
        near = np.argpartition(-own, k - 1, axis=1)[:, :k]
        near_sims = np.take_along_axis(own, near, 1)
        ids = np.concatenate([ids, np.where(np.isfinite(near_sims), part[near], -1)], 1)
        sims = np.concatenate([sims, near_sims], 1)
        chosen = self._diverse(ids, sims, degree)
        wide = self.layers[layer].shape[1]
        self.layers[layer][part, :degree] = chosen
        source = np.repeat(part, degree)[chosen.ravel() >= 0]
        target = chosen.ravel()[chosen.ravel() >= 0]
        # links back: each target takes its old and new neighbours and chooses again where they are too many
        s = np.einsum("nd,nd->n", self.x[source], self.x[target])
        o = np.lexsort((-s, target))
        target, source = target[o], source[o]
        heads, begin, counts = np.unique(target, return_index=True, return_counts=True)
        rank = np.arange(len(target)) - np.repeat(begin, counts)
        fresh = np.full((len(heads), min(int(counts.max(initial=0)), wide)), -1, np.int64)
        ok = rank < fresh.shape[1]
        fresh[np.repeat(np.arange(len(heads)), counts)[ok], rank[ok]] = source[ok]
        for i in range(0, len(heads), 2048):
            h = heads[i : i + 2048]
            both = np.concatenate([self.layers[layer][h].astype(np.int64), fresh[i : i + 2048]], 1)
            sim = np.einsum("nd,nkd->nk", self.x[h], self.x[both])
            self.layers[layer][h] = self._diverse(both, np.where(both >= 0, sim, -np.inf), wide)

    def _diverse(self, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """At most so many of the candidates: those nearer to the node than to one chosen already, then the nearest others."""
        n, width = len(ids), min(ids.shape[1], 2 * most)
        sims = np.where(ids >= 0, sims, -np.inf)
        o = np.argsort(-sims, axis=1, kind="stable")[:, :width]
        ids, sims = np.take_along_axis(ids, o, 1), np.take_along_axis(sims, o, 1)
        so = np.sort(ids, axis=1)
        if (so[:, 1:] == so[:, :-1])[so[:, 1:] >= 0].any():  # the same candidate twice
            s = np.argsort(ids, axis=1, kind="stable")
            twice = np.zeros_like(ids, bool)
            np.put_along_axis(twice, s[:, 1:], np.take_along_axis(ids, s, 1)[:, 1:] == np.take_along_axis(ids, s, 1)[:, :-1], 1)
            ids = np.where(twice, -1, ids)
            sims = np.where(ids >= 0, sims, -np.inf)
        out = np.full((n, most), -1, np.int64)
        for i in range(0, n, 512):
            c, s = ids[i : i + 512], sims[i : i + 512]
            v = self.x[c]
            between = v @ v.transpose(0, 2, 1)
            good = np.zeros(c.shape, bool)
            for j in range(c.shape[1]):
                rival = np.where(good, between[:, j], -np.inf).max(1, initial=-np.inf)
                good[:, j] = (c[:, j] >= 0) & (rival < s[:, j])
            rank = np.where(good, 0, 1) + np.where(c >= 0, 0, 2)
            pick = np.argsort(rank, axis=1, kind="stable")[:, :most]
            kept = np.take_along_axis(c, pick, 1)
            out[i : i + 512, : kept.shape[1]] = kept
        return out

    def search(self, q: np.ndarray, beam: int, layer: int = 0, skip: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids (-1: none) and similarities of the beam of each query at a layer, by greedy descent from the top."""
        q = np.ascontiguousarray(q, np.float32)
        wide = max(1, min(64, beam // 8))
        rows = max(8, min(1024, 2_000_000 // (wide * self.layers[layer].shape[1]), 40_000_000 // max(1, len(self.x))))
        found = [self._search(q[i : i + rows], beam, layer, wide) for i in range(0, len(q), rows)]
        if not found:
            return np.full((0, beam), -1, np.int64), np.zeros((0, beam), np.float32)
        ids, sims = (np.concatenate(c) for c in zip(*found))
        return ids, sims

    def _search(self, q: np.ndarray, beam: int, layer: int, wide: int):
        entry = np.full((len(q), 1), self.entry, np.int64)
        for l in range(len(self.layers) - 1, layer, -1):
            ids, sims = self._walk(q, entry, 2, l, 1)
            entry = ids[:, :1]
        return self._walk(q, entry, beam, layer, wide)

    def _walk(self, q, entry, beam, layer, wide):
        n, links = len(q), self.layers[layer]
        ids = np.full((n, beam), -1, np.int64)
        sims = np.full((n, beam), -np.inf, np.float32)
        open_ = np.zeros((n, beam), bool)
        ids[:, 0] = entry[:, 0]
        sims[:, 0] = np.einsum("nd,nd->n", q, self.x[entry[:, 0]])
        open_[:, 0] = True
        seen = np.zeros((n, len(self.x) + 1), bool)  # the last column takes the missing neighbours
        seen[:, -1] = True
        seen[np.arange(n), entry[:, 0]] = True
        live = np.arange(n)
        while len(live):
            rank = np.where(open_[live], sims[live], -np.inf)
            w = min(wide, beam)
            top = np.argpartition(-rank, w - 1, axis=1)[:, :w] if w < beam else np.broadcast_to(np.arange(beam), rank.shape)
            ok = np.take_along_axis(rank, top, 1) > -np.inf
            node = np.where(ok, np.take_along_axis(ids[live], top, 1), -1)
            open_[live[:, None], top] = False
            new = np.where(node[:, :, None] >= 0, links[node], -1).reshape(len(live), -1)
            new.sort(axis=1)
            new[:, 1:][new[:, 1:] == new[:, :-1]] = -1
            new = np.where(seen[live[:, None], new], -1, new)
            seen[live[:, None], new] = True
            r, c = np.nonzero(new >= 0)
            s = np.full(new.shape, -np.inf, np.float32)
            s[r, c] = np.einsum("nd,nd->n", q[live[r]], self.x[new[r, c]])
            all_ids = np.concatenate([ids[live], new], 1)
            all_sims = np.concatenate([sims[live], s], 1)
            all_open = np.concatenate([open_[live], new >= 0], 1)
            keep = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
            ids[live], sims[live], open_[live] = (np.take_along_axis(a, keep, 1) for a in (all_ids, all_sims, all_open))
            live = live[(open_[live] & (sims[live] > -np.inf)).any(1)]
        o = np.argsort(-sims, axis=1, kind="stable")
        ids, sims = np.take_along_axis(ids, o, 1), np.take_along_axis(sims, o, 1)
        return np.where(sims > -np.inf, ids, -1), sims


def slack_of(dim: int) -> float:
    """A bound of the error of a single-precision cosine."""
    return 1e-5 + 2.5e-7 * dim


def _scan(graph: Graph, q: np.ndarray, least: float):
    """(queries, nodes, similarities) of all pairs with similarity >= least, a few queries at a time."""
    for i in range(0, len(q), 64):
        sims = q[i : i + 64] @ graph.x.T
        r, c = np.nonzero(sims >= least)
        yield r + i, c, sims[r, c]


def _walk_links(graph: Graph, q: np.ndarray, least: float, beam: int):
    """As ``_scan``, but the pairs that walks with the beam find."""
    n = len(graph.x)
    todo, width = np.arange(len(q)), min(beam, n)
    while len(todo):
        ids, sims = graph.search(q[todo], width)
        hit = (ids >= 0) & (sims >= least)
        full = hit.all(1) & (width < n)  # more links may lie beyond the beam
        r, c = np.nonzero(hit & ~full[:, None])
        yield todo[r], ids[r, c], sims[r, c]
        todo, width = todo[full], 4 * width
        if width > min(WIDEST, n):
            for r, c, s in _scan(graph, q[todo], least) if len(todo) else ():
                yield todo[r], c, s
            return


def found_links(graph: Graph, q: np.ndarray, least: float, beam: int):
    """Chunks of (queries, nodes, similarities) with similarity >= least; beam 0: by a scan."""
    return _walk_links(graph, q, least, beam) if beam else _scan(graph, q, least)


def planted(x: np.ndarray, rows: np.ndarray, least: float, seed: int = 13) -> np.ndarray:
    """A unit vector for each of the rows, between just the cosine ``least`` and 1 from it."""
    rng = np.random.default_rng(seed)
    v = x[rows].astype(np.float64)
    noise = rng.normal(size=v.shape)
    noise -= np.einsum("nd,nd->n", noise, v)[:, None] * v
    noise /= np.maximum(np.linalg.norm(noise, axis=1, keepdims=True), 1e-12)
    c = least + (1 - least) * (0.02 + 0.96 * rng.random((len(v), 1)))
    return (c * v + np.sqrt(1 - c * c) * noise).astype(np.float32)


def audited_beam(graph: Graph, ids: np.ndarray, least: float, recall: float = 0.999, beam: int = 16, audit_rows: int = 2048, planted_rows: int = 256) -> int:
    """The least beam whose walks find the wanted share of the audited links, 0 if none up to WIDEST does."""
    n = len(graph.x)
    own = np.argsort(ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), kind="stable")[:audit_rows]
    q = np.concatenate([graph.x[own], planted(graph.x, own[:planted_rows], least)])
    me = np.concatenate([own, np.full(len(q) - len(own), -1)])  # a stored vector's link to itself doesn't count

    def links(chunks) -> int:
        return sum(int((me[r] != c).sum()) for r, c, _ in chunks)

    true = links(_scan(graph, q, least))
    while beam < min(n, 2 * WIDEST):
        if true - links(_walk_links(graph, q, least, beam)) <= (1 - recall) * true:
            return beam
        beam *= 2
    return 0


class Shard:
    """A stored shard: rows of (id, weight, unit vector in single precision), the exact unit vectors, the graph's links."""

    def __init__(self, store: ByteStore, name: str, n: int, dim: int):
        self.store, self.name, self.n, self.dim = store, name, n, dim
        self.row = np.dtype([("id", "<i8"), ("weight", "<i8"), ("x", "<f4", (dim,))])
        self.files: dict = {}

    def save(self, ids: np.ndarray, weights: np.ndarray, exact: np.ndarray, graph: Graph) -> None:
        rows = np.empty(self.n, self.row)
        rows["id"], rows["weight"], rows["x"] = ids, weights, graph.x
        self.store.put(f"{self.name}.rows", rows.tobytes())
        self.store.put(f"{self.name}.exact", exact.astype("<f8").tobytes())
        self.store.put(f"{self.name}.links", graph.dump())

    def _file(self, kind: str):
        if kind not in self.files:
            self.files[kind] = self.store.open(f"{self.name}.{kind}")
        return self.files[kind]

    def close(self) -> None:
        for f in self.files.values():
            f.close()
        self.files = {}

    def rows(self, first: int = 0, count: int | None = None) -> np.ndarray:
        count = min(self.n - first, self.n if count is None else count)
        return np.frombuffer(read_at(self._file("rows"), first * self.row.itemsize, count * self.row.itemsize), self.row)

    def graph(self) -> tuple[Graph, np.ndarray, np.ndarray]:
        rows, links = self.rows(), self._file("links")
        return Graph.load(np.ascontiguousarray(rows["x"]), read_at(links, 0, links.size())), rows["id"].copy(), rows["weight"].copy()

    def exact(self, at: np.ndarray) -> np.ndarray:
        """Exact rows at positions: one range each if they are few, else the stretch that holds them."""
        need, back = np.unique(at, return_inverse=True)
        f, width = self._file("exact"), 8 * self.dim
        if len(need) * 16 < need[-1] - need[0]:
            got = np.stack([np.frombuffer(read_at(f, int(i) * width, width), "<f8") for i in need])
        else:
            stretch = np.frombuffer(read_at(f, int(need[0]) * width, int(need[-1] - need[0] + 1) * width), "<f8").reshape(-1, self.dim)
            got = stretch[need - need[0]]
        return got[back]


class _Forest:
    """Roots of nodes 0..n-1; a root is the smallest number in its tree."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self, at: np.ndarray) -> np.ndarray:
        r = self.up[at]
        while True:
            above = self.up[r]
            if (above == r).all():
                return r
            r = above

    def join(self, at: np.ndarray) -> None:
        r = np.unique(self.roots(at))
        self.up[r] = r[0]
        self.up[at] = r[0]


def block_links(graph: Graph, ids: np.ndarray, weights: np.ndarray, mine: Shard, queries: Shard, first: int, count: int, least: float, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, n, root) of the vectors that a block of queries links: how many vectors each is linked with by this
    block, and the id that stands for its tree. Within one shard each query counts for itself alone."""
    part, slack = queries.rows(first, count), slack_of(mine.dim)
    same, n = mine.name == queries.name, len(ids)
    all_ids = ids if same else np.concatenate([ids, part["id"]])
    at_query = np.arange(len(part)) + (first if same else n)
    linked, forest = np.zeros(len(all_ids), np.int64), _Forest(len(all_ids))
    for r, c, s in found_links(graph, np.ascontiguousarray(part["x"]), least - slack, beam):
        other = at_query[r] != c
        r, c, s = r[other], c[other], s[other]
        for i in np.array_split(np.flatnonzero(s < least + slack), -(-len(s) // 4096)) if len(s) else ():  # too close to tell
            if len(i):
                s[i] = np.where(np.einsum("nd,nd->n", queries.exact(first + r[i]), mine.exact(c[i])) >= least, 1.0, -1.0)
        r, c = r[s >= least], c[s >= least]
        np.add.at(linked, at_query[r], weights[c])
        if not same:
            np.add.at(linked, c, part["weight"][r])
        o = np.argsort(r, kind="stable")
        r, c = r[o], c[o]
        heads, begin = np.unique(r, return_index=True)
        for head, nodes in zip(heads, np.split(c, begin[1:])):
            forest.join(np.append(nodes, at_query[head]))
    met = np.flatnonzero((linked > 0) | (forest.up != np.arange(len(all_ids))))
    return all_ids[met], linked[met], all_ids[forest.roots(met)]


def embedding_links(classes: DataFrame, least: float = 0.9, shard_rows: int = 65_536, shard_bytes: int = 32 << 20, block_rows: int = 2048, recall: float = 0.999) -> DataFrame:
    """node, n, root rows of ``classes`` (rep, size, embedding array<double>, all valid and different, ids distinct):
    by parts, how many vectors a class is linked with, and a class of the same component. The classes' sizes count."""
    spark = classes.sparkSession
    sizes = classes.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n")).collect()  # a row a length
    shards = {r["dim"]: max(1, -(-r["n"] // max(1, min(shard_rows, shard_bytes // (4 * r["dim"]))))) for r in sizes} or {0: 1}
    root = shared_dir(spark, "hnsw")

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rep")
        exact = np.stack(rows["embedding"].to_numpy()).astype(np.float64)
        exact /= np.abs(exact).max(1, keepdims=True)  # so that squares neither vanish nor overflow
        exact /= np.linalg.norm(exact, axis=1, keepdims=True)
        ids = rows["rep"].to_numpy(np.int64)
        graph, shard = Graph(exact), Shard(ByteStore(root), f"shard-{uuid.uuid4().hex}", len(rows), key[0])
        shard.save(ids, rows["size"].to_numpy(np.int64), exact, graph)
        return pd.DataFrame({"dim": [key[0]], "shard": [key[1]], "name": [shard.name], "n": [len(rows)], "beam": [audited_beam(graph, ids, least, recall)]})

    count = F.element_at(F.create_map(*(F.lit(x) for kv in shards.items() for x in kv)), F.col("dim"))
    keyed = classes.withColumn("dim", F.size("embedding")).withColumn("shard", F.pmod(F.xxhash64("rep"), count).cast("int"))
    built = written(keyed.groupBy("dim", "shard").applyInPandas(build, "dim int, shard int, name string, n bigint, beam bigint"), "hnsw-shards")
    # the work list: every shard with itself and those after it, in blocks of queries; by range, so that a task keeps a graph
    pairs = built.select("dim", F.col("name").alias("queries"), F.col("n").alias("n_queries"), F.explode(F.sequence("shard", count - 1)).alias("shard"))
    work = pairs.join(built, ["dim", "shard"]).select("dim", "name", "n", "beam", "queries", "n_queries", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_queries") - 1, F.lit(block_rows).cast("long"))).alias("first"))
    jobs = sum(shards[r["dim"]] * (shards[r["dim"]] + 1) // 2 * -(-r["n"] // (shards[r["dim"]] * block_rows)) for r in sizes)
    work = work.repartitionByRange(max(1, min(jobs, 20_000)), "name", "queries", "first")

    def run(batches):
        store, held, graph = ByteStore(root), None, None
        for b in batches:
            for job in b.to_pylist():
                if held is None or held.name != job["name"]:
                    if held:
                        held.close()
                    held = Shard(store, job["name"], job["n"], job["dim"])
                    graph = held.graph()
                queries = Shard(store, job["queries"], job["n_queries"], job["dim"])
                found = block_links(*graph, held, queries, job["first"], block_rows, least, job["beam"])
                queries.close()
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["node", "n", "root"])

    return work.mapInArrow(run, "node bigint, n bigint, root bigint")


def near_duplicates(embeddings: DataFrame, least: float = 0.9, shard_rows: int = 65_536, shard_bytes: int = 32 << 20, recall: float = 0.999) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``embeddings`` (vec_id, embedding)."""
    e = embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    fine = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    valid = e.filter(F.coalesce(fine, F.lit(False))).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    # equal vectors by 128 bits of hashes
    valid = written(valid.withColumn("h", F.xxhash64("embedding")).withColumn("k", F.xxhash64(F.lit(17), "embedding")), "hnsw-vectors")
    classes = written(valid.groupBy("h", "k").agg(F.min("vec_id").alias("rep"), F.count("*").alias("size")), "hnsw-classes")
    whole = valid.select(F.col("vec_id").alias("rep"), "embedding").join(classes.select("rep", "size"), "rep")
    links = written(embedding_links(written(whole, "hnsw-class-vectors"), least, shard_rows, shard_bytes, recall=recall), "hnsw-links")
    counts = links.groupBy("node").agg(F.sum("n").alias("n"))
    found = components(links.filter("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v")))
    per_class = classes.join(counts, F.col("rep") == F.col("node"), "left").drop("node").join(found, F.col("rep") == F.col("node"), "left")
    per_class = per_class.select("h", "k", "rep", (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    per_class = written(per_class.filter("n_links > 0"), "hnsw-linked")
    r = valid.select("vec_id", "h", "k").join(broadcast_if_small(per_class), ["h", "k"]).select(F.col("vec_id").alias("id"), "n_links", "component")
    r = e.select("vec_id").join(r, F.col("vec_id") == F.col("id"), "left")
    component = F.coalesce("component", "vec_id")
    return r.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
