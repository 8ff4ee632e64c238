"""Quality classifier: a factorisation machine over hashed words and structure statistics.

score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f [(sum v_if x_i)^2 - sum v_if^2 x_i^2]): all pairwise
interactions in time linear in the number of distinct features of a text. Inputs come from the text
alone: its words (hashed by crc32), statistics of its structure, and its own size as metadata.

Training takes at most ``max_rows`` labelled documents (a documented bound, over pairs of id and text; chosen by their
hash, so that every run takes the same ones; a pair teaches once, however often it repeats) and fits on the driver with mini-batches; scoring is one
pass over all documents with the parameters of fixed size in the task.

Edge cases: null text is empty and scored like any other; without labels of both classes the score is
the smoothed share of label 1; repeated rows and equal texts get equal scores; null ids are kept and
count as crc32 of the empty text; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.shared import crc_mod, written

BUCKETS = 1 << 13
N_STATS = 18
N_FEATURES = BUCKETS + N_STATS
SCORE_SCHEMA = "doc_id bigint, score double"

_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGIT = bytes(range(48, 58))
_MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_PLAIN = b".,;:'\"!?()-"
_ODD = bytes(c for c in _MARKS if c not in _PLAIN)


def features_of(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of a whole text's features; indices may repeat (their values add up)."""
    raw = (text or "").encode()
    words = raw.lower().split()
    counts = Counter(words)
    n, size = len(words), max(1, len(raw))
    share = lambda chars: (size - len(raw.translate(None, chars)) - (size - len(raw))) / size
    lines = raw.split(b"\n")
    most = max(counts.values(), default=0)
    upper, lower = share(_UPPER), share(_LOWER)
    stats = [
        1.0, upper, lower, 4 * share(_DIGIT), 2 * share(_MARKS), 4 * share(_ODD), upper / (upper + lower + 1e-3),
        min(1.0, np.log1p(n) / 12), len(counts) / max(1, n), most / max(1, n), min(1.0, len(raw) / max(1, n) / 20),
        min(1.0, 10 * len(lines) / size), len(set(lines)) / len(lines), float(n == 0), float(n < 5),
        4 * raw.count(b"|") / size * 8, 4 * raw.count(b"!") / size * 4, share(bytes(range(128, 256))),
    ]
    idx = np.fromiter((zlib.crc32(w) for w in counts), np.int64, len(counts)) & (BUCKETS - 1)
    val = np.log1p(np.fromiter(counts.values(), np.float64, len(counts)))
    norm = float(np.sqrt((val * val).sum())) or 1.0
    return np.concatenate([idx, np.arange(BUCKETS, N_FEATURES)]), np.concatenate([val / norm, np.array(stats)])


@dataclass
class FactorisationMachine:
    w0: float
    w: np.ndarray
    v: np.ndarray

    def margin(self, idx: np.ndarray, val: np.ndarray) -> float:
        xv = self.v[idx] * val[:, None]
        s = xv.sum(0)
        return float(self.w0 + self.w[idx] @ val + 0.5 * (s @ s - (xv * xv).sum()))

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.margin(*features_of(text)), -30, 30))))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, rank: int = 4, epochs: int = 8, batch: int = 128, rate: float = 0.02, decay: float = 1e-4, seed: int = 11) -> FactorisationMachine:
    """Adam on the logistic loss."""
    rng = np.random.default_rng(seed)
    n, positive = len(labels), float(labels.sum())
    fm = FactorisationMachine(float(np.log((positive + 1) / (n - positive + 1))), np.zeros(N_FEATURES), rng.normal(0, 0.02, (N_FEATURES, rank)))
    if not 0 < positive < n:
        fm.v[:] = 0
        return fm
    p = np.concatenate([fm.w[:, None], fm.v], 1)
    m, u, step = np.zeros_like(p), np.zeros_like(p), 0
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(n), max(1, n // batch)):
            idx, val = (np.concatenate([rows[i][k] for i in part]) for k in (0, 1))
            at = np.concatenate([[0], np.cumsum([len(rows[i][0]) for i in part])[:-1]])
            row = np.repeat(np.arange(len(part)), [len(rows[i][0]) for i in part])
            xv = p[idx, 1:] * val[:, None]
            s = np.add.reduceat(xv, at)
            f = fm.w0 + np.add.reduceat(p[idx, 0] * val, at) + 0.5 * ((s * s).sum(1) - np.add.reduceat((xv * xv).sum(1), at))
            g = (1 / (1 + np.exp(-np.clip(f, -30, 30))) - labels[part]) / len(part)
            each = np.concatenate([val[:, None], val[:, None] * (s[row] - xv)], 1) * g[row][:, None]
            grad = np.stack([np.bincount(idx, each[:, k], N_FEATURES) for k in range(rank + 1)], 1) + decay * p
            step += 1
            m += 0.1 * (grad - m)
            u += 0.01 * (grad * grad - u)
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(u / (1 - 0.99**step)) + 1e-8)
            fm.w0 -= rate * float(g.sum())
    fm.w, fm.v = p[:, 0].copy(), p[:, 1:].copy()
    return fm


def train(docs: DataFrame, labels: DataFrame, may_learn: Column, max_rows: int = 12_000) -> FactorisationMachine:
    """Fit on at most ``max_rows`` labelled documents for which ``may_learn`` (of doc_id) holds."""
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & may_learn).select("doc_id", F.col("quality").cast("int").alias("label"))
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    text = F.coalesce(F.xxhash64("text"), F.lit(0)).alias("_h")
    seen = docs.select("doc_id", text).join(known, "doc_id").distinct()  # a row per id and text, however often it repeats
    chosen = written(seen.orderBy(F.xxhash64("doc_id", "_h"), "doc_id", "_h").limit(max_rows), "quality-chosen")

    def extract(batches):
        for b in batches:
            found = [features_of(x.as_py()) for x in b.column(0)]
            idx, val = ([x[k].astype(t).tobytes() for x in found] for k, t in ((0, np.int32), (1, np.float32)))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(idx, pa.binary()), pa.array(val, pa.binary())], names=["doc_id", "_h", "label", "idx", "val"])

    hit = docs.select("doc_id", "text", text).join(F.broadcast(chosen), ["doc_id", "_h"]).select("text", F.col("doc_id").cast("bigint").alias("doc_id"), "_h", "label")
    found = hit.mapInArrow(extract, "doc_id bigint, _h bigint, label int, idx binary, val binary")
    rows = found.groupBy("doc_id", "_h").agg(*(F.first(c).alias(c) for c in ("label", "idx", "val"))).collect()  # as many as were chosen
    rows.sort(key=lambda r: (bytes(r["idx"]), r["label"]))  # the order of tasks must not matter
    return fit([(np.frombuffer(r["idx"], np.int32).astype(np.int64), np.frombuffer(r["val"], np.float32).astype(float)) for r in rows], np.array([r["label"] for r in rows], float))


def score_documents(docs: DataFrame, fm: FactorisationMachine) -> DataFrame:
    """doc_id and score of every row."""

    def score(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fm.score(x.as_py()) for x in b.column(1)], pa.float64())], names=["doc_id", "score"])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").mapInArrow(score, SCORE_SCHEMA)


def classify(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1, max_rows: int = 12_000) -> DataFrame:
    """doc_id, held_out, score, predicted; nothing is learnt from the held-out fold."""
    fm = train(docs, labels, crc_mod("doc_id", folds) != held_out, max_rows)
    scored = score_documents(docs, fm)
    return scored.select("doc_id", (crc_mod("doc_id", folds) == held_out).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1, max_rows: int = 12_000) -> DataFrame:
    """The rows of ``docs`` that are predicted good, with all their columns: filtered in one pass, no join back."""
    fm = train(docs, labels, crc_mod("doc_id", folds) != held_out, max_rows)

    def keep(batches):
        for b in batches:
            text = b.column(b.schema.get_field_index("text"))
            yield b.filter(pa.array([fm.score(x.as_py()) >= 0.5 for x in text], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
