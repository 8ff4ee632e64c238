"""Hidden Markov language model over the words of documents.

Counts of all training words are aggregated (per task first, then shuffled by word). The states emit
symbols: the most frequent words have a symbol of their own, all others share classes (crc32 of the
word). Baum-Welch runs over all training documents: each pass computes expected counts per task, and
Spark sums them by parameter. A last pass sums, for every frequent word of a class, how often each
state is expected to have emitted it. Within its class and a state a word then has the share

    P(word | state, class) = (g / q + 1) / (class total + class types + 1),

g its expected count in the state and q the state's share of the class's frequent words; a rare word,
known by its count c alone, has c in place of g / q, an unknown word 0. As g over all states sums to c,
this is add-one smoothing, and what a state emits sums to 1. The scaled forward recursion gives the
exact log likelihood of each whole sequence of words.

What travels: documents are encoded once (two bytes a token, four more for a word of a class) and
stored; only words outside the broadcast list of frequent words (``hot_words`` at most, a fixed bound)
are joined with the counts. Words in that join are, by construction, not the frequent ones, so no key
is hot there; words that only held-out documents repeat have no counts and are dealt by adaptive
execution.

Edge cases: null text has the end token alone; without training documents all counts are 0 and the
score falls back on one unknown word's share; repeated rows are scored each; null ids count as
crc32 of the empty text; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.shared import crc_mod, words_of, written

#: The end token; no word holds a line feed.
END = b"\n"
ENCODED_SCHEMA = (
    "rid bigint, doc_id bigint, held_out boolean, n_tokens bigint, hot_known bigint, hot_log double, class_log double, "
    "symbols binary, places binary, words array<binary>, counts array<int>"
)


def count_words(texts: DataFrame, flush: int = 400_000) -> DataFrame:
    """word (binary), c over all ``texts`` (text); each text adds one END."""

    def count(batches):
        c: Counter = Counter()

        def out():
            batch = pa.RecordBatch.from_arrays([pa.array(list(c), pa.binary()), pa.array(list(c.values()), pa.int64())], names=["word", "c"])
            c.clear()
            return batch

        for b in batches:
            for x in b.column(0):
                c.update(words_of(x.as_py()))
                c[END] += 1
                if len(c) > flush:  # partial counts, so that memory is bounded
                    yield out()
        yield out()

    return texts.selectExpr("cast(text as string) text").mapInArrow(count, "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Alphabet:
    """Counts of the frequent words, their symbols, and the totals of the classes that hold the rest."""

    hot: dict[bytes, int]
    own: dict[bytes, int]
    class_total: np.ndarray
    n: int
    types: int
    level: int

    @property
    def size(self) -> int:
        return len(self.own) + len(self.class_total)

    def klass(self, word: bytes) -> int:
        return zlib.crc32(word) % len(self.class_total)


def _level(c: str) -> Column:
    """Counts on a logarithmic scale of 16 steps to a doubling."""
    return F.floor(F.log2(c) * 16).cast("int")


def alphabet(counts: DataFrame, own_words: int = 4096, hot_words: int = 100_000, classes: int = 1024) -> Alphabet:
    # the frequent words are those from a level of counts on, so that no top list travels from each task
    sizes, level = counts.groupBy(_level("c").alias("k")).agg(F.count("*").alias("v")).collect(), 0  # a row a level
    for r in sorted(sizes, reverse=True):
        hot_words -= r["v"]
        if hot_words < 0:
            level = r["k"] + 1
            break
    # END always has its own symbol and its count, whatever the level: it is never looked up among the rare words
    top = sorted(counts.filter((_level("c") >= level) | (F.col("word") == F.lit(END))).collect(), key=lambda r: (-r["c"], bytes(r["word"])))  # hot_words + 1 at most
    hot = {bytes(r["word"]): r["c"] for r in top}
    own = {END: 0} | {w: i for i, w in enumerate((w for w in list(hot)[:own_words] if w != END), 1)}
    total = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    by_class = counts.groupBy((F.crc32("word") % classes).alias("k")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()  # classes rows
    z = np.ones(classes)
    for r in by_class:
        z[r["k"]] += r["n"] + r["v"]
    for w in own:
        if w in hot:
            z[zlib.crc32(w) % classes] -= hot[w] + 1
    return Alphabet(hot, own, z, total["n"] or 0, total["v"] or 0, level)


def encode(docs: DataFrame, abc, modulus: int, held_out: int) -> DataFrame:
    """Rows of ENCODED_SCHEMA; ``abc``: a broadcast Alphabet. ``places`` tells which word each token of a class is: its
    number in the list of frequent words, or that list's length; ``words`` are the row's other words."""

    def run(batches):
        a: Alphabet = abc.value
        rid = TaskContext.get().partitionId() << 36  # the split, and so the row, is the same when a task runs again
        log_hot = {w: math.log10(c + 1) for w, c in a.hot.items()}
        number = {w: i for i, w in enumerate(a.hot)}
        log_z = np.log10(a.class_total)
        base, known = len(a.own), dict(a.own)  # word -> symbol, kept for the words that come again
        for b in batches:
            out = []
            for x in b.column(1):
                words = words_of(x.as_py())
                words.append(END)
                counts = Counter(words)
                hot_known, hot_log, class_log, tail, times = 0, 0.0, 0.0, [], []
                symbol, place = np.empty(len(counts), np.uint16), np.empty(len(counts), np.int32)
                for i, (w, n) in enumerate(counts.items()):
                    s = known.get(w)
                    if s is None:
                        if len(known) > 500_000:
                            known = dict(a.own)
                        s = known[w] = base + a.klass(w)
                    lw = log_hot.get(w)
                    if lw is not None:
                        hot_known += n
                        hot_log += n * lw
                        place[i] = number[w]
                    else:
                        place[i] = len(number)
                        tail.append(w)
                        times.append(n)
                    if s >= base:
                        class_log += n * ((lw or 0.0) - log_z[s - base])
                    symbol[i], counts[w] = s, i
                at = np.fromiter((counts[w] for w in words), np.int32, len(words))
                symbols = symbol[at]
                out.append((rid, len(words), hot_known, hot_log, class_log, symbols.tobytes(), place[at][symbols >= base].tobytes(), tail, times))
                rid += 1
            c = list(zip(*out)) if out else [[]] * 9
            arrays = [pa.array(c[0], pa.int64()), b.column(0), b.column(2), pa.array(c[1], pa.int64()), pa.array(c[2], pa.int64()), pa.array(c[3], pa.float64()), pa.array(c[4], pa.float64()), pa.array(c[5], pa.binary()), pa.array(c[6], pa.binary()), pa.array(c[7], pa.list_(pa.binary())), pa.array(c[8], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in ENCODED_SCHEMA.split(", ")])

    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), (crc_mod("doc_id", modulus) == held_out).alias("held_out"))
    return d.mapInArrow(run, ENCODED_SCHEMA)


@dataclass
class Hmm:
    start: np.ndarray  # (k,)
    step: np.ndarray  # (k, k)
    emit: np.ndarray  # (symbols, k)

    @staticmethod
    def seeded(k: int, symbols: int, seed: int = 5) -> Hmm:
        rng = np.random.default_rng(seed)
        emit = rng.gamma(1.0, size=(symbols, k)) + 0.05
        return Hmm(np.full(k, 1 / k), np.full((k, k), 0.1 / max(1, k - 1)) + np.eye(k) * (0.9 - 0.1 / max(1, k - 1)) if k > 1 else np.ones((1, 1)), emit / emit.sum(0))


    def stationary(self, steps: int = 64) -> np.ndarray:
        """The distribution of a state far from the document's start."""
        return self.start @ np.linalg.matrix_power(self.step, steps)


def _chunks(seqs: list[np.ndarray], tokens: int):
    """Lists of sequences, longest first, of about so many tokens."""
    part, n = [], 0
    for s in sorted(seqs, key=len, reverse=True):
        part.append(s)
        n += len(s)
        if n >= tokens:
            yield part
            part, n = [], 0
    if part:
        yield part


def _layout(seqs: list[np.ndarray], beside: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
    """Symbols of non-empty sequences (longest first) time by time: the symbols, where each time begins, how many go on,
    and ``beside`` (an integer a symbol) in the same order."""
    lengths = np.array([len(s) for s in seqs])
    active = len(seqs) - np.searchsorted(lengths[::-1], np.arange(lengths[0]), side="right")
    begin = np.concatenate([[0], np.cumsum(active)])
    t = np.concatenate([np.arange(n) for n in lengths])
    to = begin[t] + np.repeat(np.arange(len(seqs)), lengths)

    def put(x):
        flat = np.concatenate(x)
        out = np.empty_like(flat)
        out[to] = flat
        return out

    return put(seqs), begin, active, None if beside is None else put(beside)


def forward(hmm: Hmm, seqs: list[np.ndarray], rows: list[np.ndarray] | None = None, factors: np.ndarray | None = None) -> np.ndarray:
    """log10 likelihood of each non-empty sequence (longest first), by the scaled forward recursion.

    ``factors``: by what a token's emissions are multiplied, a column a state; ``rows``: which row is each token's."""
    symbols, begin, active, rows = _layout(seqs, rows)
    logs = np.zeros(len(seqs))
    a = np.repeat(hmm.start[None, :], active[0], 0)
    for t in range(len(active)):
        i, j = begin[t], begin[t + 1]
        a = (a[: active[t]] @ hmm.step if t else a) * hmm.emit[symbols[i:j]]
        if rows is not None:
            a *= factors[rows[i:j]]
        c = a.sum(1)
        a /= c[:, None]
        logs[: active[t]] += np.log10(c)
    return logs


def posteriors(hmm: Hmm, seqs: list[np.ndarray], lead: np.ndarray | None = None, core: int | None = None, beside: list[np.ndarray] | None = None):
    """Expected start and transition counts of non-empty sequences (longest first); their counted symbols, the
    probability of each state at each of these, and ``beside`` (an integer a symbol) of these.

    ``lead``: how many symbols at the front of each sequence are context of what follows (0: the sequence begins its
    document), ``core``: how many symbols after them count; the rest is context too. A transition counts with its
    second symbol, a start only where a document begins."""
    symbols, begin, active, beside = _layout(seqs, beside)
    last = len(active) - 1
    lead = np.zeros(len(seqs), np.int64) if lead is None else lead
    until = lead + (last + 1 if core is None else core)
    e = hmm.emit[symbols]
    alpha, scale = np.empty_like(e), np.empty(len(symbols))
    first = np.where((lead == 0)[:, None], hmm.start[None, :], hmm.stationary()[None, :])
    for t in range(last + 1):
        i, j = begin[t], begin[t + 1]
        a = (first[: active[0]] if t == 0 else alpha[begin[t - 1] : begin[t - 1] + active[t]] @ hmm.step) * e[i:j]
        scale[i:j] = a.sum(1)
        alpha[i:j] = a / scale[i:j, None]
    moves, counted = np.zeros_like(hmm.step), np.empty(len(symbols), bool)
    beta = np.ones((active[last], len(hmm.start)))
    for t in range(last, -1, -1):  # alpha of each time becomes alpha * beta once its successor has used it
        i, j = begin[t], begin[t + 1]
        counted[i:j] = (lead[: active[t]] <= t) & (t < until[: active[t]])
        if t:
            ahead = e[i:j] * beta / scale[i:j, None]
            before = alpha[begin[t - 1] : begin[t - 1] + active[t]]
            moves += before.T @ ahead if counted[i:j].all() else before[counted[i:j]].T @ ahead[counted[i:j]]
            alpha[i:j] *= beta
            beta = np.ones((active[t - 1], len(hmm.start)))
            beta[: active[t]] = ahead @ hmm.step.T
    alpha[: active[0]] *= beta
    starts = alpha[: active[0]][lead == 0].sum(0)
    return starts, moves * hmm.step, symbols[counted], alpha[counted], None if beside is None else beside[counted]


def _sums(keys: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    """Column sums of ``weights`` by key below ``n``."""
    return np.stack([np.bincount(keys, weights[:, k], n) for k in range(weights.shape[1])], 1)


def expected(hmm: Hmm, seqs: list[np.ndarray], lead: np.ndarray | None = None, core: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected start, transition and emission counts of non-empty sequences (longest first); see ``posteriors``."""
    starts, moves, symbols, states, _ = posteriors(hmm, seqs, lead, core)
    return starts, moves, _sums(symbols, states, len(hmm.emit))


def segments(s: np.ndarray, core: int, context: int) -> list[tuple[np.ndarray, int]]:
    """(symbols, lead) of a sequence's segments: ``core`` symbols each, with ``context`` more on either side."""
    return [(s[max(0, i - context) : i + core + context], min(i, context)) for i in range(0, len(s), core)]


def baum_welch(encoded: DataFrame, k: int, symbols: int, passes: int = 4, segment: int = 512, context: int = 64, chunk_tokens: int = 400_000, prior: float = 0.05) -> Hmm:
    """Train on the encoded rows that are not held out. A pass takes sequences in segments of ``segment``
    symbols (all of them), so that a task's memory doesn't depend on the longest document; each segment sees
    ``context`` symbols on either side that don't count, so that the transitions over a cut count once and
    only documents have starts."""
    spark = encoded.sparkSession
    hmm = Hmm.seeded(k, symbols)
    train = encoded.filter("not held_out").select("symbols")

    for _ in range(passes):
        model = spark.sparkContext.broadcast(hmm)  # of a fixed size

        def run(batches):
            h = model.value
            start, moves, emits = np.zeros(k), np.zeros((k, k)), np.zeros((symbols, k))
            for b in batches:
                seqs = [np.frombuffer(x.as_buffer(), np.uint16) for x in b.column(0)]
                cut = sorted((x for s in seqs for x in segments(s, segment, context)), key=lambda x: -len(x[0]))
                done = 0
                for part in _chunks([x[0] for x in cut], chunk_tokens):
                    lead = np.array([x[1] for x in cut[done : done + len(part)]])
                    for total, x in zip((start, moves, emits), expected(h, part, lead, segment)):
                        total += x
                    done += len(part)
            v = np.concatenate([start, moves.ravel(), emits.ravel()])
            at = np.flatnonzero(v)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(v[at])], names=["at", "v"])

        v = np.zeros(k + k * k + symbols * k)
        for r in train.mapInArrow(run, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():  # one row a parameter
            v[r["at"]] = r["v"]
        start, moves, emits = v[:k] + prior, v[k : k + k * k].reshape(k, k) + prior, v[k + k * k :].reshape(symbols, k) + prior
        hmm = Hmm(start / start.sum(), moves / moves.sum(1, keepdims=True), emits / emits.sum(0))
    return hmm


def word_factors(encoded: DataFrame, a: Alphabet, hmm: Hmm, segment: int = 512, context: int = 64, chunk_tokens: int = 400_000) -> np.ndarray:
    """By what each frequent word's add-one share of its class is multiplied in each state: (g / q + 1) / (c + 1).

    A row a word in the order of ``a.hot``, and a last row of ones for all other words. Segments are cut as in ``baum_welch``."""
    spark, k, n = encoded.sparkSession, len(hmm.start), len(a.hot)
    model, own = spark.sparkContext.broadcast(hmm), len(a.own)

    def run(batches):
        g = np.zeros((n + 1, k))
        for b in batches:
            parts = []
            for x, place in zip(b.column(0), b.column(1)):
                x = np.frombuffer(x.as_buffer(), np.uint16)
                word = np.full(len(x), n, np.int32)
                word[x >= own] = np.frombuffer(place.as_buffer(), np.int32)
                parts += [(*y, z) for y, (z, _) in zip(segments(x, segment, context), segments(word, segment, context))]
            parts.sort(key=lambda x: -len(x[0]))
            done = 0
            for part in _chunks([x[0] for x in parts], chunk_tokens):
                these = parts[done : done + len(part)]
                _, _, _, states, word = posteriors(model.value, part, np.array([x[1] for x in these]), segment, [x[2] for x in these])
                g += _sums(word, states, n + 1)
                done += len(part)
        at = np.flatnonzero(g[:n].any(1))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *(pa.array(g[at, i]) for i in range(k))], names=["at", *names])

    names = [f"g{i}" for i in range(k)]
    sums = encoded.filter("not held_out").select("symbols", "places").mapInArrow(run, f"at int, {', '.join(f'{x} double' for x in names)}")
    g, q, out = np.zeros((n, k)), np.zeros((len(a.class_total), k)), np.ones((n + 1, k))
    for r in sums.groupBy("at").agg(*(F.sum(x).alias(x) for x in names)).collect():  # a row a frequent word
        g[r["at"]] = [r[x] for x in names]
    klass = np.array([a.klass(w) for w in a.hot], np.int64)
    np.add.at(q, klass, g)
    q /= np.maximum(q.sum(1, keepdims=True), 1e-300)
    seen = np.array([w not in a.own for w in a.hot], bool)
    out[:n][seen] = (g[seen] / np.maximum(q[klass[seen]], 1e-300) + 1) / (np.array([*a.hot.values()])[seen, None] + 1)
    return out


def log_likelihoods(encoded: DataFrame, hmm: Hmm, own: int, factors: np.ndarray, chunk_tokens: int = 400_000) -> DataFrame:
    """rid, hmm_log of each encoded row, with the other small columns; ``own``: how many words have a symbol of their own."""
    model = encoded.sparkSession.sparkContext.broadcast((hmm, factors))
    keep = ["rid", "doc_id", "held_out", "n_tokens", "hot_known", "hot_log", "class_log"]

    def run(batches):
        h, by_word = model.value
        for b in batches:
            seqs = [np.frombuffer(x.as_buffer(), np.uint16) for x in b.column(len(keep))]
            order = sorted(range(len(seqs)), key=lambda i: -len(seqs[i]))
            logs, done = np.zeros(len(seqs)), 0
            for part in _chunks(seqs, chunk_tokens):
                these, rows = order[done : done + len(part)], []
                for i in these:
                    row = np.full(len(seqs[i]), len(by_word) - 1, np.int32)
                    row[seqs[i] >= own] = np.frombuffer(b.column(len(keep) + 1)[i].as_buffer(), np.int32)
                    rows.append(row)
                logs[these] = forward(h, part, rows, by_word)
                done += len(part)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(logs)], names=[*keep, "hmm_log"])

    schema = "rid bigint, doc_id bigint, held_out boolean, n_tokens bigint, hot_known bigint, hot_log double, class_log double, hmm_log double"
    return encoded.select(*keep, "symbols", "places").mapInArrow(run, schema)


def score_documents(docs: DataFrame, states: int = 4, passes: int = 4, modulus: int = 7, held_out: int = 2, own_words: int = 4096, hot_words: int = 100_000, classes: int = 1024) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    spark = docs.sparkSession
    counts = written(count_words(docs.filter(crc_mod("doc_id", modulus) != held_out)), "hmm-counts")
    a = alphabet(counts, own_words, hot_words, classes)
    encoded = written(encode(docs, spark.sparkContext.broadcast(a), modulus, held_out), "hmm-encoded")
    hmm = baum_welch(encoded, states, a.size, passes)
    rare = encoded.select("rid", F.explode(F.arrays_zip("words", "counts")).alias("x")).select("rid", F.col("x.words").alias("word"), F.col("x.counts").alias("times"))
    known = rare.join(counts.filter((_level("c") < a.level) & (F.col("word") != F.lit(END))), "word")  # the others are in the alphabet
    sums = known.groupBy("rid").agg(F.sum("times").alias("tail_known"), F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("tail_log"))
    r = log_likelihoods(encoded, hmm, len(a.own), word_factors(encoded, a, hmm)).join(sums, "rid", "left")
    tail_known, tail_log = F.coalesce("tail_known", F.lit(0)), F.coalesce("tail_log", F.lit(0.0))
    return r.select(
        "doc_id", "held_out", "n_tokens", (F.col("hot_known") + tail_known).alias("n_known"), F.lit(a.n).cast("long").alias("train_tokens"),
        (F.col("hot_log") + tail_log - F.col("n_tokens") * math.log10(a.n + a.types + 1)).alias("base_score"),
        (F.col("hmm_log") + F.col("class_log") + tail_log).alias("score"),
    )
