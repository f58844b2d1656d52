"""Quality scores by a factorisation machine.

Inputs are hashed words (their frequencies, scaled to length 1), statistics of the text's structure, and its length
as metadata. Pairs of inputs interact through low-rank factors; the sum over all pairs takes linear time as half of
(square of sums minus sum of squares) for each factor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytekernel import LOWER, SPACE, U, chunks, prefix_sums, span_hashes, word_spans
from .language_crf import held_out
from .store import smallest

STATISTICS = ("bytes", "words", "word_length", "upper", "digits", "punctuation", "beyond_ascii", "lines", "distinct_words", "top_word", "repeated_next", "pipes", "exclamations", "distinct_shingles", "short_words", "long_words")
_CLASS = np.zeros((5, 256), bool)
_CLASS[0, 65:91] = True
_CLASS[1, 48:58] = True
_CLASS[2, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_CLASS[3, 128:] = True
_CLASS[4, 10] = True


def rows_of(column: pa.Array, bits: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, statistics, hashed words, their values, number of words by row) for some rows at a time."""
    for low, high, raw, offsets in chunks(column):
        m = high - low
        buf = LOWER[raw]
        starts, ends, first = word_spans(buf, offsets, SPACE)
        words = span_hashes(prefix_sums(buf), starts, ends)
        per, size = np.diff(first).astype(float), np.diff(offsets).astype(float)
        of, byte_of = np.repeat(np.arange(m), np.diff(first)), np.repeat(np.arange(m), np.diff(offsets))
        share = lambda on, total: np.bincount(of if len(on) == len(of) else byte_of, on, m) / np.maximum(total, 1)
        by_byte = [np.bincount(byte_of, _CLASS[k][raw], m) / np.maximum(size, 1) for k in range(5)]
        order = np.lexsort((words, of))
        w, o = words[order], of[order]
        fresh = np.append(True, (w[1:] != w[:-1]) | (o[1:] != o[:-1])) if len(w) else np.zeros(0, bool)
        at = np.flatnonzero(fresh)
        count, owner = np.diff(np.append(at, len(w))).astype(float), o[at]
        top = np.zeros(m)
        np.maximum.at(top, owner, count)
        again = np.zeros(len(words), bool)
        with np.errstate(over="ignore"):
            if len(words) > 1:
                again[1:] = (words[1:] == words[:-1]) & (of[1:] == of[:-1])
            triple = words[:-2] * U(3) + words[1:-1] * U(5) + words[2:] if len(words) > 2 else words[:0]
        inside = of[:-2] == of[2:] if len(words) > 2 else np.zeros(0, bool)
        pairs = np.unique(np.stack([of[:-2][inside].astype(np.uint64), triple[inside]], 1), axis=0)[:, 0].astype(np.int64) if inside.any() else np.zeros(0, np.int64)
        length = (ends - starts).astype(float)
        mark = lambda b: share((buf[starts] == b) & (length == 1) if len(starts) else length.astype(bool), per)
        bang = share(buf[ends - 1] == 33, per) if len(ends) else np.zeros(m)
        stats = np.stack([
            np.log1p(size), np.log1p(per), np.bincount(of, length, m) / np.maximum(per, 1), *by_byte, np.bincount(owner, minlength=m) / np.maximum(per, 1), top / np.maximum(per, 1), share(again, per), mark(124), bang,
            np.bincount(pairs, minlength=m) / np.maximum(per - 2, 1), share(length <= 2, per), share(length >= 12, per),
        ], 1)
        key, back = np.unique(owner << bits | (w[at] >> U(64 - bits)).astype(np.int64), return_inverse=True)
        value, owner = np.log1p(np.bincount(back, count, len(key))), key >> bits
        norm = np.sqrt(np.bincount(owner, value**2, m))
        yield low, high, stats, key & ((1 << bits) - 1), value / norm[owner], np.bincount(owner, minlength=m)


class Machine:
    """w0 + sum of w_i x_i + half the sum over factors of (sum of v_i x_i)^2 - sum of (v_i x_i)^2. Inputs: hashed words, then the statistics, scaled."""

    def __init__(self, bits: int, factors: int):
        n = (1 << bits) + len(STATISTICS)
        self.bits, self.w0, self.w = bits, 0.0, np.zeros(n)
        self.v = np.random.default_rng(11).normal(0, 0.05, (n, factors))
        self.mean, self.scale = np.zeros(len(STATISTICS)), np.ones(len(STATISTICS))

    def inputs(self, stats: np.ndarray, index: np.ndarray, value: np.ndarray, per: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Inputs of all rows one after another: (input, value, where each row begins)."""
        m, k = stats.shape
        scaled = np.clip((stats - self.mean) / self.scale, -5, 5) / np.sqrt(k)
        first = np.cumsum(per + k) - per - k
        i, x = np.empty(len(index) + m * k, np.int64), np.empty(len(index) + m * k)
        at = first[:, None] + np.arange(k)
        i[at], x[at] = (1 << self.bits) + np.arange(k), scaled
        rest = np.repeat(first + k, per) + np.arange(len(index)) - np.repeat(np.cumsum(per) - per, per)
        i[rest], x[rest] = index, value
        return i, x, first

    def margin(self, i: np.ndarray, x: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        vx = self.v[i] * x[:, None]
        sums = np.add.reduceat(vx, first, axis=0)
        return self.w0 + np.add.reduceat(self.w[i] * x, first) + 0.5 * (sums**2 - np.add.reduceat(vx**2, first, axis=0)).sum(1), sums

    def learn(self, rows: list[tuple], y: np.ndarray, epochs: int = 12, batch: int = 64, rate: float = 0.1, ridge: float = 1e-4) -> None:
        stats = np.stack([r[0] for r in rows])
        self.mean, self.scale = stats.mean(0), stats.std(0) + 1e-6
        squares, squares_v, square0 = np.full(self.w.shape, 1e-6), np.full(self.v.shape, 1e-6), 1e-6
        rng = np.random.default_rng(13)
        for _ in range(epochs):
            shuffled = rng.permutation(len(rows))
            for low in range(0, len(rows), batch):
                some = shuffled[low : low + batch]
                per = np.array([len(rows[j][1]) for j in some])
                i, x, first = self.inputs(stats[some], np.concatenate([rows[j][1] for j in some]), np.concatenate([rows[j][2] for j in some]), per)
                z, sums = self.margin(i, x, first)
                g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[some]) / len(some)
                of = np.repeat(np.arange(len(some)), np.diff(np.append(first, len(i))))
                used, back = np.unique(i, return_inverse=True)
                gw = np.bincount(back, g[of] * x, len(used)) + ridge * self.w[used] / batch
                each = (g[of] * x)[:, None] * (sums[of] - self.v[i] * x[:, None])
                gv = np.stack([np.bincount(back, each[:, f], len(used)) for f in range(self.v.shape[1])], 1) + ridge * self.v[used] / batch
                squares[used] += gw**2
                squares_v[used] += gv**2
                square0 += g.sum() ** 2
                self.w[used] -= rate * gw / np.sqrt(squares[used])
                self.v[used] -= rate * 0.3 * gv / np.sqrt(squares_v[used])
                self.w0 -= rate * g.sum() / np.sqrt(square0)


def _source(docs: DataFrame, *more) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"), *more)


def fit(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, sample: int = 6000, bits: int = 15, factors: int = 8) -> Machine:
    """A machine fitted on at most ``sample`` labelled documents (those with the smallest hash of doc_id), none of the held-out fold.

    Their inputs are computed over the cluster; the fit itself is one task over them. Labels that are null or belong
    to no document are ignored. Without labels every score is 0.5.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("quality")).dropna()
    known = smallest(known.filter(~held_out(folds, held)).withColumn("h", F.xxhash64("doc_id")), sample, "doc_id", "quality").drop("h")
    rows = _source(docs).join(F.broadcast(known), "doc_id")  # at most ``sample`` rows

    def inputs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, stats, index, value, per in rows_of(batch.column(1), bits):
                cut = np.cumsum(per)[:-1]
                pack = lambda parts: pa.array([p.tobytes() for p in parts], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), batch.column(2).slice(low, high - low), pack(stats), pack(np.split(index, cut)), pack(np.split(value, cut))], ["doc_id", "quality", "stats", "word", "value"])

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("doc_id", "ascending"), ("quality", "ascending"), ("word", "ascending")])
        machine = Machine(bits, factors)
        machine.learn([(np.frombuffer(a), np.frombuffer(b, np.int64), np.frombuffer(c)) for a, b, c in zip(*(t.column(x).to_pylist() for x in ("stats", "word", "value")), strict=True)], t.column("quality").to_numpy())
        return pa.table({"w0": [machine.w0], **{k: pa.array([getattr(machine, k).tobytes()], pa.binary()) for k in ("w", "v", "mean", "scale")}})

    found = rows.mapInArrow(inputs, "doc_id long, quality double, stats binary, word binary, value binary").groupBy(F.lit("all")).applyInArrow(run, "w0 double, w binary, v binary, mean binary, scale binary").collect()
    machine = Machine(bits, factors)
    if found:
        r = found[0]
        machine.w0, machine.w, machine.mean, machine.scale = r.w0, np.frombuffer(r.w), np.frombuffer(r.mean), np.frombuffer(r.scale)
        machine.v = np.frombuffer(r.v).reshape(-1, factors)
    else:
        machine.v = machine.v * 0
    return machine


def quality(docs: DataFrame, machine: Machine) -> DataFrame:
    """Per row of ``docs``: doc_id and score, the probability of label 1. Whole texts; a null text is empty and is scored by its statistics; repeated rows stay; other columns are ignored."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for low, high, stats, index, value, per in rows_of(batch.column(1), m.bits):
                z, _ = m.margin(*m.inputs(stats, index, value, per))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], ["doc_id", "score"])

    return _source(docs).mapInArrow(run, "doc_id long, score double")


def op3_quality_fm(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scores = quality(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scores.select("doc_id", held_out(4, 2), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).cast("int").alias("predicted"))


QUERIES = {"op3_quality_fm": op3_quality_fm}
