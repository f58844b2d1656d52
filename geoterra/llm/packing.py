"""Mixture-controlled packing: deficit round-robin over source queues.

Every round (window) credits queue s with ``quantum_s`` grains of some tokens; the whole grains of its credit go into the
window and the rest is carried to the next one. Queues start with staggered credits under one grain, so that windows are
equally long. After k rounds queue s has given floor(k * quantum_s + start_s) grains, or all that it has, so the round of every grain follows from its place in its queue, and so does its place in the packed
stream: rounds run in parallel, and deficits carry over windows and partitions alike. A window is as long as a sequence, so every
sequence holds the sources in their proportions, up to a grain of each. Sequences are cut from the
stream every 1024 tokens; the last, short piece is cut at powers of two, so that no padding is left.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import written
from .tokens import default_vocabulary, encode, width

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
SMALL_ROWS = 200_000


def _tokenised(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """(part, queue, doc_id, start in the part's queue, n, ids): each task keeps a running length for each of its queues."""
    kind = width(vocabulary, end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), {}
        for batch in batches:
            queues, texts = batch.column(1).to_pylist(), batch.column(2)
            for low in range(0, len(texts), 500):
                ids, start, n = [], [], []
                for q, text in zip(queues[low : low + 500], texts[low : low + 500].to_pylist(), strict=True):
                    t = np.append(encode(text, vocabulary), np.uint32(end_id)).astype(kind)
                    start.append(at.get(q, 0))
                    n.append(len(t))
                    at[q] = start[-1] + len(t)
                    ids.append(t.tobytes())
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array([part] * len(n), pa.int64()), "queue": pa.array(queues[low : low + 500], pa.string()), "doc_id": batch.column(0).slice(low, 500),
                    "start": pa.array(start, pa.int64()), "n": pa.array(n, pa.int64()), "ids": pa.array(ids, pa.binary()),
                })

    return docs.mapInArrow(run, "part long, queue string, doc_id long, start long, n long, ids binary")


def pack(docs: DataFrame, weights: dict[str, float] | None = None, vocabulary: str | None = None, length: int = 1024, window: int | None = None, grain: int = 64, end_id: int = 0, max_queues: int = 1000) -> DataFrame:
    """Pieces of all documents in sequences of ``length`` tokens (a power of two).

    ``weights`` gives the target proportions by source; left out, they are the sources' shares of all tokens. Sources
    without a weight above 0 follow when all others have ended, by their shares of what is left. A share under 2^-26
    counts as that. ``window`` is the number of tokens of a round, a sequence if left out; within it, a queue's tokens stay
    together. Queues give ``grain`` tokens at a time (the last ones of a queue may be fewer), so a window is within a grain of
    each source's target, and what a source is owed is carried on. Up to
    ``max_queues`` sources each task holds the queues and finds its places alone; more of them stay a table, and the
    pieces are sorted into the stream, with the same result. A null source is a queue of its own; a null
    text gives the end id alone; repeated rows are packed as often as they stand; other columns are ignored; an empty table gives an empty one.
    """
    window = window or length
    vocabulary = vocabulary or default_vocabulary()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("null")).alias("queue"), F.col("text").cast("string").alias("text"))
    held = written(_tokenised(rows, vocabulary, end_id), "packing-ids")
    parts = held.groupBy("part", "queue").agg(F.sum("n").alias("n")).checkpoint()
    totals = parts.groupBy("queue").agg(F.sum("n").alias("size"))
    before = parts.select("part", "queue", (F.sum("n").over(Window.partitionBy("queue").orderBy("part")) - F.col("n")).alias("base"))
    queues = _rounds(totals, weights, window, grain)
    named = queues.orderBy(F.desc("size"), "queue").limit(max_queues + 1).collect()  # at most max_queues + 1 rows
    many = len(named) > max_queues
    if not many:
        lookup = F.create_map(*[x for i, r in enumerate(named) for x in (F.lit(r.queue), F.lit(i))]) if named else F.create_map(F.lit(""), F.lit(0))
        before = before.withColumn("lane", F.element_at(lookup, F.col("queue")))
    else:
        before = before.join(queues, "queue")
    before = before.checkpoint()
    if before.count() <= SMALL_ROWS:
        before = F.broadcast(before)
    placed = held.join(before, ["part", "queue"]).withColumn("at", F.col("start") + F.col("base"))
    if many:
        return _sorted_pieces(placed, length, grain)
    plan = (*(np.array([r[c] for r in named], np.int64) for c in ("quantum", "phase", "size", "first")), length, grain)
    return placed.select("doc_id", "lane", "at", "n", "ids").mapInArrow(lambda batches: _pieces(batches, *plan), PIECES)


def _rounds(totals: DataFrame, weights: dict[str, float] | None, window: int, grain: int) -> DataFrame:
    """(queue, size, quantum, phase, first): a queue's grains of a round, its credit at the start, and the round in which it begins.

    Starts are the fractions of the running sum of the quanta, in the order of a hash. Both are in 2^-20 grains, as integers: credits are exact, and every queue ends after a finite number of rounds.
    """
    spark = totals.sparkSession
    wanted = [(("=" if q != "null" else "") + q, float(w)) for q, w in (weights or {}).items() if float(w) > 0]
    # A source that is called null has the weight of the null source.
    wanted += [("=null", w) for q, w in wanted if q == "null"]
    named = totals.join(spark.createDataFrame(wanted, "queue string, weight double"), "queue", "left") if wanted else totals.withColumn("weight", F.lit(None).cast("double"))
    named = named.select("queue", "size", F.col("weight").isNull().cast("int").alias("late"), F.coalesce("weight", F.col("size").cast("double")).alias("share"))
    every = {r.late: r.share for r in named.groupBy("late").agg(F.sum("share").alias("share")).collect()}
    part = F.col("share") / F.when(F.col("late") == 0, F.lit(every.get(0, 1.0))).otherwise(F.lit(every.get(1, 1.0)))
    found = named.select("queue", "size", "late", F.greatest((part * (window / grain) * 2.0**20).cast("long"), F.lit(1)).alias("quantum"), F.pmod(F.xxhash64("queue"), F.lit(1024)).alias("cell")).checkpoint()
    ahead, sums = 0, []
    for r in found.groupBy("late", "cell").agg(F.sum("quantum").alias("q")).orderBy("late", "cell").collect():  # at most 2 * 1024 rows
        sums.append((r.late, r.cell, ahead % 2**20))
        ahead += r.q
    within = Window.partitionBy("late", "cell").orderBy("queue")
    phase = F.pmod(F.sum("quantum").over(within) - F.col("quantum") + F.col("ahead"), F.lit(2**20)).alias("phase")
    found = found.join(F.broadcast(spark.createDataFrame(sums, "late int, cell long, ahead long")), ["late", "cell"]).select("queue", "size", "late", "quantum", phase)
    # The last round of the weighted queues: the grains of k rounds are floor(k * quantum / 2^20).
    last = 0
    if len(every) == 2:
        last = found.filter("late = 0").agg(F.max(F.ceil((F.ceil(F.col("size") / grain).cast("decimal(38,0)") * 2**20) / F.col("quantum")))).first()[0]
    return found.select("queue", "size", "quantum", "phase", (F.col("late") * F.lit(int(last))).cast("long").alias("first"))


def _sorted_pieces(placed: DataFrame, length: int, grain: int) -> DataFrame:
    """The pieces of any number of queues: cut by rounds, sorted by (round, queue), and placed by running sums over the sorted partitions."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, n, quantum, phase, first = (batch.column(c).to_numpy() for c in ("at", "n", "quantum", "phase", "first"))
            of, k, low, high = cut_rounds(at, n, quantum, phase, grain)
            rows = pa.array(of)
            data, start, kind = _ids(batch.column("ids"), n)
            ids = [data[a:b].astype(kind).tobytes() for a, b in zip((start[of] + low - at[of]).tolist(), (start[of] + high - at[of]).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(k + first[of]), batch.column("size").take(rows), batch.column("queue").take(rows), pa.array(low), batch.column("doc_id").take(rows), pa.array(low - at[of]), pa.array(high - low), pa.array(n[of]), pa.array(ids, pa.binary())],
                ["round", "size", "queue", "at", "doc_id", "start", "m", "n", "ids"],
            )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            m = batch.column("m").to_numpy()
            ends = at + np.cumsum(m)
            yield pa.RecordBatch.from_arrays([pa.array([run] * len(m), pa.int64()), pa.array(ends - m), *(batch.column(c) for c in ("doc_id", "start", "m", "n", "ids"))], ["run", "place", "doc_id", "start", "m", "n", "ids"])
            at = int(ends[-1]) if len(m) else at

    pieces = placed.select("size", "queue", "at", "doc_id", "n", "quantum", "phase", "first", "ids").mapInArrow(cut, "round long, size long, queue string, at long, doc_id long, start long, m long, n long, ids binary")
    order = ["round", F.desc("size"), "queue", "at"]
    runs = pieces.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(place, "run long, place long, doc_id long, start long, m long, n long, ids binary")
    runs = written(runs, "packing-runs")
    base, total = {}, 0
    for r in runs.groupBy("run").agg(F.sum("m").alias("m")).orderBy("run").collect():  # one row for each partition
        base[r.run], total = total, total + r.m

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.column("m").to_numpy()
            stream = np.array([base[r] for r in batch.column("run").to_pylist()], np.int64) + batch.column("place").to_numpy()
            yield _cut_sequences(batch.column("doc_id"), batch.column("n").to_numpy(), batch.column("ids"), m, np.arange(len(m)), batch.column("start").to_numpy(), np.zeros(len(m), np.int64), m, stream, total, length)

    return runs.mapInArrow(finish, PIECES)


def granted(rounds: np.ndarray, quantum: np.ndarray, phase: np.ndarray) -> np.ndarray:
    """floor((rounds * quantum + phase) / 2^20) without overflow."""
    part = quantum & (2**20 - 1)
    return rounds * (quantum >> 20) + (rounds >> 20) * part + (((rounds & (2**20 - 1)) * part + phase) >> 20)


def given(rounds: np.ndarray, quantum: np.ndarray, phase: np.ndarray, size: np.ndarray, first: np.ndarray, grain: int) -> np.ndarray:
    """Tokens that each queue has given before each round: its whole grains from its first round on, as far as it has any."""
    k = np.maximum(np.asarray(rounds, np.int64)[:, None] - first, 0)
    # No queue can give more than its size, so credits far beyond it need not be exact.
    return np.minimum(np.minimum(granted(k, quantum, phase), 2**62 // grain) * grain, size)


def round_of(grains: np.ndarray, quantum: np.ndarray, phase: np.ndarray) -> np.ndarray:
    """The round that takes each grain of a queue: the largest k after which no more than the grains before it are given."""
    k = np.maximum(np.floor(((grains + 1) * 2.0**20 - phase) / quantum), 0).astype(np.int64)
    for _ in range(3):
        k -= granted(k, quantum, phase) > grains
    for _ in range(3):
        k += granted(k + 1, quantum, phase) <= grains
    return k


def cut_rounds(at: np.ndarray, n: np.ndarray, quantum: np.ndarray, phase: np.ndarray, grain: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, round, first place, last place) of the parts into which rounds cut the ``n`` tokens from place ``at`` of each row's queue."""
    first, last = at // grain, (at + n - 1) // grain
    many = last - first + 1
    of = np.repeat(np.arange(len(at)), many)
    grains = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + first[of]
    k = round_of(grains, quantum[of], phase[of])
    fresh = np.flatnonzero(np.append(True, (of[1:] != of[:-1]) | (k[1:] != k[:-1]))) if len(of) else np.zeros(0, np.int64)
    of, k, low = of[fresh], k[fresh], np.maximum(grains[fresh] * grain, at[of[fresh]])
    same = np.append(of[1:] == of[:-1], False) if len(of) else np.zeros(0, bool)
    return of, k, low, np.where(same, np.append(low[1:], 0) if len(of) else low, (at + n)[of])


def _ids(column: pa.Array, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.dtype]:
    """All ids of a column of binaries as one array, where each row begins in it, and their type."""
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    kind = np.dtype("<u2") if not len(n) or off[-1] - off[0] == 2 * int(n.sum()) else np.dtype("<u4")
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw.view(kind), (off[:-1] - off[0]) // kind.itemsize, kind


def _cut_sequences(names: pa.Array, doc_tokens: np.ndarray, column: pa.Array, held: np.ndarray, of: np.ndarray, start: np.ndarray, inside: np.ndarray, m: np.ndarray, stream: np.ndarray, total: int, length: int) -> pa.RecordBatch:
    """The pieces, cut where sequences end: ``m`` ids of row ``of`` from ``inside`` on, which are its document's from ``start`` on, stand in the stream from ``stream`` on."""
    first, last = sequence_of(stream, total, length)[0], sequence_of(stream + m - 1, total, length)[0]
    many = last - first + 1
    p = np.repeat(np.arange(len(m)), many)
    seq = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + first[p]
    begin, end = sequence_edges(seq, total, length)
    low, high = np.maximum(begin, stream[p]), np.minimum(end, (stream + m)[p])
    skip = low - stream[p]
    data, row_start, _ = _ids(column, held)
    raw = memoryview(data.astype("<u4")).cast("B")
    at = 4 * (row_start[of[p]] + inside[p] + skip)
    crc = [zlib.crc32(raw[a:b]) for a, b in zip(at.tolist(), (at + 4 * (high - low)).tolist(), strict=True)]
    row = of[p]
    cols = (start[p] + skip, high - low, np.array(crc, np.int64), doc_tokens[row], seq, low - begin)
    return pa.RecordBatch.from_arrays([names.take(pa.array(row)), *(pa.array(c) for c in cols)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])


def _tail(total: int, length: int) -> np.ndarray:
    """Where the sequences after the last full one begin, and the end: powers of two, the largest first."""
    full, rest = divmod(total, length)
    edge = [full * length]
    for bit in range(length.bit_length() - 1, -1, -1):
        if rest >> bit & 1:
            edge.append(edge[-1] + (1 << bit))
    return np.array(edge, np.int64)


def sequence_of(at: np.ndarray, total: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset in it) of places in the stream."""
    edge = _tail(total, length)
    tail = at >= edge[0]
    slot = np.maximum(np.searchsorted(edge, at, "right") - 1, 0)
    return np.where(tail, total // length + slot, at // length), np.where(tail, at - edge[slot], at % length)


def sequence_edges(seq: np.ndarray, total: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The places in the stream at which sequences begin and end."""
    edge, full = _tail(total, length), total // length
    slot = np.clip(seq - full, 0, max(len(edge) - 2, 0))
    return np.where(seq < full, seq * length, edge[slot]), np.where(seq < full, (seq + 1) * length, edge[np.minimum(slot + 1, len(edge) - 1)])


def _pieces(batches: Iterator[pa.RecordBatch], quantum: np.ndarray, phase: np.ndarray, size: np.ndarray, first: np.ndarray, length: int, grain: int) -> Iterator[pa.RecordBatch]:
    total, step = int(size.sum()), max(1, 4_000_000 // (8 * len(size)))
    for whole in batches:
        for begin in range(0, len(whole), 1000):
            batch = whole.slice(begin, 1000)
            lanes, ats, ns = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (1, 2, 3))
            of, own, low, high = cut_rounds(ats, ns, quantum[lanes], phase[lanes], grain)
            lane, k = lanes[of], own + first[lanes[of]]
            base = np.empty(len(k), np.int64)
            rounds, back = np.unique(k, return_inverse=True)
            order = np.argsort(back, kind="stable")
            for a in range(0, len(rounds), step):
                some = order[np.searchsorted(back[order], a) : np.searchsorted(back[order], a + step)]
                taken, after = (given(rounds[a : a + step] + x, quantum, phase, size, first, grain) for x in (0, 1))
                # A round's queues stand one after another, so a queue begins after what earlier queues give in it.
                ahead = np.cumsum(after - taken, 1) - (after - taken)
                i, j = back[some] - a, lane[some]
                base[some] = taken.sum(1)[i] + ahead[i, j] - taken[i, j]
            yield _cut_sequences(batch.column(0), ns, batch.column(4), ns, of, low - ats[of], low - ats[of], high - low, low + base, total, length)


def op8_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op8_packing": op8_packing}
