"""Removal of repeated byte passages, by the common-prefix interval tree of enhanced suffix arrays.

Every window of ``width`` bytes has one anchor, its smallest hashed k-mer, and equal windows have equal anchors. The
windows of a document that share an anchor form a context; each lies in exactly one. Shards send their distinct
contexts (as hashes, with the smallest doc_id) by anchor and hear which have a copy in a smaller document and which
meet different contexts around the same anchor. Only the latter travel as bytes: a suffix array over them, its
common-prefix intervals and a test of what stands to the left give the maximal repeats with all their occurrences.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytekernel import U, fixed_hashes, planes, prefix_sums, span_hashes, unplanes
from .exchange import Exchange
from .store import shards, written

KMER = 20
POSITION_BITS = 28
#: Texts of more bytes are taken in parts of that many windows.
LONG = 1 << 27


def _sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    size, m = 1, a
    while size * 2 <= w:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    return np.minimum(m[: len(a) - w + 1], m[w - size : len(a) - size + 1])


def contexts(raw: np.ndarray, offsets: np.ndarray, width: int, limit: int = 1 << 18) -> tuple[np.ndarray, ...]:
    """(document, first window, last window, anchor hash, context hash) of all contexts of a shard's bytes."""
    out: list[tuple] = [(np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2]
    n, row, span = len(offsets) - 1, 0, width - KMER + 1
    parts: list[tuple[int, int, np.ndarray]] = []  # first row, first byte, where rows begin and end
    while row < n:
        end = min(n, max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1))
        base, off = int(offsets[row]), offsets[row : end + 1] - offsets[row]
        if end == row + 1 and off[1] > LONG:
            parts += [(row, base + s, np.array([0, min(LONG + width - 1, int(off[1]) - s)])) for s in range(0, int(off[1]) - width + 1, LONG)]
        else:
            parts.append((row, base, off))
        row = end
    for first, base, off in parts:
        buf = raw[base : base + int(off[-1])]
        if len(buf) < width:
            continue
        sums = prefix_sums(buf)
        kmers = fixed_hashes(sums, KMER)
        key = (kmers >> U(POSITION_BITS) << U(POSITION_BITS)) | np.arange(len(kmers), dtype=np.uint64)
        anchor = (_sliding_min(key, span) & U((1 << POSITION_BITS) - 1)).astype(np.int64)
        step = np.zeros(len(buf) + 1, np.int64)
        long = np.diff(off) >= width
        np.add.at(step, off[:-1][long], 1)
        np.add.at(step, off[1:][long] - width + 1, -1)
        v = np.flatnonzero(np.cumsum(step[: len(anchor)]) > 0)
        if not len(v):
            continue
        a = anchor[v]
        fresh = np.append(True, (a[1:] != a[:-1]) | (v[1:] != v[:-1] + 1))
        lo = v[fresh]
        hi = v[np.append(np.flatnonzero(fresh)[1:] - 1, len(v) - 1)]
        doc = np.searchsorted(off, lo, "right") - 1 + first
        out.append((doc, lo + base, hi + base, kmers[a[fresh]], span_hashes(sums, lo, hi + width)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


class _Shard:
    """A shard's contexts, and the distinct ones (entries) in the order in which they are sent."""

    def __init__(self, t: pa.Table, width: int):
        text = t.column("text").combine_chunks().fill_null(b"")
        _, off, data = text.buffers()
        self.offsets = np.frombuffer(off, np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
        self.raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        ids = t.column("doc_id").to_pylist()
        self.ids = np.array([0 if x is None else x for x in ids], np.int64)
        doc, lo, hi, fp, ctx = contexts(self.raw, self.offsets, width)
        known = ~np.array([x is None for x in ids], bool)[doc] if len(doc) else np.zeros(0, bool)
        doc, lo, hi, fp, ctx = (x[known] for x in (doc, lo, hi, fp >> U(16), ctx >> U(24)))
        own = self.ids[doc]
        # By anchor, then by 16 bits of the context: a clash of those only sends a context twice.
        order = np.argsort(fp << U(16) | ctx >> U(24))
        self.doc, self.lo, self.hi, self.own, fp, ctx = (x[order] for x in (doc, lo, hi, own, fp, ctx))
        fresh = np.append(True, (fp[1:] != fp[:-1]) | (ctx[1:] != ctx[:-1])) if len(fp) else np.zeros(0, bool)
        self.first = np.flatnonzero(fresh)
        self.entry = np.cumsum(fresh) - 1
        self.fp, self.ctx = fp[self.first], ctx[self.first]
        self.least = np.minimum.reduceat(self.own, self.first) if len(self.first) else self.own


#: Answers: nothing to remove by this context; all of it stands in a smaller document; compare by suffix array; compare window by window.
NONE, COPY, COMPARE, SPREAD = range(4)


class Contexts(Exchange):
    """Keys: anchor (48 bits) and context (40 bits); values: the smallest doc_id that holds the context; answers as above."""

    payload, kind, combine = ("fp", "ctx", "least"), np.uint8, np.minimum

    def __init__(self, shards: int, fan: int, spread: int):
        super().__init__(shards, fan)
        self.spread = spread

    def unpack(self, t: pa.Table) -> tuple[list[int], tuple[np.ndarray, ...], np.ndarray]:
        fps = [unplanes(k + b"\0" * (len(k) // 6 * 2), np.uint64) for k in t.column("fp").to_pylist()]
        ctx = np.concatenate([unplanes(k + b"\0" * (len(k) // 5 * 3), np.uint64) for k in t.column("ctx").to_pylist()])
        return [len(x) for x in fps], (np.concatenate(fps), ctx), np.concatenate([unplanes(k, np.int64) for k in t.column("least").to_pylist()])

    def pack(self, keys: tuple[np.ndarray, ...], values: np.ndarray) -> tuple[bytes, ...]:
        return planes(keys[0])[: 6 * len(values)], planes(keys[1])[: 5 * len(values)], planes(values)

    def hashed(self, keys: tuple[np.ndarray, ...]) -> np.ndarray:
        return keys[0] << U(16)

    def answer(self, keys: tuple[np.ndarray, ...], values: np.ndarray) -> tuple[np.ndarray, list[int]]:
        fp, ctx = keys
        order = np.lexsort((values, ctx, fp))
        fp, ctx, d = fp[order], ctx[order], values[order]
        by_fp = np.append(True, fp[1:] != fp[:-1])
        by_ctx = by_fp | np.append(True, ctx[1:] != ctx[:-1])
        group, anchor = np.cumsum(by_ctx) - 1, np.cumsum(by_fp) - 1
        smallest = d[by_ctx]
        of = anchor[by_ctx]
        starts = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        mixed = np.minimum.reduceat(smallest, starts) < np.maximum.reduceat(smallest, starts)
        size = np.bincount(of)
        code = np.where(d > smallest[group], COPY, np.where(mixed[anchor], np.where(size[anchor] > self.spread, SPREAD, COMPARE), NONE)).astype(np.uint8)
        back = np.empty_like(code)
        back[order] = code
        return back, []

    def refine(self, answers: np.ndarray, values: np.ndarray, merged: np.ndarray) -> np.ndarray:
        return np.where(values > merged, COPY, answers)


def _requests(kept: DataFrame, width: int, exchange: Exchange) -> DataFrame:
    def run(t: pa.Table) -> pa.Table:
        s = _Shard(t, width)
        return exchange.rows(t.column("shard")[0].as_py(), (s.fp, s.ctx), s.least)[1]

    return kept.groupBy("shard").applyInArrow(run, exchange.schema)


def _codes(r: pa.Table) -> np.ndarray:
    """Answers in the order of a shard's entries, which are sorted as buckets are."""
    rows = sorted((b, d) for b, d in zip(r.column("bucket").to_pylist(), r.column("data").to_pylist(), strict=True) if b >= 0)
    return np.frombuffer(b"".join(x[1] for x in rows), np.uint8)


SENT = "bin long, shard int, entry int, doc long, w int, key binary"


def _sent(kept: DataFrame, replies: DataFrame, width: int, bits: int) -> DataFrame:
    """Contexts to compare, as bytes by anchor range (w = -1), and the windows of widespread anchors as 128-bit hashes."""

    def run(t: pa.Table, r: pa.Table) -> pa.Table:
        import xxhash

        s, code = _Shard(t, width), _codes(r)
        rows: list[tuple] = []
        for e in np.flatnonzero(code == COMPARE):
            i = s.first[e]
            rows.append((int(s.fp[e] >> U(48 - bits)), int(e), int(s.least[e]), -1, s.raw[s.lo[i] : s.hi[i] + width].tobytes()))
        for e in np.flatnonzero(code == SPREAD):
            i = s.first[e]
            for w in range(int(s.hi[i] - s.lo[i]) + 1):
                key = xxhash.xxh3_128_digest(s.raw[s.lo[i] + w : s.lo[i] + w + width].tobytes())
                rows.append((int.from_bytes(key[:7], "little"), int(e), int(s.least[e]), w, key))
        cols = list(zip(*rows, strict=True)) or [[]] * 5
        shard = t.column("shard")[0].as_py()
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary())
        a, b, c, d, e = (pa.array(list(x), k) for x, k in zip(cols, kinds, strict=True))
        return pa.table({"bin": a, "shard": pa.array([shard] * len(rows), pa.int32()), "entry": b, "doc": c, "w": d, "key": e})

    return kept.groupBy("shard").cogroup(replies.groupBy("shard")).applyInArrow(run, SENT)


def suffix_array(text: np.ndarray, rest: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes that share their first ``least`` bytes with another, sorted, and each one's common prefix with the one before.

    ``rest``: bytes to the end of the context, for each place; suffixes end there. UTF-8 has no byte 255, so bytes
    plus one leave 0 for the end.
    """
    sa = np.flatnonzero(rest >= least)
    if not len(sa):
        return sa, sa
    heads = fixed_hashes(prefix_sums(text), least)[sa]
    order = np.argsort(heads)
    same = heads[order][1:] == heads[order][:-1]
    sa = np.sort(sa[order[np.append(False, same) | np.append(same, False)]])
    if not len(sa):
        return sa, sa
    depth = -(-int(rest[sa].max()) // 8) * 8
    padded = np.zeros(len(text) + depth, np.uint8)
    padded[: len(text)] = text + np.uint8(1)
    rows = np.lib.stride_tricks.sliding_window_view(padded, depth)[sa].copy()
    rows[np.arange(depth) >= rest[sa][:, None]] = 0
    words = rows.view(">u8").astype(np.uint64)
    order = np.lexsort(words.T[::-1])
    rows = rows[order]
    unlike = rows[1:] != rows[:-1]
    lcp = np.where(unlike.any(1), unlike.argmax(1), depth)
    sa = sa[order]
    return sa, np.append(0, np.minimum(lcp, np.minimum(rest[sa[1:]], rest[sa[:-1]])))


def maximal_repeats(lcp: np.ndarray, left: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """(length, first, last) of the common-prefix intervals of at least ``least`` bytes whose suffixes do not all follow the same byte.

    ``left``: the byte before each suffix; negative where none is, which differs from every other.
    """
    high = np.flatnonzero(lcp >= least)
    runs = np.split(high, np.flatnonzero(np.diff(high) > 1) + 1) if len(high) else []
    for run in runs:
        stack: list[list] = []  # length, first suffix, byte to the left (None: several)
        first, last = int(run[0]) - 1, int(run[-1])
        for i in range(first, last + 2):
            n = int(lcp[i]) if first < i <= last else 0
            start, seen = i - 1, int(left[i - 1]) if i > first else -1
            if i > first and seen < 0:
                seen = None  # nothing to the left: diverse
            while stack and stack[-1][0] > n:
                length, low, had = stack.pop()
                seen = had if had == seen else None
                if seen is None:
                    yield length, low, i - 1
                start = low
            if n:
                if stack and stack[-1][0] == n:
                    stack[-1][2] = stack[-1][2] if stack[-1][2] == seen else None
                else:
                    stack.append([n, start, seen])


def _masks(sent: DataFrame, width: int) -> DataFrame:
    """(shard, entry, mask): bit w is set if the context's window w stands in a smaller document."""

    def run(t: pa.Table) -> pa.Table:
        keys = t.column("key").to_pylist()
        sizes = np.array([len(k) for k in keys], np.int64)
        text = np.frombuffer(b"".join(keys), np.uint8)
        start = np.cumsum(sizes) - sizes
        of = np.repeat(np.arange(len(keys)), sizes)
        rest = start[of] + sizes[of] - np.arange(len(text))
        docs = t.column("doc").to_numpy()
        sa, lcp = suffix_array(text, rest, width)
        left = np.where(sa == start[of[sa]], -1, text[np.maximum(sa - 1, 0)].astype(np.int64))
        own = docs[of[sa]]
        run = np.cumsum(lcp < width) - 1
        if len(sa):  # runs of one document need no scan
            first = np.flatnonzero(lcp < width)
            several = np.minimum.reduceat(own, first) < np.maximum.reduceat(own, first)
            lcp = np.where(several[run], lcp, 0)
        step = np.zeros(len(text) + 1, np.int64)
        for length, low, high in maximal_repeats(lcp, left, width):
            d = own[low : high + 1]
            at = sa[low : high + 1][d > d.min()]
            np.add.at(step, at, 1)
            np.add.at(step, at + length - width + 1, -1)
        hit = np.flatnonzero(np.cumsum(step[:-1]) > 0)
        mask = np.bincount(of[hit], weights=2.0 ** (hit - start[of[hit]]), minlength=len(keys)).astype(np.int64)
        some = np.flatnonzero(mask)
        return pa.table({"shard": t.column("shard").take(some), "entry": t.column("entry").take(some), "mask": pa.array(mask[some])})

    near = sent.filter("w < 0").groupBy("bin").applyInArrow(run, "shard int, entry int, mask long")
    far = sent.filter("w >= 0")
    low = far.groupBy("key").agg(F.min("doc").alias("low"))
    far = far.join(low, "key").filter("doc > low").groupBy("shard", "entry").agg(F.bit_or(F.expr("shiftleft(1L, w)")).alias("mask"))
    return near.union(far)


def _cleaned(kept: DataFrame, replies: DataFrame, width: int, keep: tuple[str, ...], as_text: bool) -> DataFrame:
    result = T.StructType([T.StructField(n, T.LongType()) for n in ("doc_id", "n_bytes", "n_removed", "n_spans")] + [T.StructField("kept", T.StringType() if as_text else T.BinaryType()), T.StructField("was_null", T.BooleanType())] + [kept.schema[c] for c in keep])

    def run(t: pa.Table, r: pa.Table) -> pa.Table:
        s, code = _Shard(t, width), _codes(r)
        step = np.zeros(len(s.raw) + 1, np.int64)
        if len(code):
            every = (code[s.entry] == COPY) | (s.own > s.least[s.entry])
            np.add.at(step, s.lo[every], 1)
            np.add.at(step, s.hi[every] + width, -1)
            mask = np.zeros(len(code), np.int64)
            for b, d in zip(r.column("bucket").to_pylist(), r.column("data").to_pylist(), strict=True):
                if b < 0:
                    a = np.frombuffer(d, np.int64).reshape(-1, 2)
                    mask[a[:, 0]] |= a[:, 1]
            some = np.flatnonzero(~every & (mask[s.entry] != 0))
            for w in range(width - KMER + 1):
                i = some[mask[s.entry[some]] >> w & 1 == 1]
                np.add.at(step, s.lo[i] + w, 1)
                np.add.at(step, s.lo[i] + w + width, -1)
        gone = np.cumsum(step[:-1]) > 0
        before = np.append(0, np.cumsum(gone))
        edge = gone.copy()
        edge[1:] &= ~gone[:-1]
        filled = s.offsets[:-1] < s.offsets[1:]
        at = s.offsets[:-1][filled]
        edge[at] = gone[at]
        spans = np.append(0, np.cumsum(edge))
        left = s.raw[~gone].tobytes() if len(s.raw) else b""
        lo, hi = s.offsets[:-1], s.offsets[1:]
        cut = np.append(0, (hi - before[hi])) if len(hi) else np.zeros(1, np.int64)
        cut[0] = lo[0] - before[lo[0]] if len(lo) else 0
        pieces = [left[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
        rest = pa.array([p.decode("utf-8", "ignore") for p in pieces], pa.string()) if as_text else pa.array(pieces, pa.binary())
        return pa.table({
            "doc_id": t.column("doc_id"), "n_bytes": pa.array(hi - lo), "n_removed": pa.array(before[hi] - before[lo]), "n_spans": pa.array(spans[hi] - spans[lo]),
            "kept": rest, "was_null": t.column("text").is_null(), **{c: t.column(c) for c in keep},
        })

    return kept.groupBy("shard").cogroup(replies.groupBy("shard")).applyInArrow(run, result)


def remove_repeats(docs: DataFrame, width: int = 50, spread: int = 20_000, keep: tuple[str, ...] = (), as_text: bool = False, fan: int = 1024) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, the ``kept`` bytes, whether the text was_null, and the columns named in ``keep``.

    With ``as_text`` kept is a string, and a character cut in two by a removed byte goes whole.

    A byte goes if a string of ``width`` bytes over it also starts in a document with a smaller doc_id. Texts are
    UTF-8 bytes, whole; null is empty; matches never cross documents; rows with a null doc_id neither remove nor
    lose anything; rows with equal doc_ids do not remove each other's. Repeated rows stay; other columns are ignored.
    Anchors with more than ``spread`` different contexts are compared window by window, by hash, over all tasks.
    Anchors and contexts are matched by 48 and 40 hash bits together. ``fan`` is the number of shards that ask together.
    """
    kept, count = shards(docs, 6 << 20, keep=keep)
    exchange = Contexts(count, fan, spread)
    asked = _requests(kept, width, exchange)
    asked = written(asked, "repeat-requests") if exchange.teams > 1 else asked
    replies = written(exchange.lowered(asked, exchange.answered(exchange.lifted(asked))).select("shard", "bucket", "data"), "repeat-replies")
    # Anchor ranges for the suffix arrays, in proportion to the shards.
    masks = _masks(written(_sent(kept, replies, width, min(40, (16 * count - 1).bit_length())), "repeat-contexts"), width)

    def packed(t: pa.Table) -> pa.Table:
        a = np.column_stack([t.column("entry").to_numpy().astype(np.int64), t.column("mask").to_numpy()])
        return pa.table({"shard": t.column("shard").slice(0, 1), "bucket": pa.array([-1], pa.int64()), "data": pa.array([a.tobytes()], pa.binary())})

    return _cleaned(kept, replies.unionByName(masks.groupBy("shard").applyInArrow(packed, "shard int, bucket long, data binary")), width, keep, as_text)


def op5_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op5_suffix_dedup": op5_suffix_dedup}
