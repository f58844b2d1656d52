"""N-gram Jaccard join with signature trees.

1. Every shard of documents asks about each distinct shingle hash once (packed, by hash range) and hears in how many
   documents it stands. A document with fewer shared shingles than the threshold needs can have no partner and goes.
2. Documents with equal shingle sets become one node. Of each node's shingles, ordered by rarity, the prefix that a
   partner must meet gives a cheap graph; its components hold all links.
3. Inside a component (or a pair of its blocks, where it is large), signature trees with OR-ed bitmaps and size
   ranges are traversed pairwise; pairs that no bound excludes are compared exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytekernel import LOWER, SPACE, U, chunks, mix, planes, prefix_sums, span_hashes, unplanes, word_spans
from .exchange import Exchange
from .graphs import connected_components, spanning
from .store import shards, written

WIDTH = 2048
_BITS = np.array([1 << i for i in range(64)], np.uint64)


def shingle_sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """For each text its distinct shingles as sorted hashes; a text of fewer words is one shingle, one without words has none."""
    factor = mix(np.arange(1, size + 1, dtype=np.uint64))
    for low, high, raw, offsets in chunks(column, 1 << 20):
        buf = LOWER[raw]
        starts, ends, first = word_spans(buf, offsets, SPACE)
        w = span_hashes(prefix_sums(buf), starts, ends)
        with np.errstate(over="ignore"):
            total = sum((w[k : len(w) - size + 1 + k] * factor[k] for k in range(size)), U(0)) if len(w) >= size else np.zeros(0, np.uint64)
        h = mix(total)
        for i in range(high - low):
            a, b = first[i], first[i + 1]
            if b - a >= size:
                yield np.unique(h[a : b - size + 1])
            elif b > a:
                with np.errstate(over="ignore"):
                    yield mix(np.array([int(b - a)], np.uint64) * U(0xA24BAED4963EE407) ^ (w[a:b] * factor[: b - a]).sum(keepdims=True))
            else:
                yield np.zeros(0, np.uint64)


def needed(n: int, percent: int) -> int:
    """Shingles of a set of n that a partner must share."""
    return -(-n * percent // 100)


def _distinct(column: pa.Array, size: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    sets = list(shingle_sets(column, size))
    every = np.sort(np.concatenate([s >> U(16) for s in sets] or [np.zeros(0, np.uint64)]))
    at = np.flatnonzero(np.append(True, every[1:] != every[:-1])) if len(every) else np.zeros(0, np.int64)
    return sets, every[at], np.diff(np.append(at, len(every)))


class Frequencies(Exchange):
    """Keys: 48 bits of shingle hashes; values: in how many documents of the shard; answers: in how many of all (255: that or more)."""

    payload, kind, combine = ("keys", "counts"), np.uint8, np.add

    def unpack(self, t: pa.Table) -> tuple[list[int], tuple[np.ndarray, ...], np.ndarray]:
        rows = [unplanes(k + b"\0" * (len(k) // 6 * 2), np.uint64) for k in t.column("keys").to_pylist()]
        return [len(r) for r in rows], (np.concatenate(rows),), np.frombuffer(b"".join(t.column("counts").to_pylist()), np.uint8).astype(np.int64)

    def pack(self, keys: tuple[np.ndarray, ...], values: np.ndarray) -> tuple[bytes, ...]:
        return planes(keys[0])[: 6 * len(values)], np.minimum(values, 255).astype(np.uint8).tobytes()

    def hashed(self, keys: tuple[np.ndarray, ...]) -> np.ndarray:
        return keys[0] << U(16)

    def answer(self, keys: tuple[np.ndarray, ...], values: np.ndarray) -> tuple[np.ndarray, list[int]]:
        _, at = np.unique(keys[0], return_inverse=True)
        return np.minimum(np.bincount(at, values), 255)[at], []


def _requests(kept: DataFrame, size: int, exchange: Exchange) -> DataFrame:
    def run(t: pa.Table) -> pa.Table:
        _, keys, counts = _distinct(t.column("text").combine_chunks(), size)
        return exchange.rows(t.column("shard")[0].as_py(), (keys,), counts)[1]

    return kept.groupBy("shard").applyInArrow(run, exchange.schema)


def _sets(kept: DataFrame, replies: DataFrame, size: int, percent: int, exchange: Exchange) -> DataFrame:
    """(doc_id, n, digest, shared, rare): for documents that may have partners the shared shingles, rarest first, and how many of them are in the prefix."""

    def run(t: pa.Table, r: pa.Table) -> pa.Table:
        sets, keys, _ = _distinct(t.column("text").combine_chunks(), size)
        df = exchange.values(r, np.arange(len(keys)))  # keys are sorted, as buckets are
        ns, digests, shared, rare = [], [], [], []
        for s in sets:
            n = len(s)
            ns.append(n)
            d = df[np.searchsorted(keys, s >> U(16))] if n else df[:0]
            common = d > 1
            m = int(common.sum())
            if not n or m < needed(n, percent):
                for x in (digests, shared, rare):
                    x.append(None)
                continue
            digests.append(xxhash.xxh3_128_digest(s.tobytes()))
            order = np.argsort(d[common], kind="stable")
            shared.append(s[common][order].tobytes())
            rare.append(n - needed(n, percent) + 1 - (n - m))
        return pa.table({"doc_id": t.column("doc_id"), "n": pa.array(ns, pa.int64()), "digest": pa.array(digests, pa.binary()), "shared": pa.array(shared, pa.binary()), "rare": pa.array(rare, pa.int64())})

    return kept.groupBy("shard").cogroup(replies.groupBy("shard")).applyInArrow(run, "doc_id long, n long, digest binary, shared binary, rare long")


def _prefixes(nodes: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = [np.frombuffer(s, np.int64)[:k] for s, k in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            node = np.repeat(batch.column(0).to_numpy(), [len(x) for x in tokens])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens) if tokens else node), pa.array(node)], ["token", "node"])

    return nodes.select("node", "shared", "rare").mapInArrow(run, "token long, node long")


class SignatureTree:
    """Sets in leaves of ``leaf``, nodes of ``fan``: each node has the OR of its sets' bitmaps, the range of their sizes and the most that bitmaps can undercount."""

    def __init__(self, sizes: np.ndarray, sets: list[np.ndarray], leaf: int = 16, fan: int = 8):
        self.order = sorted(range(len(sets)), key=lambda i: (sets[i].min() if len(sets[i]) else 0, sizes[i], i))
        self.sizes = sizes[self.order]
        self.sets = [sets[i] for i in self.order]
        self.bitmaps = np.zeros((len(sets), WIDTH // 64), np.uint64)
        for row, s in zip(self.bitmaps, self.sets, strict=True):
            at = (s >> U(20)).astype(np.int64) & (WIDTH - 1)
            np.bitwise_or.at(row, at >> 6, _BITS[at & 63])
        self.excess = np.array([len(s) for s in self.sets], np.int64) - np.bitwise_count(self.bitmaps).sum(1)
        spans = [(lo, min(lo + leaf, len(sets))) for lo in range(0, len(sets), leaf)]
        self.nodes = [self._node(lo, hi, ()) for lo, hi in spans]
        level = list(range(len(self.nodes)))
        while len(level) > 1:
            above = []
            for i in range(0, len(level), fan):
                below = level[i : i + fan]
                above.append(len(self.nodes))
                self.nodes.append(self._node(self.nodes[below[0]][0], self.nodes[below[-1]][1], tuple(below)))
            level = above
        self.root = level[0]

    def _node(self, lo: int, hi: int, below: tuple) -> tuple:
        return lo, hi, below, np.bitwise_or.reduce(self.bitmaps[lo:hi]), int(self.sizes[lo:hi].min()), int(self.sizes[lo:hi].max()), int(self.excess[lo:hi].max())


def tree_links(a: SignatureTree, b: SignatureTree, percent: int, label_a: np.ndarray, label_b: np.ndarray) -> Iterator[tuple[int, int]]:
    """Links between the sets of two trees (or of one with itself), without those inside a component that is already joined.

    ``label_a`` and ``label_b`` are views of one array of component labels, kept up to date here.
    """
    own = a is b
    every = label_a if own else label_a.base
    stack = [(a.root, b.root)]
    while stack:
        i, j = stack.pop()
        lo, hi, below, bits, least, most, excess = a.nodes[i]
        lo2, hi2, below2, bits2, least2, most2, excess2 = b.nodes[j]
        if 100 * most < percent * least2 or 100 * most2 < percent * least:
            continue
        # overlap >= percent / (100 + percent) * (sum of sizes), and no more than the common bits plus what the bitmaps hide
        if (int(np.bitwise_count(bits & bits2).sum()) + min(excess, excess2)) * (100 + percent) < percent * (least + least2):
            continue
        x, y = label_a[lo:hi], label_b[lo2:hi2]
        if x[0] == y[0] and (x == x[0]).all() and (y == x[0]).all():
            continue
        if below or below2:
            first, second = below or (i,), below2 or (j,)
            pairs = [(p, q) for p in first for q in second if not (own and i == j and q < p)]
            stack += sorted(pairs, key=lambda t: -abs(t[0] - t[1]))
            continue
        for p in range(lo, hi):
            q0 = max(lo2, p + 1) if own and i == j else lo2
            if q0 >= hi2:
                continue
            n, m = a.sizes[p], b.sizes[q0:hi2]
            bound = np.bitwise_count(a.bitmaps[p] & b.bitmaps[q0:hi2]).sum(1) + np.minimum(a.excess[p], b.excess[q0:hi2])
            for q in np.flatnonzero((bound.astype(np.int64) * (100 + percent) >= percent * (n + m)) & (label_b[q0:hi2] != label_a[p])) + q0:
                if label_b[q] == label_a[p]:
                    continue
                inter = len(np.intersect1d(a.sets[p], b.sets[q], assume_unique=True))
                if 100 * inter >= percent * (n + b.sizes[q] - inter):
                    old, new = max(label_a[p], label_b[q]), min(label_a[p], label_b[q])
                    every[every == old] = new
                    yield a.order[p], b.order[q]


def _links(cells: DataFrame, percent: int) -> DataFrame:
    """Links of each cell (a component, or two of its blocks: side 0 and 1), as a spanning set."""

    def run(t: pa.Table) -> pa.Table:
        rows: dict[str, tuple[list, list]] = {}
        for cell, side, node, n, shared in zip(*(t.column(c).to_pylist() for c in ("cell", "side", "node", "n", "shared")), strict=True):
            rows.setdefault(cell, ([], []))[side].append((node, n, np.sort(np.frombuffer(shared, np.uint64))))
        found: list[tuple[int, int]] = []
        for left, right in rows.values():
            sides = [x for x in (left, right) if x]
            if len(sides) == 1 and len(left or right) < 2:
                continue
            labels = np.arange(sum(map(len, sides)))
            trees = [SignatureTree(np.array([r[1] for r in x], np.int64), [r[2] for r in x]) for x in sides]
            if len(trees) == 1:
                found += [(sides[0][p][0], sides[0][q][0]) for p, q in tree_links(trees[0], trees[0], percent, labels, labels)]
            else:
                cut = len(sides[0])
                found += [(sides[0][p][0], sides[1][q][0]) for p, q in tree_links(*trees, percent, labels[:cut], labels[cut:])]
        found = spanning(found)
        return pa.table({"a": pa.array([x[0] for x in found], pa.int64()), "b": pa.array([x[1] for x in found], pa.int64())})

    return cells.groupBy("bin").applyInArrow(run, "a long, b long")


def jaccard_components(docs: DataFrame, size: int = 5, percent: int = 75, block_shingles: int = 1_000_000, fan: int = 1024) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles and component_id, the smallest doc_id that links reach.

    Two documents link when 100 * |intersection| >= ``percent`` * |union| of their distinct shingles of ``size``
    words. Null and empty texts, and texts without words, have no shingles and no links. Equal texts are one node,
    so copies are never expanded into pairs. Rows with a null doc_id link with nothing and get a null component.
    Repeated rows stay repeated; other columns are ignored. Components of more than ``block_shingles`` shingles are
    cut into blocks by size and hash, and all pairs of blocks whose sizes allow a link are compared.
    Sets are held as 64-bit shingle hashes, equal sets told by a 128-bit digest. ``fan`` is the number of shards that ask together.
    """
    kept, count = shards(docs, 6 << 20)
    exchange = Frequencies(count, fan)
    asked = _requests(kept, size, exchange)
    asked = written(asked, "jaccard-requests") if exchange.teams > 1 else asked
    found = written(_sets(kept, exchange.lowered(asked, exchange.answered(exchange.lifted(asked))), size, percent, exchange), "jaccard-sets")
    nodes = found.filter("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("node"), F.first("n").alias("n"), F.first("shared").alias("shared"), F.first("rare").alias("rare"))
    nodes = written(nodes, "jaccard-nodes")
    prefix = written(_prefixes(nodes), "jaccard-prefixes")
    hub = prefix.groupBy("token").agg(F.min("node").alias("hub"), F.count("*").alias("c")).filter("c > 1")
    parts = connected_components(prefix.join(hub, "token").filter("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")))
    inside = written(nodes.select("node", "n", "shared").join(parts, "node").withColumn("m", (F.octet_length("shared") / 8).cast("long")), "jaccard-parts")
    # size bands of a factor 4/3: partners are in the same or the next band (the next but one covers rounding)
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(4 / 3)).cast("int")
    banded = inside.withColumn("band", band)
    blocks = banded.groupBy("component", "band").agg(F.sum("m").alias("m")).withColumn("all", F.sum("m").over(Window.partitionBy("component")))
    blocks = blocks.select("component", "band", (F.col("all") <= block_shingles).alias("one"), F.ceil(F.col("m") / block_shingles).cast("int").alias("salts")).checkpoint()
    whole = banded.join(blocks, ["component", "band"])
    cell = F.col("component").cast("string")
    single = whole.filter("one").select(cell.alias("cell"), F.lit(0).alias("side"), "node", "n", "shared")
    listed = blocks.filter("not one").select("component", "band", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    left, right = listed.select("component", F.struct("band", "salt").alias("x")), listed.select("component", F.struct("band", "salt").alias("y"))
    pairs = left.join(right, "component").filter("x <= y and y.band - x.band <= 2")
    name = F.concat_ws("/", cell, "x.band", "x.salt", "y.band", "y.salt")
    sides = pairs.select("component", "x.band", "x.salt", F.lit(0).alias("side"), name.alias("cell")).union(pairs.filter("x <> y").select("component", "y.band", "y.salt", F.lit(1).alias("side"), name.alias("cell")))
    salted = whole.filter("not one").withColumn("salt", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int"))
    large = salted.join(sides, ["component", "band", "salt"]).select("cell", "side", "node", "n", "shared")
    bins = max(8, 8 * count)
    cells = single.union(large).withColumn("bin", F.pmod(F.xxhash64("cell"), F.lit(bins)))
    same = connected_components(written(_links(cells, percent), "jaccard-links"))
    label = nodes.select("digest", "node").join(same, "node").select("digest", "component")
    # Most documents have no digest: they have no partner, and do not take part in the join.
    some = found.filter("digest is not null").select("doc_id", "n", "digest").join(nodes.select("digest", "node"), "digest", "left").join(label, "digest", "left")
    some = some.select("doc_id", "n", F.coalesce("component", "node", "doc_id").alias("component_id"))
    out = some.union(found.filter("digest is null").select("doc_id", "n", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def op6_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op6_jaccard_join": op6_jaccard_join}
