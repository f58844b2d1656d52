"""Exact top-k inner products by the threshold algorithm over sorted per-dimension lists.

Vectors are dealt into blocks, and each block's lists are sorted once. A query reads the lists of a block from the ends
that its signs prefer, scores each row that it meets for the first time, and stops once what unread rows could score
at most is below its kth best. Nothing but rows met in the lists is ever scored.
"""

from __future__ import annotations

import math
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import written


class Lists:
    """A block's rows, and for each dimension its rows from the smallest component to the largest."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, up: np.ndarray | None = None):
        self.rows, self.ids = rows, ids
        self.up = np.argsort(rows, axis=0, kind="stable").astype(np.int32) if up is None else up

    def top(self, query: np.ndarray, own: int, k: int, floor: int | None = None) -> tuple[list[tuple[int, int]], int]:
        """The k best (score, id), best first, ties by smaller id, without ``own``; and how many rows were scored.

        With a ``floor`` only rows of at least that score are wanted, so that a block may stop before it has k of them.

        Each step goes down all lists, at first 2 entries, then half as far again.
        No row unread in every list can score more than the products at the lists' present depth add up to; once
        that is below the kth score, the rest cannot matter (an equal one might, by its id).
        """
        dims = np.flatnonzero(query)
        count, weights = len(self.ids), query[dims]
        rising, falling = dims[weights < 0], dims[weights > 0]
        seen = np.zeros(count, bool)
        best_ids, best = np.zeros(0, np.int64), np.zeros(0, np.int64)
        depth, step, scored = 0, 2, 0
        while depth < count and scored < count:
            after = min(count, depth + step)
            if len(dims):
                met = np.concatenate([self.up[depth:after, rising].ravel(), self.up[count - after : count - depth, falling].ravel()])
                met = met[~seen[met]]
                fresh = np.zeros(count, bool)
                fresh[met] = True
                rows = np.flatnonzero(fresh)
            else:
                rows = np.arange(depth, after)
            seen[rows] = True
            scored += len(rows)
            got = (self.rows[rows] @ query).astype(np.int64)
            keep = self.ids[rows] != own
            least = best[-1] if len(best) == k else floor
            if least is not None:
                keep &= got >= least
            best_ids, best = np.append(best_ids, self.ids[rows][keep]), np.append(best, got[keep])
            if len(best) > 4 * k:
                near = best >= np.partition(best, len(best) - k)[len(best) - k]
                best_ids, best = best_ids[near], best[near]
            top = np.lexsort((best_ids, -best))[:k]
            best_ids, best = best_ids[top], best[top]
            depth, step = after, max(2, after // 2)
            least = max([x for x in (int(best[-1]) if len(best) == k else None, floor) if x is not None], default=None)
            if least is not None and depth < count and len(dims) and self._bound(query, rising, falling, depth, count) < least:
                break
        return list(zip(best.tolist(), best_ids.tolist(), strict=True)), scored

    def _bound(self, query: np.ndarray, rising: np.ndarray, falling: np.ndarray, depth: int, count: int) -> int:
        """At least what a row unread at this depth can score: no row need have all these components, so their sum may leave the scores' type. It is taken in doubles and rounded up by their greatest error."""
        ends = np.append(self.rows[self.up[depth - 1, rising], rising], self.rows[self.up[count - depth, falling], falling]).astype(np.float64)
        terms = ends * np.append(query[rising], query[falling]).astype(np.float64)
        return math.ceil(terms.sum() + np.abs(terms).sum() * (len(terms) + 4) * 2.0**-52)


#: A block as one row: its rows, ids and lists as bytes.
BLOCK = "block int, n int, rows binary, ids binary, up binary"
FOUND = "block int, uid long, query_id long, vec_id long, score long, scored long"


def _matrix(t: pa.Table, width: int, kind: np.dtype) -> np.ndarray:
    """The vectors of a table, filled up with zeros."""
    v = t.column("v").combine_chunks()
    out = np.zeros((len(v), width), kind)
    sizes = v.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    of = np.repeat(np.arange(len(v)), sizes)
    out[of, np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = v.flatten().to_numpy()
    return out


def top_products(vectors: DataFrame, queries: DataFrame, k: int = 10, block: int = 16384, query_block: int = 16384, counted: bool = False) -> DataFrame:
    """query_id, rank, vec_id, score: for each query row its k highest integer inner products with other rows.

    Both tables have (vec_id, embedding); a component x counts as floor(1024 * x). Rows with a null vec_id, a null
    vector, or null or non-finite components take no part; a shorter vector counts as filled up with zeros; equal
    rows are one query; a query's own vec_id is never among its results; a repeated row of the vectors is found as often as it
    stands. Vectors so long that a score could leave a 64-bit integer end the job. Other columns are ignored; empty tables give
    an empty one. Vectors are dealt into blocks of about ``block`` rows by a hash of the row, queries into blocks of
    ``query_block``; each pair of blocks is one bounded task, and the blocks' k best meet in a window. The first block is searched before
    the others, and what a query's kth row scores there is the floor of its search in them. With ``counted`` the rows are
    instead (query_id, scored): how many rows each query scored.
    """

    def whole(df: DataFrame) -> DataFrame:
        v = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).dropna()
        v = v.filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))))
        return v.select("vec_id", F.transform("v", lambda x: F.floor(x * 1024)).alias("v"), F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + (F.abs(x) * 1024 + 1) ** 2)).alias("norm"))

    def sizes(df: DataFrame) -> tuple[int, int, float]:
        r = df.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("w"), F.max("norm").alias("norm")).first()
        return r.n, r.w or 0, r.norm or 0.0

    left, right = whole(vectors), whole(queries)
    (n, wide, most), (m, wide_q, most_q) = sizes(left), sizes(right)
    width = max(1, wide, wide_q)
    limit = most * most_q  # no sum of products, nor a part of one, is larger than the product of the lengths
    if limit >= 2.0**62:
        raise ValueError("components too large: a score could leave a 64-bit integer")
    # Sums of whole numbers are exact in floats while all of them stay below the mantissa, and faster there.
    kind = np.dtype(np.float32 if limit < 2.0**24 else np.float64 if limit < 2.0**53 else np.int64)
    blocks, asked = max(1, math.ceil(n / block)), max(1, math.ceil(m / query_block))
    key = F.xxhash64("vec_id", "v")
    left = left.select(F.pmod(key, F.lit(blocks)).cast("int").alias("block"), "vec_id", "v")
    right = right.select("vec_id", "v").dropDuplicates().select(F.pmod(key, F.lit(asked)).cast("int").alias("asked"), key.alias("uid"), "vec_id", "v")

    def build(t: pa.Table) -> pa.Table:
        x = Lists(_matrix(t, width, kind), t.column("vec_id").to_numpy())
        return pa.table({"block": t.column("block").slice(0, 1), "n": pa.array([len(x.ids)], pa.int32()), "rows": pa.array([x.rows.tobytes()], pa.binary()), "ids": pa.array([x.ids.tobytes()], pa.binary()), "up": pa.array([x.up.tobytes()], pa.binary())})

    def pack(t: pa.Table) -> pa.Table:
        floors = t.column("floor").fill_null(-(2**63)).to_numpy()
        return pa.table({"asked": t.column("asked").slice(0, 1), "uids": pa.array([t.column("uid").to_numpy().tobytes()], pa.binary()), "own": pa.array([t.column("vec_id").to_numpy().tobytes()], pa.binary()), "wanted": pa.array([_matrix(t, width, kind).tobytes()], pa.binary()), "floors": pa.array([floors.tobytes()], pa.binary())})

    lists = written(left.groupBy("block").applyInArrow(build, BLOCK), "search-lists")

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        out: list[tuple[int, ...]] = []
        for x in a.to_pylist():
            held = Lists(np.frombuffer(x["rows"], kind).reshape(x["n"], width), np.frombuffer(x["ids"], np.int64), np.frombuffer(x["up"], np.int32).reshape(x["n"], width))
            for y in b.to_pylist():
                uids, own, floors = (np.frombuffer(y[c], np.int64).tolist() for c in ("uids", "own", "floors"))
                for uid, mine, floor, q in zip(uids, own, floors, np.frombuffer(y["wanted"], kind).reshape(len(own), width), strict=True):
                    best, scored = held.top(q, mine, k, None if floor == -(2**63) else floor)
                    out += [(x["block"], uid, mine, i, s, scored) for s, i in best or [(None, None)]]
        cols = list(zip(*out, strict=True)) or [[]] * 6
        return pa.table({n: pa.array(list(c), pa.int32() if n == "block" else pa.int64()) for n, c in zip(("block", "uid", "query_id", "vec_id", "score", "scored"), cols, strict=True)})

    def searched(lists: DataFrame, right: DataFrame, first: int, last: int) -> DataFrame:
        """Blocks ``first`` to ``last`` against all queries, as ``FOUND`` rows; without a result one row that has none."""
        wanted = written(right.groupBy("asked").applyInArrow(pack, "asked int, uids binary, own binary, wanted binary, floors binary"), "search-queries")
        a = lists.select("*", F.explode(F.sequence(F.lit(0), F.lit(asked - 1))).alias("asked"))
        b = wanted.select("*", F.explode(F.sequence(F.lit(first), F.lit(last))).alias("block"))
        return a.groupBy("block", "asked").cogroup(b.groupBy("block", "asked")).applyInArrow(run, FOUND)

    best = written(searched(lists.filter("block = 0"), right.withColumn("floor", F.lit(None).cast("long")), 0, 0), "search-first")
    if blocks > 1:
        full = best.filter("score is not null").groupBy("uid", "query_id").agg(F.min("score").alias("floor"), F.count("*").alias("n")).filter(F.col("n") >= k)
        floors = full.select("uid", F.col("query_id").alias("vec_id"), "floor")
        best = best.union(searched(lists.filter("block > 0"), right.join(floors, ["uid", "vec_id"], "left"), 1, blocks - 1))
    if counted:
        return best.select("block", "uid", "query_id", "scored").distinct().groupBy("query_id").agg(F.sum("scored").alias("scored"))
    order = Window.partitionBy("query_id", "uid").orderBy(F.desc("score"), "vec_id")
    return best.filter("score is not null").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_threshold_search(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_products(vectors, vectors.filter("vec_id % 100 = 0"))


ORACLES = {
    "op4_threshold_search": """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as v
  from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
p as (
  select q.vec_id as query_id, c.vec_id as vec_id,
    cast(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) as bigint) as score
  from v q join v c on q.vec_id % 100 = 0 and c.vec_id <> q.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from p)
select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 10"""
}
QUERIES = {"op4_threshold_search": op4_threshold_search}
