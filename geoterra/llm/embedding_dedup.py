"""Near-equal embeddings: spherical k-means deals vectors to cells, blocked cosine products compare within cells.

A vector is compared in its own cell and with the cells of lower number whose bisecting plane lies within ``reach`` of it.
Two vectors in different cells lie on either side of the plane between the cells' centres, so both are within
their distance of it; a pair is met once, in the lower cell. Cells that are too large are split again by centres of their own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graphs import connected_components, spanning
from .order import placed
from .store import written

POINT = "node string, home boolean, uid long, many long, unit binary"
LINKS = "a long, b long, n long"


def _units(column: pa.ChunkedArray) -> np.ndarray:
    """The unit vectors of a column of packed doubles, all of one length."""
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1)


def centres(units: np.ndarray, cells: int, rounds: int = 12) -> np.ndarray:
    """At most ``cells`` centres of spherical k-means; the first ones are rows as far apart as a greedy choice finds."""
    first = [0]
    best = units @ units[0]
    for _ in range(cells - 1):
        far = int(np.argmin(best))
        if best[far] > 1 - 1e-12:
            break
        first.append(far)
        best = np.maximum(best, units @ units[far])
    found = units[first]
    for _ in range(rounds):
        of = np.argmax(units @ found.T, axis=1)
        sums = np.zeros_like(found)
        np.add.at(sums, of, units)
        size = np.linalg.norm(sums, axis=1)
        new = np.where(size[:, None] > 1e-9, sums / np.maximum(size, 1e-9)[:, None], found)
        if np.allclose(new, found, atol=1e-6):
            break
        found = new
    return found


def linked(x: np.ndarray, y: np.ndarray, weight: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """How much linked weight the rows of ``x`` and of ``y`` have on the other side, and a spanning forest of the links as (row of x, row of y), x before y.

    ``weight`` is of x's rows and then of y's. With ``same`` the sides are one and a row is not compared with itself. Products within
    1e-12 of the threshold are taken again by a plain sum of products.
    """
    left, right = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64)
    wx, wy = weight[: len(x)], weight[len(x) :]
    forest: list[tuple[int, int]] = []
    step = 1024
    for i in range(0, len(x), step):
        for j in range(0, len(y), step):
            if same and j < i:
                continue
            product = x[i : i + step] @ y[j : j + step].T
            near = product >= threshold
            for p, q in np.argwhere(np.abs(product - threshold) < 1e-12):
                near[p, q] = math.fsum(x[i + p] * y[j + q]) >= threshold
            if same and i == j:
                near = np.triu(near, 1)
            if not near.any():
                continue
            left[i : i + step] += near @ wy[j : j + step]
            right[j : j + step] += wx[i : i + step] @ near
            shift = 0 if same else len(x)
            p, q = np.nonzero(near)
            for at in range(0, len(p), 1 << 17):
                forest = spanning(forest + list(zip((p[at : at + (1 << 17)] + i).tolist(), (q[at : at + (1 << 17)] + j + shift).tolist(), strict=True)))
    return left, right, forest


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``POINT`` rows of (node, home, uid, many, v): unit vectors, scaled by their largest component first."""
    for t in batches:
        values, ends = t.column("v").flatten().to_numpy(), np.cumsum(t.column("v").value_lengths().to_numpy(zero_copy_only=False))
        out = []
        for x in np.split(values, ends[:-1]) if len(ends) else []:
            x = x / np.abs(x).max()
            out.append((x / math.sqrt(x @ x)).tobytes())
        yield pa.RecordBatch.from_arrays([*t.columns[:4], pa.array(out, pa.binary())], [c.split()[0] for c in POINT.split(", ")])


def _split(points: DataFrame, big: DataFrame, limit: int, fan: int, sample: int, reach: float) -> DataFrame:
    """Rows of ``POINT`` of the nodes ``big`` (node, n), dealt to child nodes: at home in the nearest, visiting those within reach."""
    key = F.xxhash64("uid")
    own = points.join(big, "node")
    chosen = own.filter(F.col("home") & (key <= -(2**63) + (F.least(F.lit(1.0), F.lit(2.0 * sample) / F.col("n")) * (2.0**64 - 4096)).cast("decimal(38,0)")))

    def fit(t: pa.Table) -> pa.Table:
        t = t.sort_by("uid")
        cells = max(2, min(fan, math.ceil(t.column("n")[0].as_py() / (limit // 2))))
        return pa.table({"node": t.column("node").slice(0, 1), "centres": pa.array([centres(_units(t.column("unit")), cells).tobytes()], pa.binary())})

    fitted = written(chosen.select("node", "uid", "unit", "n").groupBy("node").applyInArrow(fit, "node string, centres binary"), "cell-centres")
    dealt = own.withColumn("salt", F.pmod(key, F.ceil(F.col("n") / 8192)).cast("int"))
    wanted = fitted.join(big, "node").select("node", "centres", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / 8192).cast("int") - 1)).alias("salt"))

    def route(rows: pa.Table, middle: pa.Table) -> pa.Table:
        out: dict[str, list] = {c.split()[0]: [] for c in POINT.split(", ")}
        if len(rows) and len(middle):
            units = rows.column("unit").to_pylist()
            x = _units(rows.column("unit"))
            c = np.frombuffer(middle.column("centres")[0].as_py(), np.float64).reshape(-1, x.shape[1])
            products = x @ c.T
            nearest = np.argmax(products, axis=1)
            apart = np.sqrt(np.maximum(2 - 2 * c @ c.T, 0))
            gap = products[np.arange(len(x)), nearest][:, None] - products
            at_home = np.array(rows.column("home").to_pylist())
            visits = gap <= reach * apart[nearest]
            # Of two vectors at home here the one in the cell of higher number visits; a visitor goes wherever it may find one.
            visits &= ~at_home[:, None] | (np.arange(len(c))[None, :] <= nearest[:, None])
            visits[np.arange(len(x)), nearest] = True
            row, cell = np.nonzero(visits)
            names, ids, many = (rows.column(n).to_pylist() for n in ("node", "uid", "many"))
            row, cell = row.tolist(), cell.tolist()
            out["node"] = [f"{names[r]}.{k}" for r, k in zip(row, cell, strict=True)]
            out["home"] = [bool(at_home[r] and nearest[r] == k) for r, k in zip(row, cell, strict=True)]
            out["uid"], out["many"], out["unit"] = [ids[r] for r in row], [many[r] for r in row], [units[r] for r in row]
        kinds = (pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.binary())
        return pa.table({n: pa.array(v, k) for (n, v), k in zip(out.items(), kinds, strict=True)})

    return dealt.drop("n").groupBy("node", "salt").cogroup(wanted.groupBy("node", "salt")).applyInArrow(route, POINT)


def cells(points: DataFrame, limit: int, fan: int, sample: int, reach: float) -> DataFrame:
    """``POINT`` rows in nodes of at most ``limit`` rows at home, but for nodes that centres do not divide."""
    done, level = None, points
    sizes = lambda df: df.filter("home").groupBy("node").agg(F.count("*").alias("n"))
    big = written(sizes(level).filter(F.col("n") > limit), "large-cells")
    while not big.isEmpty():
        rest = level.join(big.select("node"), "node", "left_anti")
        done = rest if done is None else done.union(rest)
        level = written(_split(level, big, limit, fan, sample, reach), "cells")
        child = sizes(level).withColumn("of", F.expr("substring(node, 1, length(node) - length(substring_index(node, '.', -1)) - 1)"))
        was = big.select(F.col("node").alias("of"), F.col("n").alias("had"))
        big = written(child.join(was, "of").filter((F.col("n") > limit) & (F.col("n") <= 0.9 * F.col("had"))).select("node", "n"), "large-cells")
    return level if done is None else done.union(level)


def near_links(points: DataFrame, threshold: float, block: int = 8192) -> DataFrame:
    """``LINKS`` rows of points in nodes: (uid, null, linked weight) and links (a, b, null) that join up what is linked in a pair of blocks."""
    sizes = points.groupBy("node").agg(F.count_if("home").alias("h"), F.count_if(~F.col("home")).alias("v"))
    sizes = sizes.select("node", F.ceil(F.col("h") / block).cast("int").alias("h"), F.ceil(F.col("v") / block).cast("int").alias("v"))
    rows = points.join(sizes.filter("h > 0"), "node")
    mine = F.pmod(F.xxhash64("uid", F.lit(1)), F.greatest(F.lit(1), F.when(F.col("home"), F.col("h")).otherwise(F.col("v")))).cast("int")
    rows = rows.withColumn("block", mine)
    # A task for every two blocks at home, and for every block at home and block of visitors (numbered from -1 down).
    partner = F.when(F.col("home"), F.concat(
        F.transform(F.sequence(F.lit(0), F.col("h") - 1), lambda k: F.struct(F.least(k, F.col("block")).alias("i"), F.greatest(k, F.col("block")).alias("j"))),
        F.transform(F.when(F.col("v") > 0, F.sequence(F.lit(-1), -F.col("v"), F.lit(-1))).otherwise(F.array().cast("array<int>")), lambda k: F.struct(F.col("block").alias("i"), k.alias("j"))),
    )).otherwise(F.transform(F.sequence(F.lit(0), F.col("h") - 1), lambda k: F.struct(k.alias("i"), (-F.col("block") - 1).alias("j"))))
    tasks = rows.select("node", F.explode(partner).alias("task"), "block", "home", "uid", "many", "unit").select("node", "task.i", "task.j", ((F.col("home")) & (F.col("block") == F.col("task.i"))).alias("first"), "uid", "many", "unit")

    def compare(t: pa.Table) -> pa.Table:
        i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
        first = np.array(t.column("first").to_pylist())
        x, uids, many = _units(t.column("unit")), t.column("uid").to_numpy(), t.column("many").to_numpy()
        if i == j:
            left, right, forest = linked(x, x, np.append(many, many), threshold, True)
            found, order = left + right, np.arange(len(uids))
        else:
            order = np.append(np.flatnonzero(first), np.flatnonzero(~first))
            k = int(first.sum())
            left, right, forest = linked(x[order[:k]], x[order[k:]], many[order], threshold, False)
            found = np.append(left, right)
        ids = uids[order]
        some = np.flatnonzero(found)
        a = ids[some].tolist() + [int(ids[p]) for p, _ in forest]
        b = [None] * len(some) + [int(ids[q]) for _, q in forest]
        n = found[some].tolist() + [None] * len(forest)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "n": pa.array(n, pa.int64())})

    return tasks.groupBy("node", "i", "j").applyInArrow(compare, LINKS)


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, certainty: float = 3.0, limit: int = 4096, fan: int = 64, sample: int = 4096, block: int = 8192) -> DataFrame:
    """Per row of ``vectors`` (vec_id, embedding, label): vec_id, n_links (other rows linked directly), component_id (the smallest vec_id that links lead to), kept.

    Only rows of equal, not null label and equal length link, by cosine in double precision of at least ``threshold``. Equal vectors are
    compared once and counted as often as they stand. A label with more than ``limit`` different vectors is dealt to at most ``fan`` cells
    fitted on about 2 * ``sample`` rows of it, and large cells again; no row is left out. ``certainty`` sets the reach of a visit: that many
    times the spread, in one direction, of the difference of two vectors just at the threshold (chord / sqrt(dimensions)), but no
    more than the chord, which misses nothing (``certainty`` = inf compares exactly). Vectors that are null, zero or
    hold null or non-finite components, and rows without a label or vec_id, link with nothing: n_links 0, component_id their own vec_id
    (null without one, not kept). A repeated vec_id is a vector of its own with the same id. ``kept`` is one row per group, that of the smallest
    vec_id. Other columns are ignored; an empty table gives an empty one.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), F.col("label").cast("string").alias("label"))
    sound = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("sound", F.coalesce(sound, F.lit(False)))
    # -0.0 and 0.0 are equal components.
    same = rows.filter("sound").select("vec_id", "label", F.transform("v", lambda x: x + 0.0).alias("v"))
    distinct = written(same.groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("many")), "vectors")
    unique = distinct.groupBy("rep").count().filter("count > 1").isEmpty()
    distinct = distinct.withColumn("uid", F.col("rep")) if unique else placed(distinct.withColumn("every", F.lit(0)), ["every"], ["rep"], "numbered-vectors", "uid")

    node = F.concat(F.col("label"), F.lit("/"), F.size("v").cast("string")).alias("node")
    points = written(distinct.select(node, F.lit(True).alias("home"), "uid", "many", "v").mapInArrow(_packed, POINT), "unit-vectors")
    width = points.agg(F.max(F.length("unit"))).first()[0] or 8
    chord = math.sqrt(2 - 2 * threshold)
    reach = min(chord, certainty * chord / math.sqrt(width // 8))
    links = written(near_links(cells(points, limit, fan, sample, reach), threshold, block), "near-links")
    counts = links.filter("n is not null").groupBy(F.col("a").alias("uid")).agg(F.sum("n").alias("n"))
    parts = connected_components(links.filter("b is not null").select("a", "b")).select(F.col("node").alias("uid"), "component")
    found = distinct.join(counts, "uid", "left").join(parts, "uid", "left").withColumn("component", F.coalesce("component", "uid"))
    found = found.withColumn("component_id", F.col("component")) if unique else found.join(distinct.select(F.col("uid").alias("component"), F.col("rep").alias("component_id")), "component")
    found = written(found.select("label", "v", "rep", "many", (F.coalesce("n", F.lit(0)) + F.col("many") - 1).alias("n_links"), "component_id"), "vector-groups")
    alone = found.filter("many = 1").select(F.col("rep").alias("vec_id"), "n_links", "component_id")
    copies = same.join(found.filter("many > 1"), ["label", "v"]).select("vec_id", "n_links", "component_id")
    lone = rows.filter(~F.col("sound")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return alone.union(copies).union(lone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op11_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLES = {
    "op11_embedding_dedup": """
with recursive v as (
  select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0),
l as (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and list_cosine_similarity(a.v, b.v) >= 0.93),
walk(a, b) as (select a, b from l union select w.a, l.b from walk w join l on l.a = w.b)
select e.vec_id, (select count(*) from l where l.a = e.vec_id) as n_links, least(e.vec_id, coalesce((select min(b) from walk w where w.a = e.vec_id), e.vec_id)) as component_id,
  e.vec_id <= coalesce((select min(b) from walk w where w.a = e.vec_id), e.vec_id) as kept
from embeddings e"""
}
QUERIES = {"op11_embedding_dedup": op11_embedding_dedup}
