"""Packed trees of boxes over points in Z-order, and joins that walk them: no leaf, block or key holds more rows than a bound, however points crowd.

Points are put in the order of a curve that keeps neighbours together; every few of them are a leaf, every ``FAN`` nodes a node above,
with the box of what they hold. Points on the globe are taken as points of the unit sphere, where straight distances order as
those along the ground do, so neither the date line nor the poles are special.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import EARTH_KM
from .graph import _checkpointed

FAN = 16
#: Levels that are walked before the state is checkpointed.
STRIDE = 3


def on_sphere(df: DataFrame) -> DataFrame:
    """``df`` (lat, lon) with ``_c``: the point of the unit sphere, each of three axes brought to 0 to 1."""
    la, lo = F.radians("lat"), F.radians("lon")
    return df.withColumn("_c", F.array(*[(v + 1) / 2 for v in (F.cos(la) * F.cos(lo), F.cos(la) * F.sin(lo), F.sin(la))]))


def in_plane(df: DataFrame, x: str, y: str, box: tuple[float, float, float]) -> DataFrame:
    """``df`` with ``_c``: (x, y) brought to 0 to 1 by the box's (west, south, side); the third axis is 0."""
    west, south, side = box
    return df.withColumn("_c", F.array((F.col(x) - west) / side, (F.col(y) - south) / side, F.lit(0.0)))


def chord(km: float) -> float:
    """Kilometres on the ground as a distance of ``on_sphere`` coordinates, a trifle more."""
    return math.sin(min(km / EARTH_KM / 2, math.pi / 2)) * (1 + 1e-9) + 1e-12


def _z_order(c: str) -> Column:
    """The bits of three axes, 21 each, one after another."""
    out = F.lit(0).cast("long")
    for axis in range(3):
        v = F.least(F.greatest(F.floor(F.col(c)[axis] * 2.0**21), F.lit(0)), F.lit(2**21 - 1)).cast("long")
        for step, mask in ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249)):
            v = v.bitwiseOR(F.shiftleft(v, step)).bitwiseAND(F.lit(mask))
        out = out.bitwiseOR(F.shiftleft(v, axis))
    return out


def _boxes(rows: DataFrame, low: str, high: str, *keys: str | Column) -> DataFrame:
    """(keys, n, low, high) of rows with a count ``n`` and corners."""
    return rows.groupBy(*keys).agg(F.sum("n").alias("n"), F.array(*[F.min(F.col(low)[i]) for i in range(3)]).alias("low"), F.array(*[F.max(F.col(high)[i]) for i in range(3)]).alias("high"))


def runs(points: DataFrame, groups: list[str], bits: int) -> DataFrame:
    """``points`` (with ``_c``) with ``part`` and ``run``: the range of groups and Z-order that they were dealt to, and the number of their run of 2^bits rows there."""
    by = [*groups, "_z"]
    dealt = points.withColumn("_z", _z_order("_c")).repartitionByRange(*by).sortWithinPartitions(*by).drop("_z")
    dealt = _checkpointed(dealt.withColumn("_at", F.monotonically_increasing_id()))
    return dealt.withColumn("part", F.shiftright("_at", 33)).withColumn("run", F.shiftright(F.col("_at").bitwiseAND(F.lit(2**33 - 1)), bits)).drop("_at")


def tree(held: DataFrame, groups: list[str]) -> tuple[DataFrame, int]:
    """(groups, level, node, parent, n, low, high) over ``runs``, level 0 being the runs, and the highest level, which is one node for each group.

    Nodes are structs (part, run): runs are brought together in their range first, then the ranges are.
    """
    leaves = _checkpointed(_boxes(held.withColumn("n", F.lit(1)), "_c", "_c", *groups, "part", "run"))
    last = leaves.agg(F.max("part"), F.max("run")).first()
    count = lambda n: math.ceil(math.log((n or 0) + 1, FAN) - 1e-12)
    inner = count(last[1])
    top = inner + count(last[0])
    up = lambda c, n: F.floor(F.col(c) / F.pow(F.lit(float(FAN)), F.greatest(n, F.lit(0)))).cast("long")
    at = lambda level: F.struct(up("part", level - inner).alias("part"), F.when(level >= inner, 0).otherwise(up("run", level)).cast("long").alias("run"))
    level = F.col("level")
    every = leaves.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(top)))).withColumn("node", at(level)).withColumn("parent", at(level + 1))
    return _boxes(every, "low", "high", *groups, "level", "node", "parent"), top


def _bounds() -> tuple[Column, Column]:
    """The least and greatest distance that points of two boxes, (low, high) and (cl, ch), can have."""
    axis = range(3)
    lo, hi, cl, ch = (F.col(c) for c in ("low", "high", "cl", "ch"))
    norm = lambda parts: F.sqrt(reduce(lambda a, b: a + b, [p * p for p in parts]))
    return norm([F.greatest(cl[i] - hi[i], lo[i] - ch[i], F.lit(0.0)) for i in axis]), norm([F.greatest(ch[i] - lo[i], hi[i] - cl[i]) for i in axis])


def walk(blocks: DataFrame, cells: DataFrame, top: int, groups: list[str], k: int | None = None, reach: float | None = None) -> DataFrame:
    """(groups, block, run): for each block (groups, block, low, high) the leaves that may hold one of its points' ``k`` nearest, or points within ``reach``.

    All blocks go down together, a level each round. A node stays if its least distance is within reach, or not above the distance within which
    nodes that must hold ``k`` points lie.
    """
    c = cells.select(*[F.col(g).alias(f"_{g}") for g in groups], "level", F.col("node").alias("_node"), F.col("parent").alias("_parent"), "n", F.col("low").alias("cl"), F.col("high").alias("ch"))
    same = lambda on: reduce(and_, [F.col(g) == F.col(f"_{g}") for g in groups], on)
    held = [*groups, "block", "low", "high", "node"]
    by = Window.partitionBy(*groups, "block")
    blocks = blocks.select(*groups, "block", "low", "high")

    def kept(met: DataFrame) -> DataFrame:
        least, most = _bounds()
        met = met.withColumn("least", least)
        if reach is not None:
            return met.filter(F.col("least") <= reach)
        met = met.withColumn("most", most)
        met = met.withColumn("sum", F.sum("n").over(by.orderBy("most").rowsBetween(Window.unboundedPreceding, 0)))
        met = met.withColumn("bound", F.min(F.when(F.col("sum") >= k, F.col("most"))).over(by))
        return met.filter(F.col("bound").isNull() | (F.col("least") <= F.col("bound") * (1 + 1e-9) + 1e-12))

    state = None
    for level in range(top, -1, -1):
        here = c.filter(F.col("level") == level)
        met = blocks.join(here, same(F.lit(True)) if groups else F.col("level") == F.lit(level)) if state is None else state.join(here, same(F.col("node") == F.col("_parent")))
        state = kept(met.drop("node") if state is not None else met).withColumn("node", F.col("_node")).select(*held)
        if level and (top - level) % STRIDE == STRIDE - 1:
            state = _checkpointed(state)
    return state.select(*groups, "block", F.col("node").alias("run"))


def candidates(left: DataFrame, right: DataFrame, groups: list[str], k: int | None = None, reach: float | None = None, block: int = 5, leaf: int = 3, most: int = 256) -> DataFrame:
    """Pairs of structs (a, b) of ``left`` and ``right`` rows (both with ``_c``) that may be within ``reach``, rows of equal ``groups`` only; or a row for each of ``left``, b being an array of those that may be among its ``k`` nearest.

    Left rows are taken in runs of 2^block, right rows in runs of 2^leaf. A run of left rows that is wide against what is near it meets many leaves; one
    with more than ``most`` is dealt again to smaller ones, in the end to single rows.
    """
    names = [f"_{g}" for g in groups]
    theirs = runs(right, groups, leaf)
    cells, top = tree(theirs, groups)
    held = theirs.select(*[F.col(g).alias(f"_{g}") for g in groups], F.struct("part", "run").alias("_run"), F.struct(*[c for c in right.columns if c != "_c"]).alias("b"))
    same = lambda on: reduce(and_, [F.col(g) == F.col(f"_{g}") for g in groups], on)
    out = None
    while True:
        own = runs(left, groups, block).withColumn("block", F.struct("part", "run"))
        met = _checkpointed(walk(_boxes(own.withColumn("n", F.lit(1)), "_c", "_c", *groups, "block"), cells, top, groups, k, reach))
        heavy = met.groupBy(*groups, "block").agg(F.count("*").alias("n")).filter(F.col("n") > (most if block else 2**62)).drop("n")
        mine = own.select(*groups, "block", F.struct(*[c for c in left.columns if c != "_c"]).alias("a"))
        if heavy.isEmpty():
            light, heavy = met, None
        else:
            heavy = _checkpointed(heavy)
            light = met.join(heavy, [*groups, "block"], "left_anti")
        near = light.join(held, same(F.col("run") == F.col("_run"))).select(*names, F.col("block").alias("_block"), "b")
        if k is not None:
            near = near.groupBy(*names, "_block").agg(F.collect_list("b").alias("b"))
        pairs = mine.join(near, same(F.col("block") == F.col("_block"))).select("a", "b")
        out = pairs if out is None else out.union(pairs)
        if heavy is None:
            return out
        left, block = own.join(heavy, [*groups, "block"], "left_semi").select(*left.columns), max(0, block - 3)
