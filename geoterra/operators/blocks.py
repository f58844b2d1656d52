"""Blocks (parts that no single unit can cut) and cut units of a graph, as rounds over tables: no task holds a graph.

A breadth-first forest has no edge between a unit and a unit below it but those of the forest itself. So two forest edges lie in one
block if an edge of the graph joins their lower ends, or if one continues the other and something below it is joined to a unit outside of what lies
under the upper one. Places in the forest (first place and size of what lies under a unit) tell the latter by two comparisons.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .graph import _checkpointed, components
from .ranks import ordered


class Levels:
    """A table written level by level in the shared folder: a round reads one level, so all rounds together move each row a fixed number of times."""

    def __init__(self, like: DataFrame):
        self.spark = like.sparkSession
        _checkpointed(self.spark.range(0))  # names the folder, or fails where a cluster names none
        self.path = f"{self.spark.sparkContext.getCheckpointDir()}/levels-{uuid.uuid4().hex[:12]}"
        self.schema = None

    def put(self, level: int, rows: DataFrame) -> DataFrame:
        self.schema = self.schema or rows.schema
        rows.write.parquet(f"{self.path}/level={level}")
        return self.get(level)

    def get(self, level: int) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/level={level}")

    def all(self) -> DataFrame:
        return self.spark.read.schema(StructType([*self.schema, StructField("level", IntegerType())])).parquet(self.path)


def forest(part: DataFrame, edges: DataFrame) -> tuple[Levels, int]:
    """A breadth-first forest (unit_id, parent) by levels, and how many there are: each part's smallest unit is its root, a unit's parent its smallest neighbour one level up.

    ``part`` (unit_id, component) are its parts, ``edges`` (src, dst) stand in both directions. There is one round for each level, so as many as the longest of the shortest paths from a root.
    """
    out = Levels(part)
    at = out.put(0, part.filter("unit_id = component").select("unit_id", F.lit(None).cast(part.schema["unit_id"].dataType).alias("parent")))
    before, depth = at.limit(0), 0
    while not at.isEmpty():
        # A neighbour of a level lies in it, in the one before or in the next.
        met = edges.join(at.select(F.col("unit_id").alias("src")), "src").groupBy(F.col("dst").alias("unit_id")).agg(F.min("src").alias("parent"))
        known = at.select("unit_id").union(before.select("unit_id"))
        depth += 1
        before, at = at, out.put(depth, met.join(known, "unit_id", "left_anti"))
    return out, depth


def _upward(levels: Levels, depth: int, own: DataFrame, of: dict[str, str]) -> DataFrame:
    """(unit_id, parent, columns): each column of ``own`` (unit_id, columns) taken over all that lies under a unit, itself included, by its aggregate in ``of``."""
    how = {"sum": lambda a, b: F.coalesce(b, F.lit(0)) + a, "min": lambda a, b: F.least(a, b), "max": lambda a, b: F.greatest(a, b)}
    out, below = Levels(own), None
    for level in range(depth - 1, -1, -1):
        rows = levels.get(level).join(own, "unit_id")
        if below is not None:
            under = below.groupBy(F.col("parent").alias("unit_id")).agg(*[getattr(F, f)(c).alias(f"_{c}") for c, f in of.items()])
            rows = rows.join(under, "unit_id", "left").select("unit_id", "parent", *[how[f](F.col(c), F.col(f"_{c}")).alias(c) for c, f in of.items()])
        below = out.put(level, rows.select("unit_id", "parent", *of))
    return out.all().drop("level")


def blocks(nodes: DataFrame, edges: DataFrame, part: DataFrame | None = None) -> DataFrame:
    """(unit_id, parent, block): the edges of a breadth-first forest, each as its lower end, and the block that it lies in (named by its smallest lower end).

    ``nodes`` has (unit_id), ``edges`` (src, dst) in both directions; repeated edges and loops change nothing, edges to units that are not in ``nodes`` are left
    out, as are null units. Units alone have no row. ``part`` may hand over what ``components`` of the same graph gives. The forest takes a round for each of its levels, three times over.
    """
    units = _checkpointed(nodes.select("unit_id").dropna().distinct())
    both = edges.select("src", "dst").filter("src <> dst").distinct().join(units.select(F.col("unit_id").alias("src")), "src", "left_semi").join(units.select(F.col("unit_id").alias("dst")), "dst", "left_semi")
    both = _checkpointed(both.select("src", "dst"))
    if units.isEmpty():
        return units.select("unit_id", F.col("unit_id").alias("parent"), F.col("unit_id").alias("block"))
    tree, depth = forest(components(units, both) if part is None else part, both)
    size = _upward(tree, depth, units.withColumn("size", F.lit(1).cast("long")), {"size": "sum"})
    # Siblings follow each other by id: what lies under the earlier ones comes before. Dealt by ranges, since a hub may have any number.
    placed = _checkpointed(ordered(size, ["unit_id"], ["parent"], sums={"upto": "size"}).select("unit_id", "parent", "size", (F.col("upto") - F.col("size") + 1).alias("step")))
    places, above = Levels(units), None
    for level in range(depth):
        rows = tree.get(level).join(placed.drop("parent"), "unit_id")
        if above is None:
            rows = rows.withColumn("place", F.lit(0).cast("long"))
        else:
            rows = rows.join(above.select(F.col("unit_id").alias("parent"), F.col("place").alias("_up")), "parent").withColumn("place", F.col("_up") + F.col("step"))
        above = places.put(level, rows.select("unit_id", "parent", "size", "place"))
    at = places.all().drop("level")
    a, b = at.select(F.col("unit_id").alias("src"), F.col("parent").alias("src_up")), at.select(F.col("unit_id").alias("dst"), F.col("parent").alias("dst_up"), F.col("place").alias("to"))
    cross = _checkpointed(both.join(a, "src").join(b, "dst").filter("not (src <=> dst_up) and not (dst <=> src_up)").select("src", "dst", "to"))
    reach = cross.groupBy(F.col("src").alias("unit_id")).agg(F.min("to").alias("low"), F.max("to").alias("high"))
    own = at.join(reach, "unit_id", "left").select("unit_id", F.least("place", "low").alias("low"), F.greatest("place", "high").alias("high"))
    spans = _upward(tree, depth, _checkpointed(own), {"low": "min", "high": "max"})
    upper = at.filter("parent is not null").select(F.col("unit_id").alias("parent"), F.col("place").alias("first"), (F.col("place") + F.col("size")).alias("end"))
    goes_on = spans.join(upper, "parent").filter("low < first or high >= end").select(F.col("unit_id").alias("src"), F.col("parent").alias("dst"))
    joined = goes_on.union(goes_on.select("dst", "src")).union(cross.select("src", "dst"))
    lower = at.filter("parent is not null").select("unit_id", "parent")
    return components(lower, _checkpointed(joined)).join(lower, "unit_id").select("unit_id", "parent", F.col("component").alias("block"))


def cut_points(nodes: DataFrame, edges: DataFrame, part: DataFrame | None = None) -> DataFrame:
    """(unit_id): units of more than one block, whose removal leaves more parts. Nulls, repeats and loops as in ``blocks``."""
    found = _checkpointed(blocks(nodes, edges, part))
    ends = found.select("unit_id", "block").union(found.select(F.col("parent").alias("unit_id"), "block"))
    return ends.groupBy("unit_id").agg(F.min("block").alias("a"), F.max("block").alias("b")).filter("a <> b").select("unit_id")
