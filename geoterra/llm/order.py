"""Places in an order within groups, without a task that holds a whole group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import written


def placed(rows: DataFrame, group: Sequence[str], order: Sequence[str], name: str, place: str = "idx") -> DataFrame:
    """``rows`` and ``place``: 0, 1, ... within each group (nulls are one group) in ascending order, nulls first.

    Rows are dealt by ranges of group and order and sorted there; how many rows of a group lie in earlier ranges is a sum
    over at most one row per group and range. Equal rows are told apart by where they stood, so that even one row
    repeated without end is dealt over many ranges. The sorted rows are a written table.
    """
    by = [*group, *order, "__row"]
    dealt = rows.withColumn("__row", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by)
    table = written(dealt.drop("__row").withColumn("__at", F.monotonically_increasing_id()), name)
    part = F.shiftright("__at", 33).alias("__part")
    held = table.groupBy(*group, part).agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    before = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    held = held.select(*[F.col(c).alias(f"__g{i}") for i, c in enumerate(group)], F.col("__part").alias("__in"), "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    same = F.shiftright("__at", 33) == F.col("__in")
    for i, c in enumerate(group):
        same &= F.col(c).eqNullSafe(F.col(f"__g{i}"))
    return table.join(held, same).select(*rows.columns, (F.col("__at") - F.col("__first") + F.col("__before")).alias(place))
