"""Places and running sums in an order, dealt by ranges: no task holds a whole table or group."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import _checkpointed


def ordered(rows: DataFrame, order: Sequence[str | Column], keys: Sequence[str] = (), place: str = "idx", sums: dict[str, str] | None = None) -> DataFrame:
    """``rows`` with ``place`` (0, 1, ... in ``order`` within equal ``keys``) and, for each of ``sums`` (new column: column), its sum up to and with the row.

    Rows are dealt to ranges of keys and order, sorted there and kept; what lies in earlier ranges is a sum over at most one row for each
    key and range. ``order`` should tell rows apart: equal ones lie in one range, in any order. Null keys are one group.
    """
    sums = sums or {}
    by = [*[F.col(k) for k in keys], *[F.col(c) if isinstance(c, str) else c for c in order]]
    dealt = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__at", F.monotonically_increasing_id())
    dealt = _checkpointed(dealt).withColumn("__part", F.shiftright("__at", 33))
    totals = dealt.groupBy("__part", *keys).agg(F.min("__at").alias("__first"), F.count("*").alias("__n"), *[F.sum(c).alias(f"__s_{n}") for n, c in sums.items()])
    before = Window.partitionBy(*keys, F.lit(0)).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    earlier = lambda c: F.sum(c).over(before)
    held = totals.select(F.col("__part").alias("__p"), *[F.col(k).alias(f"__k_{k}") for k in keys], "__first", F.coalesce(earlier("__n"), F.lit(0)).alias("__n"), *[earlier(f"__s_{n}").alias(f"__s_{n}") for n in sums])
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys], F.col("__part") == F.col("__p"))
    local = Window.partitionBy("__part", *keys).orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)
    if sums:
        dealt = dealt.select("*", *[F.sum(c).over(local).alias(f"__l_{n}") for n, c in sums.items()])
    total = lambda n: F.coalesce(F.col(f"__l_{n}") + F.coalesce(F.col(f"__s_{n}"), F.lit(0)), F.col(f"__s_{n}")).alias(n)
    return dealt.join(held, same).select(*rows.columns, (F.col("__at") - F.col("__first") + F.col("__n")).alias(place), *[total(n) for n in sums])


def in_locale(rows: DataFrame, name: str, ties: list[str]) -> DataFrame:
    """``rows`` with ``place`` (0, 1, ...) by ``name`` in the order of Unicode's collation, which Portuguese shares: accents, then case, matter only where letters are the same. Nulls first."""
    return ordered(rows.withColumn("_name", F.collate(F.col(name), "UNICODE")), ["_name", *ties], place="place").drop("_name")
