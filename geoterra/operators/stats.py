"""Weighted statistics as grouped operators."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import ordered


def weighted_percentile(df: DataFrame, keys: list[str], value: str, weight: str, q: float, out: str, keep_zero: bool = False, few: bool = False) -> DataFrame:
    """The first value whose running weight reaches ``q`` of the group's total.

    Rows without positive weight are dropped; with ``keep_zero`` they stay (weights below zero count as zero) and a
    group without weight takes the element at ceil(q * n). The running sum is over distinct values, pre-aggregated. Groups are windows
    on ``keys``; without keys, or where they have ``few`` values, so that one may hold much of the table, values are dealt by ranges instead (``ordered``).
    """
    w = F.greatest(F.col(weight).cast("double"), F.lit(0.0)) if keep_zero else F.col(weight).cast("double")
    rows = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"), w.alias("_w"))
    rows = rows if keep_zero else rows.filter("_w > 0")
    rows = rows.groupBy(*keys, "_v").agg(F.sum("_w").alias("_w"), F.count("*").alias("_n"))
    if few or not keys:
        total = rows.groupBy(*keys).agg(F.sum("_w").alias("_tw"), F.sum("_n").alias("_tn"))
        rows = _with(ordered(rows, ["_v"], keys, "_i", {"_cw": "_w", "_cn": "_n"}), total, keys)
        return rows.groupBy(*keys).agg(F.coalesce(F.min(F.when(_reached(q), F.col("_v"))), F.max("_v")).alias(out))
    group = Window.partitionBy(*keys)
    run = group.orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.select(*keys, "_v", F.sum("_w").over(run).alias("_cw"), F.sum("_n").over(run).alias("_cn"), F.sum("_w").over(group).alias("_tw"), F.sum("_n").over(group).alias("_tn"))
    return rows.groupBy(*keys).agg(F.coalesce(F.min(F.when(_reached(q), F.col("_v"))), F.max("_v")).alias(out))


def _reached(q: float) -> Column:
    return F.when(F.col("_tw") > 0, F.col("_cw") >= q * F.col("_tw")).otherwise(F.col("_cn") >= F.ceil(q * F.col("_tn")))


def _with(rows: DataFrame, totals: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with their group's row of ``totals``; a null key is a group."""
    renamed = totals.select(*[F.col(k).alias(f"_t_{k}") for k in keys], *[c for c in totals.columns if c not in keys])
    return rows.join(renamed, reduce(and_, [F.col(k).eqNullSafe(F.col(f"_t_{k}")) for k in keys], F.lit(True))).drop(*[f"_t_{k}" for k in keys])


def percentiles(df: DataFrame, keys: list[str], value: str, qs: dict[str, float]) -> DataFrame:
    """Percentiles with linear interpolation between neighbours, (keys, one column for each of ``qs``), values dealt by ranges; nulls are left out, groups without a value too."""
    rows = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v")).groupBy(*keys, "_v").agg(F.count("*").alias("_n"))
    total = rows.groupBy(*keys).agg(F.sum("_n").alias("_tn"))
    rows = _with(ordered(rows, ["_v"], keys, "_i", {"_cn": "_n"}), total, keys)
    # The value at a place (from 0): the first whose running count goes beyond it.
    at = lambda place: F.min(F.when(F.col("_cn") > place, F.col("_v")))
    ends = [x.alias(f"_{w}_{n}") for n, q in qs.items() for w, x in (("lo", at(F.floor(q * (F.col("_tn") - 1)))), ("hi", at(F.ceil(q * (F.col("_tn") - 1)))))]
    found = rows.groupBy(*keys).agg(*ends, F.max("_tn").alias("_tn"))
    share = lambda q: q * (F.col("_tn") - 1) - F.floor(q * (F.col("_tn") - 1))
    return found.select(*keys, *[(F.col(f"_lo_{n}") + share(q) * (F.col(f"_hi_{n}") - F.col(f"_lo_{n}"))).alias(n) for n, q in qs.items()])


def weighted_mean(value: Column, weight: Column) -> Column:
    """Aggregate over rows with positive weight; null without any."""
    on = (weight > 0) & value.isNotNull()
    return F.try_divide(F.sum(F.when(on, value * weight)), F.sum(F.when(on, weight)))


def floored_mean(value: Column, weight: Column, floor: float) -> Column:
    w = F.greatest(weight, F.lit(floor))
    return F.try_divide(F.sum(value * w), F.sum(w))
