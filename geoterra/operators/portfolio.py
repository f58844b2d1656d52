"""Consolidation, ownership and metrics of portfolios (the units of a pole)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stats import weighted_mean


def consolidate(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row for each key: stores add up, the population is the largest, coordinates are the first by ``order``; the ids, the number of records, and whether coordinates differ."""
    first = lambda c: F.min_by(c, order).alias(c)
    return rows.groupBy(*keys).agg(F.sum("stores").alias("stores"), F.max("population").alias("population"), first("lat"), first("lon"), F.array_sort(F.collect_set("source_id")).alias("source_ids"), F.count("*").alias("records"), (F.count_distinct("lat", "lon") > 1).alias("diverges"))


def metric_columns() -> list[Column]:
    """The twelve portfolio metrics over rows (municipality_code, unit_id, is_district, stores, population, km)."""
    return [
        F.count_distinct("municipality_code").alias("municipalities"), F.count_distinct(F.when(F.col("is_district"), F.col("unit_id"))).alias("districts"), F.count("unit_id").alias("units"),
        F.coalesce(F.sum("stores"), F.lit(0)).cast("long").alias("stores"), F.round(F.coalesce(F.sum("population"), F.lit(0.0)), 2).alias("population"),
        F.round(F.min("km"), 4).alias("km_min"), F.round(F.avg("km"), 4).alias("km_mean"), F.round(F.median("km"), 4).alias("km_median"), F.round(F.percentile("km", 0.9), 4).alias("km_p90"), F.round(F.max("km"), 4).alias("km_max"),
        F.round(weighted_mean(F.col("km"), F.col("stores")), 4).alias("km_by_stores"), F.round(weighted_mean(F.col("km"), F.col("population")), 4).alias("km_by_population"),
    ]


def dominant(counts: DataFrame, unit: str = "unit_id") -> DataFrame:
    """The owner with most stores for each unit, then the nearest, then the smallest id; expects (unit, pole_id, pole_num, n, km)."""
    order = Window.partitionBy(unit).orderBy(F.desc("n"), F.round("km", 9), "pole_num")
    return counts.withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r")


def retention(old: DataFrame, new: DataFrame, unit: str = "unit_key") -> DataFrame:
    """Per pole in both scenarios: units kept, removed and added, overlap and retention."""
    a, b = old.select("pole_id", unit, F.lit(1).alias("o")).distinct(), new.select("pole_id", unit, F.lit(1).alias("n")).distinct()
    both = a.join(b, ["pole_id", unit], "full_outer").groupBy("pole_id").agg(F.count_if((F.col("o") == 1) & (F.col("n") == 1)).alias("kept"), F.count_if(F.col("n").isNull()).alias("removed"), F.count_if(F.col("o").isNull()).alias("added"), F.count("o").alias("_o"), F.count("n").alias("_n"))
    return both.filter("_o > 0 and _n > 0").select("pole_id", "kept", "removed", "added", F.round(F.col("kept") / (F.col("kept") + F.col("removed") + F.col("added")), 6).alias("overlap"), F.round(F.try_divide("kept", "_o"), 6).alias("retention"))


def movements(old: DataFrame, new: DataFrame) -> DataFrame:
    """MANTIDA, MOVIDA, NOVA_COBERTURA and REMOVIDA by coverage; both have (unit_key, pole_id, km, stores)."""
    j = old.select("unit_key", F.col("pole_id").alias("origin"), F.col("km").alias("km_old")).join(new.select("unit_key", F.col("pole_id").alias("destination"), F.col("km").alias("km_new")), "unit_key", "full_outer")
    kind = F.when(F.col("destination").isNull(), "REMOVIDA").when(F.col("origin").isNull(), "NOVA_COBERTURA").when(F.col("origin") == F.col("destination"), "MANTIDA").otherwise("MOVIDA")
    return j.select("unit_key", "origin", "destination", kind.alias("movement"), F.round("km_old", 4).alias("km_old"), F.round("km_new", 4).alias("km_new"), F.round(F.col("km_new") - F.col("km_old"), 4).alias("km_delta"))


def retained(poles: DataFrame, targets: DataFrame, region: str = "area") -> DataFrame:
    """Which poles a region keeps: the ``target`` largest loads stay (RETIDO), the others may move elsewhere (DOADOR).

    ``poles`` has (pole_id, pole_num, region, load), ``targets`` (region, target). Ties go to the smaller pole_num, a
    null load counts as none, and a region without a target keeps nothing.
    """
    order = Window.partitionBy(region).orderBy(F.desc(F.coalesce("load", F.lit(0))), "pole_num")
    ranked = poles.withColumn("rank", F.row_number().over(order)).join(targets, region, "left")
    role = F.when(F.col("rank") <= F.coalesce("target", F.lit(0)), "RETIDO").otherwise("DOADOR")
    return ranked.select("pole_id", region, "rank", role.alias("role"))


def edited(assigned: DataFrame, edits: DataFrame) -> DataFrame:
    """``assigned`` (unit_id, pole_id) after manual edits (unit_id, to), a null ``to`` taking the unit from its pole; units not edited stay as they are."""
    e = edits.select("unit_id", "to", F.lit(True).alias("edited"))
    j = assigned.join(e, "unit_id", "left").withColumn("edited", F.coalesce("edited", F.lit(False)))
    return j.select("unit_id", F.when(F.col("edited"), F.col("to")).otherwise(F.col("pole_id")).alias("pole_id"), "edited")
