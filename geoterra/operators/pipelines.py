"""Whole runs: from a scenario and a configuration to rebalanced scenarios under three profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import haversine
from ..sources.files import region_maps
from . import portfolio, rebalance, summaries
from .contracts import must
from .graph import _checkpointed
from .scenario import Scenario, checked_for_rebalance
from .solvers import matched


def moved_poles(facilities: DataFrame, poles: DataFrame) -> DataFrame:
    """(pole_id, seat, km): poles whose seat lies more than 1e-6 km from their place. ``facilities`` has (pole_id, seat, lat, lon), ``poles`` (pole_id, lat, lon)."""
    j = facilities.select("pole_id", "seat", "lat", "lon").join(poles.select("pole_id", F.col("lat").alias("_lat"), F.col("lon").alias("_lon")), "pole_id")
    return j.withColumn("km", haversine(F.col("_lat"), F.col("_lon"), F.col("lat"), F.col("lon"))).filter("km > 1e-6").select("pole_id", "seat", "km")


def donors_seated(facilities: DataFrame, roles: DataFrame, poles: DataFrame) -> DataFrame:
    """``facilities`` with a donor pole's id in place of each new seat's number: donors and new seats are matched one to one by the least sum of distances, over all regions."""
    fresh = facilities.filter(F.contains("pole_id", F.lit("#"))).select(F.lit("all").alias("g"), "pole_id", F.col("seat_unit").alias("pole_num"), "lat", "lon")
    donors = poles.join(roles.filter("role = 'DOADOR'").select("pole_id"), "pole_id").select(F.lit("all").alias("g"), "pole_id", F.xxhash64("pole_id").alias("pole_num"), "lat", "lon")
    pairs = matched(donors, fresh, "g").select(F.col("current").alias("donor"), F.col("proposed").alias("pole_id"))
    return facilities.join(pairs, "pole_id", "left").withColumn("pole_id", F.coalesce("donor", "pole_id")).drop("donor")


def rebalance_scenario(scenario: Scenario, config: dict) -> dict[str, DataFrame]:
    """The tables of a rebalancing run: poles, units (by profile), unit_movements, pole_movements, consolidation, regions and violations.

    The scenario is checked first and stays as it is. Every region ends with its target of poles, every pole sits on a unit of
    its own portfolio, and no unit, store or inhabitant is lost. The configuration is one of ``sources.files``.
    """
    spark = scenario.poles.sparkSession
    areas, states, targets = region_maps(spark, config)
    poles, units, consolidation = checked_for_rebalance(scenario, areas, states, targets)
    units, poles = _checkpointed(units.withColumn("unit_id", F.xxhash64("unit_key"))), _checkpointed(poles)
    once = units.withColumn("_n", F.count("*").over(_same("unit_id"))).filter(must(F.col("_n") == 1, "two unit keys of one hash")).drop("_n")
    place = poles.select(F.col("pole_id").alias("original_pole"), F.col("lat").alias("_lat"), F.col("lon").alias("_lon"))
    now = units.join(place, "original_pole").withColumn("km", haversine(F.col("_lat"), F.col("_lon"), F.col("lat"), F.col("lon")))
    baseline = now.select("region", F.col("original_pole").alias("pole_id"), "km", "population")
    scaled = once.join(rebalance.scales(units, baseline), "region")
    load = baseline.groupBy("pole_id").agg(F.sum("population").alias("load"))
    roles = portfolio.retained(poles.join(load, "pole_id", "left").withColumn("pole_num", F.col("pole_id")), targets, "region")
    roles = _checkpointed(roles)
    facilities = rebalance.facilities(scaled, poles.join(roles.select("pole_id", "role"), "pole_id"), targets)
    facilities = _checkpointed(donors_seated(_checkpointed(facilities), roles, poles))
    result = _checkpointed(rebalance.rebalanced(scaled, facilities, passes=config["passes"]))
    named = result.join(units.select("unit_id", "unit_key", "state", "population", "stores", "original_pole"), "unit_id")
    changed = named.join(now.select("unit_id", F.col("km").alias("km_before")), "unit_id").filter((F.col("pole_id") != F.col("original_pole")) | (F.abs(F.col("km") - F.col("km_before")) > 1e-6))
    seats = result.select("profile", "region", "pole_id", "seat_unit").distinct().join(units.select(F.col("unit_id").alias("seat_unit"), F.col("unit_key").alias("seat"), F.col("state").alias("seat_state"), "lat", "lon"), "seat_unit")
    p90 = summaries.weighted_percentile(baseline, ["region"], "km", "population", 0.9, "p90_base", keep_zero=True)
    tables, broken = {}, None
    for profile in rebalance.PROFILES:
        table, outside = summaries.regions(named.filter(F.col("profile") == profile.name), targets, p90, config["tolerance"], config["p90_increase"])
        table, outside = table.withColumn("profile", F.lit(profile.name)), outside.withColumn("profile", F.lit(profile.name))
        tables["regions"] = tables["regions"].unionByName(table) if "regions" in tables else table
        broken = outside if broken is None else broken.unionByName(outside)
    return tables | {
        "poles": seats.select("profile", "region", "pole_id", "seat", "seat_state", "lat", "lon"),
        "units": named.select("profile", "region", "unit_key", "state", "population", "stores", "original_pole", "pole_id", "km"),
        "unit_movements": changed.select("profile", "unit_key", F.col("original_pole").alias("origin"), F.col("pole_id").alias("destination"), (F.col("km") - F.col("km_before")).alias("km_delta")),
        "pole_movements": moved_poles(seats, poles).join(seats.select("pole_id", "seat", "profile"), ["pole_id", "seat"]).select("profile", "pole_id", "seat", "km"),
        "consolidation": consolidation, "violations": broken,
    }


def _same(column: str):
    from pyspark.sql import Window

    return Window.partitionBy(column)
