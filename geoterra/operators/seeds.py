"""How many seats split cities want, what anchors change in that, and which units become seats."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import EARTH_KM
from .graph import _checkpointed
from .siting import _kept
from .solvers import distances, fresh, nothing
from .spatial import within_km


def requirements(units: DataFrame, candidates: DataFrame, target: float, wanted: int, threshold: float, load_factor: float) -> DataFrame:
    """(city, load, population, units, candidates, minimum, most_with_minimum, most, seats, status) for every city of at least ``threshold`` people.

    ``units`` has (unit_id, city, population, load), ``population`` being the city's; ``candidates`` (candidate, city). A city wants a seat for each ``load_factor`` times ``target`` of its load,
    at least one, at most as many as it has candidates or as leave each seat ``wanted`` units (at least 1). Null loads count as 0; null cities and populations are no city; a unit counts once.
    """
    least = max(wanted, 1)
    large = units.filter(F.col("population") >= threshold).dropna(subset=["city"])
    city = large.groupBy("city").agg(F.sum(F.coalesce(F.col("load"), F.lit(0.0))).alias("load"), F.max("population").alias("population"), F.count_distinct("unit_id").alias("units"))
    count = candidates.groupBy("city").agg(F.count_distinct("candidate").alias("candidates"))
    city = city.join(count, "city", "left").withColumn("candidates", F.coalesce("candidates", F.lit(0)))
    with_minimum = F.greatest(F.floor(F.col("units") / least), F.lit(1))
    asked = F.greatest(F.ceil(F.col("load") / F.greatest(F.lit(target * load_factor), F.lit(1e-9))), F.lit(1))
    city = city.withColumn("minimum", F.greatest(F.least("units", F.lit(least)), F.lit(1))).withColumn("most_with_minimum", with_minimum).withColumn("most", F.least("units", "candidates"))
    city = city.withColumn("seats", F.least(asked, F.col("candidates"), F.col("most_with_minimum")))
    # The names of the two cases in reports.
    return city.withColumn("status", F.when(F.col("units") < least, "LIMITADO_A_1_POLO_DISTRITO_OFICIAL_UNICO").otherwise("GRANULARIDADE_SUFICIENTE"))


def anchored(requirement: DataFrame, anchors: DataFrame, wanted: int) -> DataFrame:
    """``requirement`` with ``anchors``, the number of seats that a city has beforehand (``anchors``: candidate, city); those count as wanted and may relax the minimum of units for each seat.

    More anchors than a city has distinct candidates or units (``most``) end the job with an error that names some such cities.
    """
    n = anchors.dropna().groupBy("city").agg(F.count_distinct("candidate").alias("anchors"))
    r = _checkpointed(requirement.join(n, "city", "left").withColumn("anchors", F.coalesce("anchors", F.lit(0))))
    over = [f"{x.city} ({x.anchors} > {x.most})" for x in r.filter("anchors > most").orderBy("city").limit(5).collect()]
    if over:
        raise ValueError(f"more anchors than distinct candidates: {', '.join(over)}")
    share = F.least(F.lit(max(wanted, 1)), F.greatest(F.floor(F.col("units") / F.col("anchors")), F.lit(1)))
    some = F.col("anchors") > 0
    relaxed = some & (F.col("anchors") > F.col("most_with_minimum"))
    named = F.when(relaxed, "MINIMO_RELAXADO_POR_ANCORAS_GR").otherwise(F.col("status"))  # a fixed value
    return r.withColumn("minimum", F.when(some, share).otherwise(F.col("minimum"))).withColumn("seats", F.greatest("seats", "anchors")).withColumn("status", named)


def seeds(pairs: DataFrame, requirement: DataFrame, total: int, anchors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Seats of split cities after the anchors, at most ``total`` with them: (place, city, candidate), and the cities that lack some (city, missing).

    ``pairs`` has (city, unit_id, candidate, home, cost, weight, opening): ``city`` is the unit's, ``home`` the candidate's. ``requirement`` has (city, load, population, seats), ``anchors`` (candidate,
    city), which take the first places by candidate. First every city without an anchor gets a seat, the largest load first; then always the city that lacks most, of those the one with the
    largest load for each seat it has. A city without a free candidate is passed over. A seat is the city's own free candidate that leaves its units the least weighted cost to any
    chosen one, anchors and other cities' seats too, plus opening; serving units that nothing serves yet comes first, ties go to the smaller candidate.

    What a city lacks only falls, so the order of all places is a sort. Places whose cities share no pairs, directly or over earlier ones, are filled in the same round; the places (at most
    ``total``) and the neighbouring cities among theirs are all that the driver holds.
    """
    p = _kept(pairs.select("city", "unit_id", "candidate", "home", F.col("cost").cast("double").alias("cost"), F.coalesce(F.col("weight").cast("double"), F.lit(0.0)).alias("weight"), F.coalesce(F.col("opening").cast("double"), F.lit(0.0)).alias("opening")).dropna(subset=["city", "unit_id", "candidate", "cost"]))
    own = p.filter("city = home")
    best = lambda now, more: _kept(now.join(p.join(more.select("candidate"), "candidate").groupBy("city", "unit_id").agg(F.min("cost").alias("offer")), ["city", "unit_id"], "left").select("city", "unit_id", F.least("now", "offer").alias("now")))

    def score(asked: DataFrame, chosen: DataFrame, now: DataFrame) -> DataFrame:
        open_ = own.join(asked, "city").join(chosen.select("candidate"), "candidate", "left_anti").join(now, ["city", "unit_id"])
        new = -F.sum(F.when(F.col("now").isNull(), F.col("weight")).otherwise(0.0))
        less = F.sum(F.col("weight") * (F.least("now", "cost") - F.coalesce("now", F.lit(0.0)))) + F.max("opening")
        return open_.groupBy("place", "city", "candidate").agg(new.alias("new"), less.alias("less"))

    start = p.select("city", "unit_id", F.lit(None).cast("double").alias("now")).distinct()
    return _filled(own.select("city", "candidate").distinct(), p.filter("city <> home").select("city", "home").distinct(), start, best, score, requirement, total, anchors)


def seeds_near(units: DataFrame, group: str, reach_km: float, requirement: DataFrame, total: int, anchors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``seeds`` where every unit (group, unit_id, city, weight, lat, lon) may be a seat, opens at no cost and serves the units of its group within ``reach_km``, at their distance: no table of pairs is formed.

    Unit ids are unique, a city lies in one group; units without coordinates take no part. Units of a city that share a place are one to those who look at it. The cities of a group wait for each other.
    """
    u = _kept(units.select(group, "unit_id", "city", F.coalesce(F.col("weight").cast("double"), F.lit(0.0)).alias("weight"), "lat", "lon").dropna(subset=["unit_id", "city", "lat", "lon"]))
    homes = _kept(u.select(group, "city").distinct())
    near = homes.join(homes.withColumnRenamed("city", "home"), group).filter("city <> home").select("city", "home")
    place = ["city", "lat", "lon"]

    def best(now: DataFrame, more: DataFrame) -> DataFrame:
        at = u.join(more.select(F.col("candidate").alias("unit_id")), "unit_id", "left_semi").select(group, "lat", "lon")
        offer = within_km(now, at, reach_km, [group]).groupBy("a.unit_id").agg(F.min("km").alias("offer"))
        return _kept(now.join(offer, "unit_id", "left").select(*u.columns, F.least("now", "offer").alias("now")))

    def score(asked: DataFrame, chosen: DataFrame, now: DataFrame) -> DataFrame:
        here = now.join(asked.select("city"), "city", "left_semi")
        # All units of a place and city are served alike.
        held = _kept(here.groupBy(*place).agg(F.sum("weight").alias("weight"), F.min("now").alias("now"), F.count("*").alias("n")))
        sums = near_sums(held, "city", reach_km)
        open_ = here.join(chosen.select(F.col("candidate").alias("unit_id")), "unit_id", "left_anti").join(asked, "city")
        return open_.join(sums, place).select("place", "city", F.col("unit_id").alias("candidate"), "new", "less")

    start = u.withColumn("now", F.lit(None).cast("double"))
    return _filled(u.select("city", F.col("unit_id").alias("candidate")), near, start, best, score, requirement, total, anchors)


def near_sums(places: DataFrame, key: str, reach_km: float) -> DataFrame:
    """(key, lat, lon, new, less): for each place (key, lat, lon, weight, now) what a seat there gains from the places of its key within reach: minus the weight of those without a distance ``now``, and the weighted change of the distances.

    Places are dealt to tiles, each of which holds what lies around it; parts are numbered, since little data is much work here.
    """
    high = math.degrees(reach_km / EARTH_KM) / 2
    tile = [key, "_ts", "_tx"]
    strip = F.floor(F.col("lat") / high)
    own = places.withColumn("_ts", strip).withColumn("_tx", F.floor(F.col("lon") / high))
    one = own.groupBy(*tile).agg(F.min(F.struct("lat", "lon")).alias("p")).select(*tile, "p.*")
    # What is within reach of a place of the tile is within reach of its first place and a tile's diagonal.
    around = within_km(one, places, reach_km * 1.75, [key]).select(f"a.{key}", "a._ts", "a._tx", "b.lat", "b.lon", "b.weight", "b.now")
    columns = [key, "lat", "lon", "new", "less"]

    def run(k: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return nothing(columns)
        weight, now = b["weight"].to_numpy(float), b["now"].to_numpy(float)
        none = np.isnan(now)
        was, lost = np.where(none, 0.0, now), np.where(none, weight, 0.0)
        most = np.where(none, np.inf, now)
        new, less = np.empty(len(a)), np.empty(len(a))
        rows = max(1, 1_000_000 // len(b))
        for at in range(0, len(a), rows):
            km = distances(a.iloc[at : at + rows], b)
            hit = km <= reach_km
            new[at : at + rows] = -(hit @ lost)
            less[at : at + rows] = np.where(hit, np.minimum(most, km) - was, 0.0) @ weight
        return a[[key, "lat", "lon"]].assign(new=new, less=less)

    parts = max(int(places.sparkSession.conf.get("spark.sql.shuffle.partitions")), 8) * 2
    met = own.select(*tile, "lat", "lon").repartition(parts, *tile).groupBy(*tile).cogroup(fresh(around).repartition(parts, *tile).groupBy(*tile))
    return met.applyInPandas(run, f"{key} {dict(places.dtypes)[key]}, lat double, lon double, new double, less double")


def _filled(open_: DataFrame, near: DataFrame, now: DataFrame, best: Callable[[DataFrame, DataFrame], DataFrame], score: Callable[[DataFrame, DataFrame, DataFrame], DataFrame], requirement: DataFrame, total: int, anchors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rounds of ``seeds``: its caller says which candidates a city has (city, candidate), which cities may share some (city, home), how units are served and what candidates gain."""
    spark = requirement.sparkSession
    fixed = _kept(anchors.select("candidate", "city").dropna(subset=["candidate"]).dropDuplicates(["candidate"]))
    held = fixed.count()
    if held > total:
        raise ValueError(f"{held} anchors, but only {total} seats")
    has = fixed.groupBy("city").agg(F.count("*").alias("has"))
    free = open_.join(fixed.select("candidate"), "candidate", "left_anti").groupBy("city").agg(F.count("*").alias("free"))
    r = _kept(requirement.select("city", "load", "population", "seats").join(has, "city", "left").join(free, "city", "left").na.fill(0, ["has", "free"]))
    last = F.least(F.col("seats"), F.col("has") + F.col("free")) - 1
    steps = r.filter(F.col("has") <= last).withColumn("step", F.explode(F.sequence(F.col("has"), last)))
    first, then = F.col("step") == 0, F.col("step") > 0
    order = [F.desc(first), F.when(then, F.col("seats") - F.col("step")).desc(), F.when(then, F.col("load") / F.col("step")).desc(), F.desc("load"), F.desc("population"), F.col("city")]
    places = [x.city for x in steps.orderBy(*order).limit(total - held).select("city").collect()]
    some = spark.createDataFrame([(c,) for c in sorted(set(places))], requirement.select("city").schema)
    near = near.join(some, "city", "left_semi").join(some.withColumnRenamed("city", "home"), "home", "left_semi")
    beside: dict = {}
    for x in near.collect():
        beside.setdefault(x.city, set()).add(x.home)
        beside.setdefault(x.home, set()).add(x.city)
    done: dict = {}
    rounds: list[list[tuple]] = []
    for k, city in enumerate(places):
        at = max((done.get(c, -1) for c in {city} | beside.get(city, set())), default=-1) + 1
        done[city] = at
        rounds += [[]] * (at + 1 - len(rounds))
        rounds[at] = [*rounds[at], (held + k + 1, city)]
    now = best(now, fixed)
    numbered = [(i + 1, x.city, x.candidate) for i, x in enumerate(fixed.orderBy("candidate").collect())]
    kinds = f"place int, city {open_.schema['city'].dataType.simpleString()}, candidate {open_.schema['candidate'].dataType.simpleString()}"
    chosen = _kept(spark.createDataFrame(numbered, kinds))
    for due in rounds:
        asked = spark.createDataFrame(due, kinds.rsplit(",", 1)[0])
        gain = score(asked, chosen, now).select("place", "city", F.struct(F.round("new", 6).alias("new"), F.round("less", 6).alias("less"), "candidate").alias("b"))
        taken = _kept(gain.groupBy("place", "city").agg(F.min("b").alias("b")).select("place", "city", "b.candidate"))
        chosen, now = _kept(chosen.union(taken)), best(now, taken)
    lack = r.join(chosen.groupBy("city").agg(F.count("*").alias("n")), "city", "left").withColumn("missing", F.col("seats") - F.coalesce("n", F.lit(0)))
    return chosen, lack.filter("missing > 0").select("city", "missing")
