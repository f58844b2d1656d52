"""The metropolitan minimum, enforced: poles of split cities gain units of their city from poles beside them, in rounds over tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import Levels, cut_points
from .graph import _checkpointed, _inside, components
from .siting import _kept
from .solvers import fresh, nothing
from .windows import Points, km_between


def minima(units: DataFrame, poles: DataFrame, wanted: int) -> DataFrame:
    """(city, pole_id, minimum) for the poles with a city: ``wanted`` (at least 1), at most an equal share of the city's units, at least 1. A city without units asks nothing."""
    n = units.filter("city is not null").groupBy("city").agg(F.count("*").alias("units"))
    p = poles.filter("city is not null").select("city", "pole_id").distinct()
    per = p.groupBy("city").agg(F.count("*").alias("poles")).join(n, "city")
    share = F.greatest(F.floor(F.col("units") / F.col("poles")), F.lit(1))
    return p.join(per.select("city", F.least(F.lit(max(wanted, 1)), share).cast("long").alias("minimum")), "city").select("city", "pole_id", "minimum")


def _missing(asked: DataFrame, now: DataFrame) -> DataFrame:
    """``asked`` with ``units``: how many units of its own city each pole serves."""
    have = now.filter("city is not null").groupBy("city", "pole_id").agg(F.count("*").alias("units"))
    return asked.join(have, ["city", "pole_id"], "left").withColumn("units", F.coalesce("units", F.lit(0)))


def _may_leave(moves: DataFrame, now: DataFrame, edges: DataFrame) -> DataFrame:
    """The moves whose unit leaves its portfolio in one piece (or empty)."""
    givers = now.join(moves.select(F.col("origin").alias("pole_id")).distinct(), "pole_id", "left_semi").select("unit_id", "pole_id")
    givers = _checkpointed(givers)
    inside = _checkpointed(_inside(givers, edges).select("src", "dst"))
    part = components(givers, inside)
    sizes = part.groupBy("component").agg(F.count("*").alias("size"))
    shape = givers.join(part, "unit_id").join(sizes, "component").select("unit_id", F.col("pole_id").alias("origin"), "component", "size")
    pieces = shape.groupBy("origin").agg(F.count_distinct("component").alias("pieces"))
    cuts = cut_points(givers, inside, part).select("unit_id", F.lit(True).alias("cut"))
    held = moves.join(shape.select("unit_id", "size"), "unit_id").join(pieces, "origin").join(cuts, "unit_id", "left")
    return held.filter("(pieces = 1 and cut is null) or (pieces = 2 and size = 1)").select(moves.columns)


def enforced(units: DataFrame, poles: DataFrame, costs: DataFrame, edges: DataFrame, wanted: int, most_load: float, rounds: int = 1_000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Every pole of a city gets its minimum of the city's units, if units beside it can be had: (units after), (moves) and (poles that still lack some).

    ``units`` has (unit_id, city, pole_id, load, weight, fixed): ``city`` is null for a unit that counts for no city, ``pole_id`` for one that nobody serves. ``poles`` has
    (pole_id, city), ``costs`` (unit_id, pole_id, cost) for every pole that may serve a unit, ``edges`` (src, dst) stand in both directions. A unit of the city
    may go to a pole under its minimum if it is not fixed, lies beside one of the pole's units, the pole's load stays within ``most_load``, its own pole
    stays in one piece and, if that is one of the city's, does not fall to its minimum or below it. The first pole under its minimum of each city (by id) takes
    the unit that costs least more (by weight; ties by unit); when it has enough or nothing can be had, the next one follows.

    Cities move in the same round where they touch different poles; of those that touch the same pole the first goes, so the result is what one city after another gives unless
    they share poles. Moves: (round, city, unit_id, origin, destination, delta); lacking poles: (city, pole_id, minimum, units). Null loads, weights and costs of the own pole count as 0, null ``fixed``
    as false; units and poles without an id are left out, repeated ids must agree. A job of more than ``rounds`` rounds ends with an error.
    """
    now = units.dropna(subset=["unit_id"]).select("unit_id", "city", "pole_id", F.coalesce(F.col("load").cast("double"), F.lit(0.0)).alias("load"), F.coalesce(F.col("weight").cast("double"), F.lit(0.0)).alias("weight"), F.coalesce("fixed", F.lit(False)).alias("fixed")).dropDuplicates(["unit_id"])
    now = _kept(now)
    edges = _kept(edges.select("src", "dst").filter("src <> dst").distinct())
    asked = _kept(minima(now, poles.dropna(subset=["pole_id"]), wanted))
    price = _kept(costs.dropna(subset=["cost"]).groupBy("unit_id", "pole_id").agg(F.min("cost").cast("double").alias("cost")))
    stuck = _kept(asked.select("city", "pole_id").limit(0))
    moves = Levels(now)
    for k in range(rounds):
        state = _kept(_missing(asked, now))
        lacking = state.filter("units < minimum").join(stuck, ["city", "pole_id"], "left_anti")
        taking = _kept(lacking.groupBy("city").agg(F.min("pole_id").alias("destination"), F.first("minimum").alias("minimum")))
        if taking.isEmpty():
            break
        loads = now.groupBy(F.col("pole_id").alias("destination")).agg(F.sum("load").alias("carried"))
        theirs = now.filter("city is not null and pole_id is not null and not fixed").join(taking, "city").filter("pole_id <> destination")
        beside = edges.join(theirs.select(F.col("unit_id").alias("src"), "destination"), "src").join(now.select(F.col("unit_id").alias("dst"), "pole_id"), "dst").filter("pole_id = destination")
        offer = theirs.join(beside.select(F.col("src").alias("unit_id")).distinct(), "unit_id", "left_semi").withColumnRenamed("pole_id", "origin").join(loads, "destination").filter(F.col("carried") + F.col("load") <= most_load)
        spare = state.select(F.col("pole_id").alias("origin"), "city", F.col("units").alias("_has"))
        offer = offer.join(spare, ["origin", "city"], "left").filter("_has is null or _has > minimum")
        offer = offer.join(price.select("unit_id", F.col("pole_id").alias("destination"), F.col("cost").alias("then")), ["unit_id", "destination"])
        offer = offer.join(price.select("unit_id", F.col("pole_id").alias("origin"), F.col("cost").alias("before")), ["unit_id", "origin"], "left")
        offer = _kept(offer.select("city", "unit_id", "origin", "destination", ((F.col("then") - F.coalesce("before", F.lit(0.0))) * F.col("weight")).alias("delta")))
        allowed = offer if offer.isEmpty() else _kept(_may_leave(offer, now, edges))
        best = _kept(allowed.groupBy("city").agg(F.min(F.struct("delta", "unit_id", "origin", "destination")).alias("b")).select("city", "b.*"))
        # A pole takes part in one move of a round, so no move changes what another one was checked against.
        touched = best.select("city", F.explode(F.array("origin", "destination")).alias("pole_id"))
        first = touched.groupBy("pole_id").agg(F.min("city").alias("first"))
        late = touched.join(first, "pole_id").filter("city <> first").select("city").distinct()
        go = moves.put(k, best.join(late, "city", "left_anti").select("city", "unit_id", "origin", "destination", "delta"))
        stuck = _kept(stuck.union(taking.join(best, "city", "left_anti").select("city", F.col("destination").alias("pole_id"))))
        now = _kept(now.join(go.select("unit_id", "destination"), "unit_id", "left").withColumn("pole_id", F.coalesce("destination", "pole_id")).select(now.columns))
    else:
        raise ValueError(f"the minimum took more than {rounds} rounds")
    made = moves.all().withColumnRenamed("level", "round") if moves.schema else now.select("city", "unit_id", F.col("pole_id").alias("origin"), F.col("pole_id").alias("destination"), F.lit(0.0).alias("delta"), F.lit(0).alias("round")).limit(0)
    return now, made, _missing(asked, now).filter("units < minimum").select("city", "pole_id", "minimum", "units")


def _in_one_piece(lat: np.ndarray, lon: np.ndarray, reach_km: float) -> bool:
    """Whether places (radians) hang together by steps of at most ``reach_km``; no places do."""
    left = np.arange(len(lat))
    front = left[:1].tolist()
    left = left[1:]
    while front and len(left):
        k = front.pop()
        met = km_between(lat[k], lon[k], lat[left], lon[left]) <= reach_km
        front += left[met].tolist()
        left = left[~met]
    return not len(left)


def enforced_near(units: DataFrame, poles: DataFrame, group: str, reach_km: float, wanted: int, most_load: float) -> DataFrame:
    """The moves (round, city, unit_id, origin, destination, delta) of ``enforced`` where units of a group at most ``reach_km`` apart lie beside each other and costs are distances: neither edges nor costs are formed.

    ``units`` has (group, unit_id, city, pole_id, load, weight, fixed, lat, lon), ``poles`` (group, pole_id, city, lat, lon); a city and a portfolio lie in one group. A group's moves follow from one another, so
    they are worked out in one task, from its units and poles alone. Each round fills a place or passes over a pole, so the rounds end.
    """
    columns = [group, "round", "city", "unit_id", "origin", "destination", "delta"]

    def run(key: tuple, u: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        u = u.drop_duplicates("unit_id").sort_values("unit_id").reset_index(drop=True)
        p = p.drop_duplicates(["city", "pole_id"])
        names = sorted(set(p["pole_id"]) | set(u["pole_id"].dropna()))
        number = {name: k for k, name in enumerate(names)}
        where = p.drop_duplicates("pole_id").set_index("pole_id").reindex(names)
        p_lat, p_lon = (np.radians(where[c].to_numpy(float)) for c in ("lat", "lon"))
        lat, lon = (np.radians(u[c].to_numpy(float)) for c in ("lat", "lon"))
        load, weight, fixed, ids = u["load"].to_numpy(float), u["weight"].to_numpy(float), u["fixed"].to_numpy(bool), u["unit_id"].to_numpy()
        owner = np.array([number.get(x, -1) for x in u["pole_id"]], int)
        members: list[list[int]] = [[] for _ in names]
        for k in np.flatnonzero(owner >= 0).tolist():
            members[owner[k]].append(k)
        free: dict[int, dict[int, bool]] = {}  # by pole: whether its portfolio is in one piece without a unit

        def may_leave(unit: int) -> bool:
            at = int(owner[unit])
            known = free.setdefault(at, {})
            if unit not in known:
                rest = np.array([k for k in members[at] if k != unit], int)
                known[unit] = _in_one_piece(lat[rest], lon[rest], reach_km)
            return known[unit]

        class City:
            def __init__(self, name: str):
                self.name, self.units = name, np.flatnonzero((u["city"] == name).to_numpy())
                self.queue = sorted(number[x] for x in p.loc[p["city"] == name, "pole_id"])
                self.minimum = min(max(wanted, 1), max(len(self.units) // max(len(self.queue), 1), 1))
                self.asked = np.zeros(len(names), bool)
                self.asked[self.queue] = True
                self.has = np.bincount(owner[self.units][owner[self.units] >= 0], minlength=len(names))
                self.near = Points(u["lat"].to_numpy()[self.units], u["lon"].to_numpy()[self.units], 16.0)
                self.least, self.first = load[self.units].min() if len(self.units) else np.inf, 0

            def taking(self) -> int:
                """The first pole under its minimum; those that were passed over or have enough are never asked again."""
                while self.first < len(self.queue) and (not len(self.units) or self.has[self.queue[self.first]] >= self.minimum):
                    self.first += 1
                return self.queue[self.first] if self.first < len(self.queue) else -1

            def best(self, to: int) -> tuple | None:
                carried = load[members[to]].sum() if members[to] else 0.0
                if not members[to] or carried + self.least > most_load:
                    return None
                own = owner[self.units]
                open_ = (own >= 0) & (own != to) & ~fixed[self.units] & (carried + load[self.units] <= most_load) & (~self.asked[own] | (self.has[own] > self.minimum))
                beside = np.zeros(len(open_), bool)
                for k in members[to]:
                    at = self.near.window(lat[k], lon[k], reach_km)
                    at = at[open_[at] & ~beside[at]]
                    beside[at[km_between(lat[k], lon[k], lat[self.units[at]], lon[self.units[at]]) <= reach_km]] = True
                at = self.units[beside]
                then, before = (km_between(lat[at], lon[at], p_lat[j], p_lon[j]) for j in (to, owner[at]))
                delta = (then - np.nan_to_num(before)) * weight[at]
                at, delta = at[~np.isnan(delta)], delta[~np.isnan(delta)]
                for k in np.lexsort((at, delta)).tolist():
                    if may_leave(int(at[k])):
                        return float(delta[k]), int(at[k]), int(owner[at[k]]), to
                return None

        cities = [City(name) for name in sorted(p["city"].dropna().unique())]
        moves, step = [], 0
        while due := [(c, to) for c in cities if (to := c.taking()) >= 0]:
            found = [(c, c.best(to)) for c, to in due]
            first: dict[int, str] = {}
            for c, b in found:
                for j in b[2:] if b else ():
                    first.setdefault(j, c.name)
            for c, b in found:
                if b is None:
                    c.first += 1
                # A pole takes part in one move of a round, so no move changes what another one was checked against.
                elif all(first[j] == c.name for j in b[2:]):
                    delta, unit, origin, to = b
                    members[origin].remove(unit)
                    members[to].append(unit)
                    owner[unit] = to
                    c.has[origin] -= 1
                    c.has[to] += 1
                    free.pop(origin, None)
                    free.pop(to, None)
                    moves.append((key[0], step, c.name, ids[unit], names[origin], names[to], delta))
            step += 1
        return pd.DataFrame(moves, columns=columns) if moves else nothing(columns)

    held = units.dropna(subset=["unit_id", "lat", "lon"]).select(group, "unit_id", "city", "pole_id", F.coalesce(F.col("load").cast("double"), F.lit(0.0)).alias("load"), F.coalesce(F.col("weight").cast("double"), F.lit(0.0)).alias("weight"), F.coalesce("fixed", F.lit(False)).alias("fixed"), "lat", "lon")
    asked = fresh(poles.dropna(subset=["pole_id"]).select(group, "pole_id", "city", "lat", "lon"))
    kinds = f"{group} string, round int, city string, unit_id long, origin string, destination string, delta double"
    # Parts are numbered, since little data is much work here and would be put together.
    parts = max(int(units.sparkSession.conf.get("spark.sql.shuffle.partitions")), 8) * 4
    return held.repartition(parts, group).groupBy(group).cogroup(asked.repartition(parts, group).groupBy(group)).applyInPandas(run, kinds).drop(group)
