"""Graphs over units as edge tables, by fixpoints of joins; every few rounds the state is checkpointed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _checkpointed(df: DataFrame) -> DataFrame:
    """``df`` checkpointed in ``spark.checkpoint.dir``; a folder of our own only in a local session that names none (tests)."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not named:
            import tempfile

            named = tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(named)
    return df.checkpoint()


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(unit_id, component) with the smallest unit of each component; edges (src, dst) stand in both directions.

    Labels take the neighbours' smallest, then jump to their label's label, so paths halve each round.
    """
    label = _checkpointed(nodes.select("unit_id", F.col("unit_id").alias("component")))
    while True:
        heard = edges.join(label.withColumnRenamed("unit_id", "dst"), "dst").groupBy(F.col("src").alias("unit_id")).agg(F.min("component").alias("m"))
        low = label.join(heard, "unit_id", "left").select("unit_id", "component", F.least("component", "m").alias("now"))
        jump = label.select(F.col("unit_id").alias("now"), F.col("component").alias("next"))
        step = _checkpointed(low.join(jump, "now").select("unit_id", F.least("now", "next").alias("now"), F.col("component").alias("was")))
        label = step.select("unit_id", F.col("now").alias("component"))
        if step.filter("now <> was").isEmpty():
            return label


def near_components(places: DataFrame, km: float, keys: list[str]) -> DataFrame:
    """(unit_id, component): the parts in which places (unit_id, lat, lon, keys) of equal ``keys`` hang together by steps of at most ``km``, named by their smallest unit.

    The pairs within reach are never formed as a whole. Cells are so small that all places of one are within reach of each other, so a cell's smallest unit
    stands for it, and units that stand for cells are linked first. Only groups that are still in several parts look at their places, and only for pairs of two parts, of which one is kept.
    Places without coordinates are parts of their own.
    """
    import math

    from ..functions.geo import EARTH_KM
    from .spatial import within_km

    # Half the reach to the north and half to the east, with a trifle for rounding.
    high = math.degrees(km / EARTH_KM) * 0.4999
    strip = F.floor(F.col("lat") / high)
    widest = F.cos(F.radians(F.least(F.when(strip >= 0, strip).otherwise(-strip - 1) * high, F.lit(89.0))))
    known = F.col("lat").isNotNull() & F.col("lon").isNotNull() & ~F.isnan("lat") & ~F.isnan("lon")
    at = places.select("unit_id", "lat", "lon", *keys)
    cell = [*keys, "_s", "_x"]
    in_cells = at.filter(known).withColumn("_s", strip).withColumn("_x", F.floor(F.col("lon") * widest / high))
    first = in_cells.groupBy(*cell).agg(F.min(F.struct("unit_id", "lat", "lon")).alias("f")).select(*cell, "f.*")
    first = _checkpointed(first)
    met = within_km(first, first, km, keys).filter("a.unit_id <> b.unit_id").select(F.col("a.unit_id").alias("src"), F.col("b.unit_id").alias("dst"))
    of_cell = components(first, _checkpointed(met)).join(first.select(*cell, "unit_id"), "unit_id").select(*cell, "component")
    part = _checkpointed(in_cells.join(of_cell, cell).select("unit_id", "lat", "lon", *keys, "component"))
    several = part.groupBy(*keys).agg((F.min("component") != F.max("component")).alias("_m")).filter("_m").select(*keys)
    rest = _checkpointed(part.join(several, keys, "left_semi"))
    if not rest.isEmpty():
        met = within_km(rest, rest, km, keys).filter("a.component <> b.component").select(F.col("a.component").alias("src"), F.col("b.component").alias("dst")).distinct()
        whole = components(rest.select(F.col("component").alias("unit_id")).distinct(), _checkpointed(met))
        part = part.join(whole.select(F.col("unit_id").alias("component"), F.col("component").alias("_whole")), "component", "left").withColumn("component", F.coalesce("_whole", "component"))
    return part.select("unit_id", "component").union(at.filter(~known).select("unit_id", F.col("unit_id").alias("component")))


def voronoi(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """Shortest paths from several roots: (unit_id, root, parent, km), the smallest (km, root, parent) for each reached unit.

    ``edges`` (src, dst, km) must have positive lengths: coincident points would make the order of settling matter. Each round relaxes the edges of
    the units that the round before changed, so the rows offered follow the frontier.
    """
    state = _checkpointed(roots.select("unit_id", F.col("unit_id").alias("root"), F.lit(None).cast("long").alias("parent"), F.lit(0.0).alias("km"), F.lit(True).alias("new")))
    fixed = roots.select("unit_id", F.lit(True).alias("is_root"))
    while True:
        # Only units that changed in the last round offer: what the others offer is known.
        frontier = state.filter("new").select(F.col("unit_id").alias("src"), "root", F.col("km").alias("base"))
        offered = edges.join(frontier, "src").select(F.col("dst").alias("unit_id"), "root", F.col("src").alias("parent"), (F.col("base") + F.col("km")).alias("km"))
        offered = offered.join(fixed, "unit_id", "left_anti")
        way = lambda: F.struct("km", "root", F.coalesce("parent", F.lit(-1)).alias("parent"))
        held = state.select("unit_id", way().alias("w"), F.struct("km", "root").alias("was")).unionByName(offered.select("unit_id", way().alias("w"), F.lit(None).cast("struct<km:double,root:bigint>").alias("was")))
        best = held.groupBy("unit_id").agg(F.min("w").alias("b"), F.first("was", ignorenulls=True).alias("was"))
        new = ~F.coalesce(F.struct("b.km", "b.root").eqNullSafe(F.col("was")), F.lit(False))
        state = _checkpointed(best.select("unit_id", "b.root", F.nullif("b.parent", F.lit(-1)).alias("parent"), "b.km", new.alias("new")))
        if state.filter("new").isEmpty():
            return state.drop("new")


def voronoi_near(roots: DataFrame, places: DataFrame, reach_km: float, keys: list[str]) -> DataFrame:
    """``voronoi`` where places (unit_id, lat, lon, keys) of equal ``keys`` at most ``reach_km`` apart have an edge, its length rounded to 4 digits: most edges are never formed.

    No path to a unit is longer than the edge from its nearest root, if that is in reach, so no edge longer than that one ends a shortest path there. Units are taken in classes of
    that distance, each of which looks half as far as the one before.
    """
    from .spatial import nearest, within_km

    at = _checkpointed(places.select("unit_id", "lat", "lon", *keys))
    first = at.join(roots.select("unit_id"), "unit_id", "left_semi").withColumnRenamed("unit_id", "pole_id")
    # A trifle more, for what rounding may change.
    bound = nearest(at, first, keys, "pole_id").select("unit_id", F.least(F.round("km", 4) + 1e-3, F.lit(float(reach_km))).alias("_most"))
    to = _checkpointed(at.join(bound, "unit_id", "left").withColumn("_most", F.coalesce("_most", F.lit(float(reach_km)))))
    out, km = None, float(reach_km)
    for k in range(8):
        here = to.filter((F.col("_most") <= km) & (F.col("_most") > (km / 2 if k < 7 else -1.0)))
        met = within_km(at, here, km, keys).filter("a.unit_id <> b.unit_id and km <= b._most").select(F.col("a.unit_id").alias("src"), F.col("b.unit_id").alias("dst"), F.round("km", 4).alias("km"))
        out, km = met if out is None else out.union(met), km / 2
    return voronoi(roots, _checkpointed(out))


def fragmentation(assigned: DataFrame, edges: DataFrame) -> DataFrame:
    """Per pole: units and the number of connected parts of its portfolio."""
    inside = edges.join(assigned.select(F.col("unit_id").alias("src"), "pole_id"), "src").join(assigned.select(F.col("unit_id").alias("dst"), F.col("pole_id").alias("q")), "dst").filter("pole_id = q").select("src", "dst")
    return components(assigned, _checkpointed(inside)).join(assigned, "unit_id").groupBy("pole_id").agg(F.count("*").alias("units"), F.count_distinct("component").alias("parts"))


def severed(assigned: DataFrame, edges: DataFrame) -> DataFrame:
    """(pole_id, component, units): the parts of each portfolio that are cut off from its largest part (ties: the smallest component)."""
    from pyspark.sql import Window

    inside = _checkpointed(_inside(assigned, edges))
    parts = components(assigned, inside).join(assigned, "unit_id").groupBy("pole_id", "component").agg(F.count("*").alias("units"))
    order = Window.partitionBy("pole_id").orderBy(F.desc("units"), "component")
    return parts.withColumn("i", F.row_number().over(order)).filter("i > 1").select("pole_id", "component", "units")


def _inside(assigned: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges between units of one portfolio."""
    a, b = assigned.select(F.col("unit_id").alias("src"), "pole_id"), assigned.select(F.col("unit_id").alias("dst"), F.col("pole_id").alias("q"))
    return edges.select("src", "dst").join(a, "src").join(b, "dst").filter("pole_id = q").select("src", "dst", "pole_id")


def cut_units(assigned: DataFrame, edges: DataFrame) -> DataFrame:
    """(pole_id, unit_id): units whose removal leaves more parts of their portfolio. A unit lies in one portfolio at most; those in none (null) have no row."""
    from .blocks import cut_points

    served = assigned.select("unit_id", "pole_id").dropna()
    return cut_points(served, _inside(served, edges)).join(served, "unit_id").select("pole_id", "unit_id")


def reached(places: DataFrame, centres: DataFrame, radius_km: float) -> DataFrame:
    """(pole_id, unit_id): places within ``radius_km`` of a centre that hang together with the nearest one by links.

    A link is at most 2.5 times the 75th percentile of nearest-neighbour distances inside the circle, at least 20 km, and at most
    the larger of 35 km and 0.45 of the radius. ``places`` has (unit_id, lat, lon), ``centres`` (pole_id, lat, lon). Neighbouring centres, at most 256, share a task with
    the places around them; circles look up what is near and hold no table of pairs. Places and centres that share a spot are worked out once.
    """
    import math

    import numpy as np
    import pandas as pd
    from pyspark.sql import Window

    from ..functions.geo import EARTH_KM
    from .spatial import within_km
    from .windows import Points

    # Half the radius to the north and to the east, so that centres of a tile are at most 0.71 of it apart.
    high = math.degrees(radius_km / EARTH_KM) * 0.4999
    strip = F.floor(F.col("lat") / high)
    widest = F.cos(F.radians(F.least(F.when(strip >= 0, strip).otherwise(-strip - 1) * high, F.lit(89.0))))
    tile = ["_s", "_x", "_c"]
    number = F.row_number().over(Window.partitionBy("_s", "_x").orderBy("lat", "lon", "pole_id"))
    c = centres.select("pole_id", "lat", "lon").filter("lat is not null and lon is not null and not isnan(lat) and not isnan(lon)").withColumn("_s", strip).withColumn("_x", F.floor(F.col("lon") * widest / high)).withColumn("_c", F.floor((number - 1) / 256))
    c = _checkpointed(c)
    one = c.groupBy(*tile).agg(F.min(F.struct("lat", "lon")).alias("p")).select(F.struct(*tile).alias("tile"), "p.*", F.lit(1).alias("_all"))
    around = within_km(one, places.select("unit_id", "lat", "lon", F.lit(1).alias("_all")), radius_km * 1.72, ["_all"]).select("a.tile.*", "b.unit_id", "b.lat", "b.lon")

    def nearest_few(spots: Points, few: int = 8) -> tuple[np.ndarray, np.ndarray]:
        """(places, km) of each spot's nearest others in order; -1 where there are fewer."""
        at, away = np.full((spots.n, few), -1), np.full((spots.n, few), np.inf)
        first = spots.reach(2.0 * few)
        for i in range(spots.n):
            km = first
            while True:
                near = spots.window(spots.lat[i], spots.lon[i], km)
                d = spots.km_from(spots.lat[i], spots.lon[i], near)
                inside = (d <= km) & (near != i)
                if inside.sum() >= few or len(near) == spots.n:
                    break
                km *= 2
            inside = near != i if len(near) == spots.n else inside
            order = np.argsort(d[inside], kind="stable")[:few]
            at[i, : len(order)], away[i, : len(order)] = near[inside][order], d[inside][order]
        return at, away

    def linked(spots: Points, km: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The spots within ``km`` of each as (start, places, km) of one long list."""
        lists, kms = [], []
        for i in range(spots.n):
            near = spots.window(spots.lat[i], spots.lon[i], km)
            d = spots.km_from(spots.lat[i], spots.lon[i], near)
            lists.append(near[d <= km])
            kms.append(d[d <= km])
        return np.concatenate([[0], np.cumsum([len(v) for v in lists])]), np.concatenate(lists), np.concatenate(kms)

    def run(key: tuple, c: pd.DataFrame, u: pd.DataFrame) -> pd.DataFrame:
        if c.empty or u.empty:
            return pd.DataFrame({"pole_id": pd.Series([], dtype=object), "units": pd.Series([], dtype=object)})
        u = u.sort_values(["lat", "lon", "unit_id"]).reset_index(drop=True)
        new = (u["lat"].diff() != 0) | (u["lon"].diff() != 0)
        begin = np.append(np.flatnonzero(new), len(u))
        ids, size = u["unit_id"].to_numpy(), np.diff(begin)
        spots = Points(u["lat"].to_numpy()[begin[:-1]], u["lon"].to_numpy()[begin[:-1]])
        near, away = nearest_few(spots)
        circles = []
        inside = np.zeros(spots.n + 1, bool)  # the last is no spot's
        for (lat, lon), poles in c.groupby(["lat", "lon"], sort=False)["pole_id"]:
            la, lo = math.radians(lat), math.radians(lon)
            at = spots.window(la, lo, radius_km)
            km = spots.km_from(la, lo, at)
            at, km = at[km <= radius_km], km[km <= radius_km]
            if not len(at):
                continue
            inside[at] = True
            # The first of a spot's nearest that lies in the circle; a spot that several share is 0 away.
            hit = inside[near[at]]
            nearest = np.where(hit.any(1), away[at, hit.argmax(1)], np.inf)
            for k in np.flatnonzero(~hit.any(1) & (size[at] == 1)) if len(at) > 1 else ():
                d = spots.km_from(spots.lat[at[k]], spots.lon[at[k]], at)
                d[k] = np.inf
                nearest[k] = d.min()
            nearest = np.where(size[at] > 1, 0.0, nearest)
            inside[at] = False
            order = np.argsort(nearest, kind="stable")
            n = int(size[at].sum())
            quarter = 25.0 if n == 1 else nearest[order][np.searchsorted(np.cumsum(size[at][order]), min(n - 1, int(n * 0.75)), side="right")]
            start = min(at[km == km.min()].tolist(), key=lambda k: ids[begin[k]])
            circles.append((min(max(20.0, 2.5 * quarter), max(35.0, 0.45 * radius_km)), start, at, list(poles)))
        circles.sort(key=lambda x: x[0])
        rows, lists, upto = [], None, 0.0
        for link, start, at, poles in circles:
            if link > upto:
                # Circles of much the same link share the list.
                upto = max(x[0] for x in circles if x[0] <= link * 1.25)
                lists = linked(spots, upto)
            first, to, km = lists
            inside[at] = True
            inside[start] = False
            found = [np.array([start])]
            while len(found[-1]):
                f = found[-1]
                count = first[f + 1] - first[f]
                k = np.repeat(first[f] - np.cumsum(count) + count, count) + np.arange(count.sum())
                next_ = to[k[km[k] <= link]]
                next_ = np.unique(next_[inside[next_]])
                inside[next_] = False
                found.append(next_)
            inside[at] = False
            seen = np.concatenate(found)
            count = size[seen]
            units = ids[np.repeat(begin[seen] - np.cumsum(count) + count, count) + np.arange(count.sum())]
            rows += [(p, units) for p in poles]
        return pd.DataFrame(rows, columns=["pole_id", "units"])

    # Parts are numbered, so that little data with much work is not put together.
    parts = max(int(places.sparkSession.conf.get("spark.sql.shuffle.partitions")), 8) * 8
    from .solvers import fresh

    met = c.repartition(parts, *tile).groupBy(*tile).cogroup(fresh(around).repartition(parts, *tile).groupBy(*tile))
    return met.applyInPandas(run, "pole_id string, units array<long>").select("pole_id", F.explode("units").alias("unit_id"))
