"""Distance joins. The pole side is small in this domain, but nothing here relies on it: groups and grid cells block the pairs."""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import EARTH_KM, between_tables, haversine, in_ring
from ..functions.shapes import canonical, following
from . import boxtree


def _known(df: DataFrame) -> DataFrame:
    return df.filter("lat is not null and lon is not null and not isnan(lat) and not isnan(lon)")


def nearest_k(units: DataFrame, poles: DataFrame, k: int, within: list[str] | None = None, order: str = "pole_num") -> DataFrame:
    """(unit_id, pole_id, km, rank): the ``k`` nearest poles of each unit (ties by ``order``), in the same group if ``within`` names one.

    Runs of neighbouring units walk down a tree of boxes over the poles (``boxtree``). Units without coordinates, or without a pole of their group, are left
    out; a unit with fewer poles in reach has them all; where poles of a group share a place only the first ``k`` of it are looked at.
    """
    keys = within or []
    p = _known(poles).select("pole_id", F.col(order).alias("_o"), "lat", "lon", *keys)
    p = p.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "lat", "lon").orderBy("_o", "pole_id"))).filter(F.col("_r") <= k).drop("_r")
    u = _known(units).select("unit_id", "lat", "lon", *keys)
    pairs = boxtree.candidates(boxtree.on_sphere(u), boxtree.on_sphere(p), keys, k=k)
    a = F.col("a")
    scored = F.transform("b", lambda b: F.struct(haversine(a["lat"], a["lon"], b["lat"], b["lon"]).alias("km"), b["_o"].alias("o"), b["pole_id"].alias("pole_id")))
    best = F.array(F.array_min(scored)) if k == 1 else F.slice(F.array_sort(scored), 1, k)
    return pairs.select("a.unit_id", F.posexplode(best).alias("rank", "s")).select("unit_id", "s.pole_id", "s.km", (F.col("rank") + 1).alias("rank"))


def nearest(units: DataFrame, poles: DataFrame, within: list[str] | None = None, order: str = "pole_num") -> DataFrame:
    """(unit_id, pole_id, km): each unit's nearest pole, see ``nearest_k``."""
    return nearest_k(units, poles, 1, within, order).select("unit_id", "pole_id", "km")


def nearest_other(units: DataFrame, km: float, within: list[str] | None = None) -> DataFrame:
    """(unit_id, km): how far each unit's nearest other unit is, in the same group if ``within`` names one; units that have none within ``km`` are left out.

    Units that share a place are known at once. The other places first look as far as places lie apart on average, and those that find none twice as far, up to ``km``: so few pairs are formed at a time.
    """
    keys = within or []
    by = [*keys, "lat", "lon"]
    held = boxtree._checkpointed(_known(units).select("unit_id", *by).dropna(subset=keys) if keys else _known(units).select("unit_id", *by))
    spots = boxtree._checkpointed(held.groupBy(*by).agg(F.count("*").alias("n"), F.min("unit_id").alias("spot")))
    size = spots.agg(F.count("*").alias("n"), F.count_distinct(*[F.col(k) for k in keys] or [F.lit(0)]).alias("groups"), F.min("lat").alias("s"), F.max("lat").alias("n2"), F.min("lon").alias("w"), F.max("lon").alias("e")).first()
    places = spots.select("spot", *by)
    alone, found = spots.filter("n = 1").select("spot", *by), spots.filter("n > 1").select("spot", F.lit(0.0).alias("km"))
    degree = math.radians(1) * EARTH_KM
    reach = min(km, max(math.sqrt((size.n2 - size.s) * (size.e - size.w) * degree**2 * size.groups / size.n), km / 1024)) if size.n else km
    while True:
        met = within_km(alone, places, reach, keys).filter(F.col("a.spot") != F.col("b.spot"))
        near = boxtree._checkpointed(met.groupBy(F.col("a.spot").alias("spot")).agg(F.min("km").alias("km")))
        found = found.unionByName(near)
        alone = boxtree._checkpointed(alone.join(near.select("spot"), "spot", "left_anti"))
        if reach >= km or alone.isEmpty():
            return held.join(spots.select("spot", *by), by).join(found, "spot").select("unit_id", "km")
        reach = min(2 * reach, km)


def within_km(left: DataFrame, right: DataFrame, km: float, keys: list[str]) -> DataFrame:
    """Pairs (aliases a and b) of equal ``keys`` at most ``km`` apart, found by latitude strips of that height, cut into cells that are at least as wide."""
    strip = math.degrees(km / EARTH_KM)
    # A cell's width in degrees follows from the latitude farthest from the equator that a strip's neighbours reach.
    reach = F.least((F.greatest(F.abs(F.col("_s")), F.abs(F.col("_s") + 1)) + 1) * strip, F.lit(89.0))
    ratio = math.sin(km / EARTH_KM / 2) * (1 + 1e-9) / F.cos(F.radians(reach))
    wide = F.when((ratio >= 1) | (reach >= 89.0), F.lit(360.0)).otherwise(F.degrees(2 * F.asin(F.least(ratio, F.lit(1.0)))))
    a = left.withColumn("_s", F.floor(F.col("lat") / strip)).withColumn("_l", F.floor(F.col("lon") / wide))
    b = right.withColumn("_s", F.explode(F.array(*[F.floor(F.col("lat") / strip) + d for d in (-1, 0, 1)])))
    # What lies near the date line stands on its other side too.
    turned = F.when(F.abs("lon") > 180 - 2 * wide, F.array(F.col("lon"), F.col("lon") - 360 * F.signum("lon"))).otherwise(F.array("lon"))
    cells = F.array_distinct(F.flatten(F.transform(turned, lambda x: F.array(*[F.floor(x / wide) + d for d in (-1, 0, 1)]))))
    b = b.withColumn("_l", F.explode(cells))
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in [*keys, "_s", "_l"]]
    return a.alias("a").join(b.alias("b"), on).withColumn("km", between_tables("a", "b")).filter(F.col("km") <= km)


def all_pairs(units: DataFrame, poles: DataFrame, keys: list[str], pole: str = "pole_id", block: int = 512, shares: int = 64) -> DataFrame:
    """(u, p): structs of all pairs of rows of equal ``keys``. Poles are packed in blocks of about ``block`` rows or fewer, and every share of the units meets every block.

    Few keys may hold all rows: the shares spread them over the tasks, and a task holds the blocks of a key, not its pairs.
    """
    count = max(1, -(-poles.count() // block))
    share = F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))
    packed = poles.groupBy(*keys, F.pmod(F.xxhash64(pole), F.lit(count)).alias("_b")).agg(F.collect_list(F.struct(*poles.columns)).alias("_ps")).select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_ps", share.alias("_to"))
    dealt = units.select(F.struct(*units.columns).alias("u"), *[F.col(k).alias(f"_q_{k}") for k in keys]).withColumn("_of", F.pmod(F.xxhash64("u"), F.lit(shares)).cast("int"))
    # What is shuffled is little, what comes of it is much: the parts are numbered, so that they are not put together.
    left, right = dealt.repartition(shares, *[f"_q_{k}" for k in keys], "_of"), packed.repartition(shares, *[f"_k_{k}" for k in keys], "_to")
    same = reduce(and_, [F.col(f"_q_{k}") == F.col(f"_k_{k}") for k in keys], F.lit(True)) & (F.col("_of") == F.col("_to"))
    return left.hint("merge").join(right, same).select("u", F.explode("_ps").alias("p"))


def shortlist(pairs: DataFrame, k: int, unit: str = "unit_id", own: str = "is_own") -> DataFrame:
    """The k best candidates of each unit; its own site always stays."""
    order = Window.partitionBy(unit).orderBy(F.desc(own), "km", "pole_num")
    return pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def dissolved(polygons: DataFrame, key: str) -> DataFrame:
    """The outline of the union of each key's polygons, as boundary edges (key, x1, y1, x2, y2).

    ``polygons`` has (key, ring), a ring being an array of (lon, lat) structs that need not repeat its first point.
    Equal rings count once, however they are turned, directed or closed; polygons must meet in whole edges, as those of one mesh do. An edge that an even number of
    polygons share lies inside and goes. Null and empty rings have no edges, and a repeated point makes none.
    """
    once = polygons.filter("size(ring) > 0").select(key, canonical(F.col("ring")).alias("ring")).distinct()
    corner = lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat"))
    edge = F.transform("ring", lambda p, i: F.struct(corner(p).alias("p"), corner(F.element_at("ring", ((i + 1) % F.size("ring") + 1).cast("int"))).alias("q")))
    edges = once.select(key, F.explode(edge).alias("e")).filter("e.p <> e.q")
    sides = edges.select(key, F.least("e.p", "e.q").alias("a"), F.greatest("e.p", "e.q").alias("b"))
    odd = sides.groupBy(key, "a", "b").agg(F.count("*").alias("n")).filter("n % 2 = 1")
    return odd.select(key, F.col("a.lon").alias("x1"), F.col("a.lat").alias("y1"), F.col("b.lon").alias("x2"), F.col("b.lat").alias("y2"))


def _boxed(polygons: DataFrame, cell: float) -> DataFrame:
    """Polygons with their boxes and one row for each grid cell a box touches."""
    side = lambda f, low: (F.array_min if low else F.array_max)(F.transform("ring", lambda p: p[f]))
    boxed = polygons.withColumn("_w", side("lon", True)).withColumn("_e", side("lon", False)).withColumn("_s", side("lat", True)).withColumn("_n", side("lat", False)).filter("_w is not null")
    at = lambda c: F.floor(F.col(c) / cell)
    return boxed.withColumn("_x", F.explode(F.sequence(at("_w"), at("_e")))).withColumn("_y", F.explode(F.sequence(at("_s"), at("_n"))))


def inside(points: DataFrame, polygons: DataFrame, key: str, within: list[str] | None = None) -> DataFrame:
    """(unit_id, key) of all pairs of a point (unit_id, lat, lon) and a polygon (key, ring) that holds it, of equal ``within`` columns.

    Points lie in the leaves of a tree of boxes; polygons' boxes walk down it. A leaf has a bounded number of points however dense they are, and a
    polygon, however large, goes to the leaves that it touches, once each. Points without coordinates and polygons without a ring meet nothing.
    """
    keys = within or []
    p = _known(points).select("unit_id", "lat", "lon", *keys)
    side = lambda f, low: (F.array_min if low else F.array_max)(F.transform("ring", lambda q: q[f]))
    boxed = polygons.select(F.col(key).alias("_key"), *keys, "ring", F.array(side("lon", True), side("lat", True)).alias("low"), F.array(side("lon", False), side("lat", False)).alias("high")).filter("low[0] is not null")
    size = p.agg(F.min("lon"), F.min("lat"), F.max("lon"), F.max("lat")).first()
    if size[0] is None:
        return p.select("unit_id").join(polygons.select(key), F.lit(False))
    box = (size[0], size[1], max(size[2] - size[0], size[3] - size[1], 1e-9) * (1 + 1e-9))
    fit = lambda c: F.array((F.col(c)[0] - box[0]) / box[2], (F.col(c)[1] - box[1]) / box[2], F.lit(0.0))
    held = boxtree.runs(boxtree.in_plane(p, "lon", "lat", box), keys, 8).withColumn("leaf", F.struct("part", "run"))
    cells, top = boxtree.tree(held, keys)
    # Boxes are told apart by themselves, so equal ones walk once; a trifle keeps points on the edge.
    walkers = boxed.select(*keys, F.struct("low", "high").alias("block"), fit("low").alias("low"), fit("high").alias("high")).distinct()
    met = boxtree.walk(walkers, cells, top, keys, reach=1e-9)
    # Points of a leaf that share a place, and equal rings of a run of 256 polygons, are tested once.
    by = [*keys, "low", "high", "_key"]
    dealt = boxtree._checkpointed(boxed.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.shiftright(F.monotonically_increasing_id(), 8)))
    same = dealt.groupBy(*keys, "low", "high", "ring", "_at").agg(F.collect_list("_key").alias("_keys")).withColumn("block", F.struct("low", "high"))
    rings = met.join(same, [*keys, "block"]).select(*keys, F.col("run").alias("leaf"), "_keys", "ring")
    spots = held.groupBy(*keys, "leaf", "lon", "lat").agg(F.collect_list("unit_id").alias("_units"))
    # Parts are numbered: what is shuffled is little, what comes of it is much.
    parts = max(int(p.sparkSession.conf.get("spark.sql.shuffle.partitions")), 8) * 4
    spots, rings = (df.repartition(parts, *keys, "leaf") for df in (spots, rings))
    hits = spots.hint("merge").join(rings, [*keys, "leaf"]).filter(in_ring(F.col("lon"), F.col("lat"), F.col("ring")))
    return hits.select(F.explode("_units").alias("unit_id"), "_keys").select("unit_id", F.explode("_keys").alias(key))


def containing(points: DataFrame, polygons: DataFrame, key: str, cell: float = 1.0) -> DataFrame:
    """Points (unit_id, lat, lon) with the smallest ``key`` of the polygons (key, ring) that hold them; points in none are left out.

    Polygons walk down a tree of boxes over the points. Where one covers a node, those of larger keys go no further there, so what reaches the leaves does not grow
    with how many polygons lie on one another. Equal rings walk once.
    """
    p = _known(points).select("unit_id", "lat", "lon")
    size = p.agg(F.min("lon"), F.min("lat"), F.max("lon"), F.max("lat")).first()
    if size[0] is None:
        return p.select("unit_id").join(polygons.select(key), F.lit(False))
    box = (size[0], size[1], max(size[2] - size[0], size[3] - size[1], 1e-9) * (1 + 1e-9))
    held = boxtree.runs(boxtree.in_plane(p, "lon", "lat", box), [], 6)
    cells, top = boxtree.tree(held, [])
    # A trifle wider than what they hold, in degrees.
    edge = lambda c, i, d: F.col(c)[i] * box[2] + box[i] + d * box[2] * 1e-9
    nodes = cells.select("level", F.col("node").alias("_node"), F.col("parent").alias("_parent"), edge("low", 0, -1).alias("_w"), edge("low", 1, -1).alias("_s"), edge("high", 0, 1).alias("_e"), edge("high", 1, 1).alias("_n"))
    nodes = boxtree._checkpointed(nodes)
    side = lambda f, low: (F.array_min if low else F.array_max)(F.transform("ring", lambda q: q[f]))
    state = polygons.select(F.col(key).alias("_key"), "ring").filter("_key is not null and size(ring) > 0").groupBy("ring").agg(F.min("_key").alias("_key"))
    # Parts are numbered: little data with much work is not put together.
    state = state.repartition(max(int(p.sparkSession.conf.get("spark.sql.shuffle.partitions")), 8) * 2, "_key")
    state = state.select("_key", "ring", side("lon", True).alias("_pw"), side("lat", True).alias("_ps"), side("lon", False).alias("_pe"), side("lat", False).alias("_pn"), F.lit(False).alias("covers"), F.lit(None).cast("struct<part:bigint,run:bigint>").alias("node"))

    def passes(a, b):
        """Whether a stretch meets the node's box."""
        turn = [(b["lon"] - a["lon"]) * (F.col(y) - a["lat"]) - (b["lat"] - a["lat"]) * (F.col(x) - a["lon"]) for x in ("_w", "_e") for y in ("_s", "_n")]
        apart = (F.greatest(a["lon"], b["lon"]) < F.col("_w")) | (F.least(a["lon"], b["lon"]) > F.col("_e")) | (F.greatest(a["lat"], b["lat"]) < F.col("_s")) | (F.least(a["lat"], b["lat"]) > F.col("_n"))
        return ~(apart | (F.least(*turn) > 0) | (F.greatest(*turn) < 0))

    whole = ~F.exists(F.zip_with("ring", following(F.col("ring")), passes), lambda x: x) & in_ring(F.col("_w"), F.col("_s"), F.col("ring"))
    touched = (F.col("_pw") <= F.col("_e")) & (F.col("_pe") >= F.col("_w")) & (F.col("_ps") <= F.col("_n")) & (F.col("_pn") >= F.col("_s"))
    for level in range(top, -1, -1):
        here = nodes.filter(F.col("level") == level)
        met = state.join(here, touched if level == top else (F.col("node") == F.col("_parent")) & touched)
        met = boxtree._checkpointed(met.select("_key", "ring", "_pw", "_ps", "_pe", "_pn", F.coalesce(F.col("covers") | whole, F.lit(False)).alias("covers"), F.col("_node").alias("node")))
        least = met.filter("covers").groupBy(F.col("node").alias("_at")).agg(F.min("_key").alias("_least"))
        state = met.join(least, F.col("node") == F.col("_at"), "left").filter("_least is null or _key < _least or (covers and _key = _least)").drop("_at", "_least")
    rings = state.select("_key", "ring", "_pw", "_ps", "_pe", "_pn", "covers", "node.part", "node.run")
    near = F.col("lon").between(F.col("_pw"), F.col("_pe")) & F.col("lat").between(F.col("_ps"), F.col("_pn"))
    hits = held.join(rings, ["part", "run"]).filter(F.col("covers") | near & in_ring(F.col("lon"), F.col("lat"), F.col("ring")))
    return hits.groupBy("unit_id").agg(F.min("_key").alias(key))


def boxes_met(polygons: DataFrame, key: str, cell: float, shares: int = 8, parts: int = 64) -> DataFrame:
    """Pairs (aliases a and b, all columns) of polygons whose boxes overlap or touch, a's key being the smaller, found by shared grid cells. Each pair is kept only in the first cell that both touch.

    A cell's first sides are dealt into ``shares``, which all its second sides meet; parts are numbered, since what is shuffled is little against the pairs that come of it.
    """
    b = _boxed(polygons, cell)
    first = lambda c, low: F.floor(F.greatest(F.col(f"a.{low}"), F.col(f"b.{low}")) / cell) == F.col(f"a.{c}")
    meets = (F.col("a._w") <= F.col("b._e")) & (F.col("b._w") <= F.col("a._e")) & (F.col("a._s") <= F.col("b._n")) & (F.col("b._s") <= F.col("a._n"))
    by = ["_x", "_y", "_of"]
    left = b.withColumn("_of", F.pmod(F.xxhash64(key), F.lit(shares)).cast("int")).repartition(parts, *by)
    right = b.withColumn("_of", F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))).repartition(parts, *by)
    on = reduce(and_, [F.col(f"a.{c}") == F.col(f"b.{c}") for c in by]) & (F.col(f"a.{key}") < F.col(f"b.{key}")) & meets & first("_x", "_w") & first("_y", "_s")
    return left.alias("a").hint("merge").join(right.alias("b"), on)


def box_pairs(polygons: DataFrame, key: str, cell: float = 1.0) -> DataFrame:
    """(a, b) with a < b: polygons whose boxes overlap or touch, see ``boxes_met``."""
    return boxes_met(polygons.select(key, "ring"), key, cell).select(F.col(f"a.{key}").alias("a"), F.col(f"b.{key}").alias("b"))


def shared_boundary(polygons: DataFrame, key: str, within: tuple[str, ...] = ()) -> DataFrame:
    """(``within``, a, b, length) with a < b: the length of the edges that two polygons of one mesh share, in the unit of the coordinates.

    ``within`` names the columns that tell meshes apart, if there are several.
    """
    corner = lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat"))
    edge = F.transform("ring", lambda p, i: F.struct(corner(p).alias("p"), corner(F.element_at("ring", ((i + 1) % F.size("ring") + 1).cast("int"))).alias("q")))
    sides = polygons.select(key, *within, "ring").filter("size(ring) > 0").select(key, *within, F.explode(edge).alias("e")).filter("e.p <> e.q").select(key, *within, F.least("e.p", "e.q").alias("s"), F.greatest("e.p", "e.q").alias("t")).distinct()
    length = F.hypot(F.col("s.lon") - F.col("t.lon"), F.col("s.lat") - F.col("t.lat"))
    same = reduce(and_, [F.col(f"a.{c}") == F.col(f"b.{c}") for c in within], F.lit(True))
    meet = sides.alias("a").join(sides.alias("b"), (F.col("a.s") == F.col("b.s")) & (F.col("a.t") == F.col("b.t")) & (F.col(f"a.{key}") < F.col(f"b.{key}")) & same)
    return meet.select(*[F.col(f"a.{c}").alias(c) for c in within], F.col(f"a.{key}").alias("a"), F.col(f"b.{key}").alias("b"), F.col("a.s").alias("s"), F.col("a.t").alias("t")).groupBy(*within, "a", "b").agg(F.sum(length).alias("length"))
