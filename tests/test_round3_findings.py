"""What the findings of round 3 asked for, on small tables."""

import numpy as np
from pyspark.sql import functions as F

from geoterra.functions import shapes
from geoterra.operators import spatial


def test_common_areas_of_many_rows_at_once():
    """Boxes and rings that bend against their closed form; what only touches has none in common."""
    rng = np.random.default_rng(3)
    n = 500
    a, b = rng.uniform(-3, 3, (n, 2)), rng.uniform(-3, 3, (n, 2))
    box = lambda p: (p[:, :1] + [0, 2, 2, 0], p[:, 1:] + [0, 0, 2, 2])
    bent = lambda p: (p[:, :1] + [0, 2, 2, 1, 1, 0], p[:, 1:] + [0, 0, 1, 1, 2, 2])
    cut = lambda p, q, s: np.maximum(np.minimum(p + s, q + 2) - np.maximum(p, q), 0)
    whole = cut(a, b, 2).prod(1)
    assert np.allclose(shapes.common_areas(*box(a), *box(b)), whole)
    lacking = cut(a + 1, b, 1).prod(1)
    assert np.allclose(shapes.common_areas(*bent(a), *box(b)), whole - lacking)
    assert np.allclose(shapes.common_areas(*(v[:, ::-1] for v in box(b)), *bent(a)), whole - lacking)
    assert np.allclose(shapes.common_areas(*box(a), *box(a + [2, 0])), 0)


def test_pairs_of_boxes_are_dealt_to_many_parts(spark):
    """A crowd in one cell is no task's alone, and every pair comes once."""
    rows = spark.range(60).select(F.col("id").alias("k"), F.array(*[shapes.point(F.col("id") / 100 + x, F.lit(float(y))) for x, y in ((0, 0), (1, 0), (1, 1), (0, 1))]).alias("ring"))
    pairs = spatial.box_pairs(rows, "k", 4.0)
    assert sorted(tuple(r) for r in pairs.collect()) == [(i, j) for i in range(60) for j in range(i + 1, 60)]
    assert len({r.p for r in pairs.select(F.spark_partition_id().alias("p")).distinct().collect()}) > 4


def test_circles_against_all_pairs(spark):
    """Shared spots, lone spots, empty circles and several centres in one place, against the distances of all pairs."""
    import pandas as pd

    from geoterra.operators import graph
    from geoterra.operators.solvers import distances

    rng = np.random.default_rng(11)
    spot = rng.uniform([-20, 170], [-10, 180], (250, 2))
    lat, lon = np.concatenate([spot, spot[:60], spot[:5], [[40, 0], [40.5, 0]]]).T
    lon = np.where(lon > 179, lon - 360, lon)
    u = pd.DataFrame({"unit_id": rng.permutation(len(lat)), "lat": lat, "lon": lon})
    c = pd.DataFrame({"pole_id": [f"p{i}" for i in range(40)], "lat": np.append(rng.uniform(-22, -8, 36), [-15, -15, 40, -70]), "lon": np.append(rng.uniform(168, 180, 36), [175, 175, 0.1, 0])})
    for radius in (150.0, 400.0):
        want = set()
        for p in c.itertuples():
            km = distances(u, pd.DataFrame({"lat": [p.lat], "lon": [p.lon]}))[:, 0]
            v = u.assign(km=km)[km <= radius].sort_values(["km", "unit_id"]).reset_index(drop=True)
            if v.empty:
                continue
            every = distances(v, v)
            np.fill_diagonal(every, np.inf)
            near = np.sort(every.min(1)) if len(v) > 1 else np.array([25.0])
            link = min(max(20.0, 2.5 * near[min(len(v) - 1, int(len(v) * 0.75))]), max(35.0, 0.45 * radius))
            seen, front = {0}, [0]
            while front:
                front = [k for k in np.flatnonzero((every[front] <= link).any(0)).tolist() if k not in seen]
                seen |= set(front)
            want |= {(p.pole_id, int(v["unit_id"][k])) for k in seen}
        got = graph.reached(spark.createDataFrame(u), spark.createDataFrame(c), radius).collect()
        assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_circles_share_their_places(spark):
    """Places are moved once for each task of neighbouring centres, not once for each circle."""
    from geoterra.operators import graph

    places = spark.range(300).select(F.col("id").alias("unit_id"), (F.col("id") % 20 / 10).alias("lat"), (F.col("id") / 200).alias("lon"))
    centres = spark.range(200).select(F.col("id").cast("string").alias("pole_id"), (F.col("id") / 1000).alias("lat"), F.lit(0.1).alias("lon"))
    out = graph.reached(places, centres, 300.0)
    assert "FlatMapCoGroupsInPandas" in out._jdf.queryExecution().toString() and out.count() == 60_000


def test_polygons_under_a_cover_go_no_further(spark):
    """The smallest key is right for polygons that bend, lie on one another, repeat and leave points out; so it is where 2,000 cover all points."""
    import pandas as pd

    from geoterra.functions.geo import in_ring

    rng = np.random.default_rng(5)
    points = spark.createDataFrame(pd.DataFrame({"unit_id": range(3000), "lat": rng.uniform(0, 10, 3000), "lon": rng.uniform(0, 10, 3000)}))
    shape = lambda x, y, s: [(x, y), (x + s, y), (x + s, y + s / 2), (x + s / 2, y + s / 2), (x + s / 3, y + s)]
    rows = [(int(k), [{"lon": float(a), "lat": float(b)} for a, b in shape(*rng.uniform(-2, 9, 2), rng.uniform(0.1, 8))]) for k in rng.permutation(150)]
    rows += [(k + 1000, r) for k, r in rows[:40]]
    polygons = spark.createDataFrame(rows, f"k long, ring {shapes.RING}")
    want = points.join(polygons, in_ring(F.col("lon"), F.col("lat"), F.col("ring"))).groupBy("unit_id").agg(F.min("k").alias("k"))
    got = spatial.containing(points, polygons, "k")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    wide = spark.range(2000).select(F.col("id").alias("k"), F.array(*[shapes.point(F.lit(x) + F.col("id") / 1e4, F.lit(y)) for x, y in ((-5.0, -5.0), (15.0, -5.0), (15.0, 15.0), (-5.0, 15.0))]).alias("ring"))
    held = spatial.containing(points, wide, "k")
    assert held.count() == 3000 and held.filter("k <> 0").isEmpty()


def test_paths_without_the_far_edges(spark):
    """The same roots, parents and lengths as over all edges in reach, with units that no root can reach directly or at all."""
    from geoterra.operators import graph

    rng = np.random.default_rng(2)
    rows = [(i, float(a), float(b), "x" if i % 3 else "y") for i, (a, b) in enumerate(rng.uniform(0, 12, (240, 2)))]
    places = spark.createDataFrame(rows, "unit_id long, lat double, lon double, g string")
    roots = places.filter("unit_id % 60 = 1").select("unit_id")
    met = spatial.within_km(places, places, 300.0, ["g"]).filter("a.unit_id <> b.unit_id").select(F.col("a.unit_id").alias("src"), F.col("b.unit_id").alias("dst"), F.round("km", 4).alias("km"))
    whole = {(r.unit_id, r.root, r.parent, round(r.km, 6)) for r in graph.voronoi(roots, graph._checkpointed(met)).collect()}
    assert {(r.unit_id, r.root, r.parent, round(r.km, 6)) for r in graph.voronoi_near(roots, places, 300.0, ["g"]).collect()} == whole
    assert any(x[2] not in (None, x[1]) for x in whole)


def test_far_groups_have_small_cells(spark):
    """Edges of a mesh that is long and thin meet few others, however long it is."""
    from geoterra.operators import overlay

    corner = lambda x, y: shapes.point(F.col("id") * 10.0 + x, F.lit(float(y)))
    rings = spark.range(400).select(F.lit(0).alias("gid"), F.lit(0).alias("layer"), F.array(corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1)).alias("ring"))
    e = overlay._checkpointed(overlay.edges(rings, 1e6))
    assert overlay._close(e, 1e6).count() <= 400 * 4 * 3 * 4
    assert overlay.meetings(e, 1e6).isEmpty()
