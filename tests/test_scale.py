"""Trees of cells under skew, and places and percentiles dealt by ranges, against plain sorts."""

import math
import random

import pytest
from pyspark.sql import functions as F


def crowd(n, seed, share=0.9):
    """Points of which most lie within some hundred metres, some in one place; others over the whole globe, at the date line and the poles."""
    rng = random.Random(seed)
    out = []
    for k in range(n):
        if k % 10 < share * 10:
            out.append((k, -23.5 + rng.uniform(-0.002, 0.002), -46.6 + rng.uniform(-0.002, 0.002)) if k % 7 else (k, -23.5, -46.6))
        else:
            out.append((k, rng.uniform(-90, 90), rng.choice([rng.uniform(-180, 180), 179.999, -179.999, 180.0, -180.0])))
    return out


def km(a, b):
    la1, lo1, la2, lo2 = map(math.radians, (a[1], a[2], b[1], b[2]))
    h = math.sin((la2 - la1) / 2) ** 2 + math.cos(la1) * math.cos(la2) * math.sin((lo2 - lo1) / 2) ** 2
    return 2 * 6371.0088 * math.asin(math.sqrt(min(1.0, h)))


@pytest.mark.parametrize("k", [1, 4])
def test_nearest_in_a_crowd(spark, k):
    from geoterra.operators.spatial import nearest_k

    units, poles = crowd(300, 1), crowd(200, 2)
    u = spark.createDataFrame([(i, a, b, "x" if i % 3 else "y") for i, a, b in units] + [(999, None, 1.0, "x"), (998, 1.0, 1.0, "z")], "unit_id long, lat double, lon double, area string")
    p = spark.createDataFrame([(f"p{i}", i, a, b, "x" if i % 2 else "y") for i, a, b in poles] + [("none", 5000, None, None, "x")], "pole_id string, pole_num long, lat double, lon double, area string")
    for keys in ([], ["area"]):
        got = {}
        for r in nearest_k(u, p, k, keys).collect():
            got.setdefault(r.unit_id, []).append((r["rank"], r.pole_id, r.km))
        every = units + ([] if keys else [(998, 1.0, 1.0)])
        assert got.keys() == {x[0] for x in every}
        for x in every:
            mine = sorted((round(km(x, q), 9), q[0]) for q in poles if not keys or bool(x[0] % 3) == bool(q[0] % 2))[:k]
            assert [(i + 1, f"p{n}") for i, (_, n) in enumerate(mine)] == [(a, b) for a, b, _ in sorted(got[x[0]])]
            assert [d for d, _ in mine] == pytest.approx([d for _, _, d in sorted(got[x[0]])], abs=1e-6)
    assert nearest_k(u, p.limit(0), k).count() == 0 and nearest_k(u.limit(0), p, k).count() == 0


def test_no_key_holds_a_crowd(spark):
    """Nine tenths of both sides within a few hundred metres, many in one place: runs have their size, and no unit meets more leaves than the bound."""
    from geoterra.operators import boxtree

    rows = spark.createDataFrame([(i, a, b) for i, a, b in crowd(4000, 3)], "id long, lat double, lon double")
    p = boxtree.on_sphere(rows.filter("id % 7 <> 0"))
    held = boxtree.runs(p, [], 4)
    assert held.count() == p.count() and held.groupBy("part", "run").count().agg(F.max("count")).first()[0] == 16
    cells, top = boxtree.tree(held, [])
    assert cells.filter(F.col("level") == top).count() == 1 and cells.filter("level = 0").agg(F.sum("n")).first()[0] == p.count()
    pairs = boxtree.candidates(boxtree.on_sphere(rows), p, [], k=1, block=6, leaf=4, most=48)
    per = pairs.agg(F.max(F.size("b")), F.count("*")).first()
    assert per[0] <= 48 * 16 and per[1] == 4000


def test_inside_in_a_crowd(spark):
    from geoterra.operators.spatial import containing, inside

    points = crowd(500, 4)
    boxes = [(1, -24, -47, 1.0), (2, -23.501, -46.601, 0.001), (3, -90, -180, 360.0), (4, 10, 10, 30.0), (5, -24, -47, 1.0)]
    ring = lambda s, w, d: [{"lon": w + x * d, "lat": s + y * d} for x, y in ((0, 0), (1, 0), (1, 1), (0, 1))]
    polygons = spark.createDataFrame([(k, ring(s, w, d)) for k, s, w, d in boxes] + [(9, None), (8, [])], "k long, ring array<struct<lon:double,lat:double>>")
    df = spark.createDataFrame(points, "unit_id long, lat double, lon double")
    want = {(i, k) for i, a, b in points for k, s, w, d in boxes if s <= a < s + d and w <= b < w + d}
    assert {(r.unit_id, r.k) for r in inside(df, polygons, "k").collect()} == want
    assert {r.unit_id: r.k for r in containing(df, polygons, "k").collect()} == {i: min(k for j, k in want if j == i) for i, _ in want}
    assert inside(df.limit(0), polygons, "k").count() == 0 and inside(df, polygons.limit(0), "k").count() == 0


def test_places_and_sums(spark):
    from geoterra.operators.ranks import ordered

    rng = random.Random(5)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.randrange(50), k, rng.choice([None, 1, 2, 5])) for k in range(400)]
    df = spark.createDataFrame(rows, "g string, v long, k long, w long").repartition(6)
    got = {r.k: (r.idx, r.run) for r in ordered(df, [F.desc("v"), "k"], ["g"], sums={"run": "w"}).collect()}
    for g in ("a", "b", None):
        total = 0
        for i, r in enumerate(sorted([r for r in rows if r[0] == g], key=lambda r: (-r[1], r[2]))):
            total += r[3] or 0
            assert got[r[2]][0] == i and (got[r[2]][1] or 0) == total
    assert [r.k for r in ordered(df, ["v", "k"]).orderBy("idx").collect()] == [r[2] for r in sorted(rows, key=lambda r: (r[1], r[2]))]
    assert ordered(df.limit(0), ["v"]).count() == 0


def test_percentiles_by_ranges(spark):
    from geoterra.operators.stats import percentiles, weighted_percentile

    rng = random.Random(6)
    rows = [(rng.choice(["a", "b", None]), round(rng.uniform(0, 9), 1) if k % 9 else None, rng.choice([0.0, 1.0, 3.0])) for k in range(300)]
    df = spark.createDataFrame(rows, "g string, v double, w double")
    qs = {"p10": 0.1, "p50": 0.5, "p75": 0.75}
    want = {r.g: r for r in df.groupBy("g").agg(*[F.percentile("v", q).alias(n) for n, q in qs.items()]).collect()}
    got = {r.g: r for r in percentiles(df, ["g"], "v", qs).collect()}
    assert got.keys() == want.keys() and all(got[g][n] == pytest.approx(want[g][n]) for g in want for n in qs)
    assert percentiles(df, [], "v", qs).first().p50 == pytest.approx(df.agg(F.median("v")).first()[0])
    for zero in (False, True):
        a = {r.g: r.x for r in weighted_percentile(df, ["g"], "v", "w", 0.9, "x", zero, few=True).collect()}
        assert a == {r.g: r.x for r in weighted_percentile(df, ["g"], "v", "w", 0.9, "x", zero).collect()}
