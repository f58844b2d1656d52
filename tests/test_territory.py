import itertools
import math

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from geoterra.functions import geo, values
from geoterra.operators import graph, portfolio, solvers, spatial, stats
from geoterra.sources import tables


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).first()


def test_one_degree(spark):
    assert one(spark, km=geo.haversine(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))).km == pytest.approx(111.195, rel=1e-4)


def test_heat_band_edges(spark):
    rows = spark.createDataFrame([(p,) for p in (0.0, 30_000.0, 30_001.0, 100_000.0, 500_000.0, 500_001.0, 1_000_001.0)], ["p"])
    assert [r.b for r in rows.select(values.heat_band(F.col("p")).alias("b")).collect()] == [0, 0, 1, 1, 2, 3, 4]


def test_codes(spark):
    r = one(spark, a=values.code_six_to_seven(F.lit("355030")), b=values.code_six_to_seven(F.lit("3550308")), c=values.code_last(F.lit("12"), 7))
    assert (r.a, r.b, r.c) == ("3550300", "3550308", "0000012")


@pytest.mark.parametrize("weights, keep, want", [([99.0, 1.0], False, 10.0), ([0.0, 0.0], True, 100.0)])
def test_weighted_percentile(spark, weights, keep, want):
    df = spark.createDataFrame([("g", v, w) for v, w in zip((10.0, 100.0), weights)], ["g", "v", "w"])
    assert stats.weighted_percentile(df, ["g"], "v", "w", 0.9, "p", keep_zero=keep).first().p == want


def test_consolidation(spark):
    rows = spark.createDataFrame([Row(k="100", stores=2, population=100.0, lat=0.0, lon=0.0, source_id="a"), Row(k="100", stores=3, population=90.0, lat=0.0, lon=1.0, source_id="b")])
    r = portfolio.consolidate(rows, ["k"], "source_id").first()
    assert (r.stores, r.population, r.lon, r.records, r.diverges) == (5, 100.0, 0.0, 2, True)


def test_bottleneck_and_assignment():
    cost = np.array([[1.0, 100, 100], [2, 3, 100], [100, 4, 5]])
    at, most = solvers.bottleneck(cost)
    assert most == 5 and cost[range(3), at].sum() == 9
    rng = np.random.default_rng(1)
    for n in range(1, 6):
        c = rng.random((n, 6))
        assert c[range(n), solvers.assignment(c)].sum() == pytest.approx(min(c[range(n), p].sum() for p in itertools.permutations(range(6), n)))


def test_components_and_voronoi(spark):
    edges = [(1, 2, 1.0), (2, 3, 2.0), (3, 4, 1.5), (6, 7, 1.0)]
    e = spark.createDataFrame([x for a, b, k in edges for x in ((a, b, k), (b, a, k))], ["src", "dst", "km"])
    nodes = spark.range(1, 8).withColumnRenamed("id", "unit_id")
    assert {r.unit_id: r.component for r in graph.components(nodes, e).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 6, 7: 6}
    got = {r.unit_id: (r.root, r.km) for r in graph.voronoi(spark.createDataFrame([(1,), (4,)], ["unit_id"]), e).collect()}
    assert got == {1: (1, 0.0), 2: (1, 1.0), 3: (4, 1.5), 4: (4, 0.0)}


def test_scenario_reader_unwraps_drafts(spark, tmp_path):
    (tmp_path / "s.json").write_text('﻿{"id":"d","data":{"id":"x","poles":[{"id":"1","latitude":1.5,"lon":2}],"units":[]}}', encoding="utf-8")
    p = tables.scenario_poles(tables.scenario(spark, str(tmp_path / "s.json"))).first()
    assert (p.pole_id, p.lat, p.lon) == ("1", 1.5, 2.0)


def test_table_names():
    assert tables.checked_name("a.b_c") == "a.b_c"
    for bad in ("a;b", "a.b.c.d", "1a", ""):
        with pytest.raises(ValueError):
            tables.checked_name(bad)


def test_area_and_ring(spark):
    box = F.array(*[F.struct(F.lit(float(x)).alias("lon"), F.lit(float(y)).alias("lat")) for x, y in ((0, 0), (4, 0), (4, 2), (0, 2))])
    r = one(spark, a=geo.ring_area(box), c=geo.box_centre(box), i=geo.in_ring(F.lit(1.0), F.lit(1.0), box), o=geo.in_ring(F.lit(5.0), F.lit(1.0), box))
    assert (r.a, r.c.lon, r.c.lat, r.i, r.o) == (8.0, 2.0, 1.0, True, False) and math.isfinite(r.a)


def test_dissolved_squares(spark):
    square = lambda x: [Row(lon=float(x + i), lat=float(j)) for i, j in ((0, 0), (1, 0), (1, 1), (0, 1))]
    rows = spark.createDataFrame([("k", square(0)), ("k", square(1)), ("k", square(1)), ("k", None), ("k", [])], "k string, ring array<struct<lon double, lat double>>")
    got = {(r.x1, r.y1, r.x2, r.y2) for r in spatial.dissolved(rows, "k").collect()}
    assert got == {(0, 0, 1, 0), (1, 0, 2, 0), (0, 1, 1, 1), (1, 1, 2, 1), (0, 0, 0, 1), (2, 0, 2, 1)}


def test_retained_poles(spark):
    poles = spark.createDataFrame([("a", 1, "N", 5), ("b", 2, "N", 5), ("c", 3, "N", None), ("d", 4, "S", 9)], "pole_id string, pole_num long, area string, load long")
    got = {r.pole_id: r.role for r in portfolio.retained(poles, spark.createDataFrame([("N", 1)], ["area", "target"])).collect()}
    assert got == {"a": "RETIDO", "b": "DOADOR", "c": "DOADOR", "d": "DOADOR"}


def test_matching_with_an_empty_side(spark):
    a = spark.createDataFrame([("N", "a", 1, 0.0, 0.0)], "g string, pole_id string, pole_num long, lat double, lon double")
    b = spark.createDataFrame([("S", "b", 2, 0.0, 0.0)], a.schema)
    assert solvers.matched(a, b, "g").count() == 0


def test_matching_two_parts_of_one_table(spark):
    a = spark.createDataFrame([("N", str(i), i, float(i), 0.0) for i in range(4)], "g string, pole_id string, pole_num long, lat double, lon double")
    got = solvers.matched(a.filter("pole_num % 2 = 0"), a.filter("pole_num % 2 = 1"), "g").collect()
    assert sorted((r.current, r.proposed) for r in got) == [("0", "1"), ("2", "3")]
