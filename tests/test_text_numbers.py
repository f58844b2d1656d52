"""Numbers in GeoJSON texts: plain digits for small ones, as the SQL's casts write them."""

import duckdb
from pyspark.sql import functions as F


def test_coordinates_are_written_as_duckdb_writes_them(spark):
    from geoterra.sources.tables import json_number

    # All latitudes and longitudes of the test territory, however many rows it has, and numbers beyond them.
    rows = spark.range(38000).select(F.explode(F.array(F.lit(-33.0) + F.col("id").cast("double") / 1000.0, F.lit(-73.0) + F.col("id").cast("double") / 1000.0)).alias("x"))
    odd = [0.0, -0.0, 1e-5, -2.5e-5, 1e-4, 9.999999999976694e-4, 1e-3, 1e7, 123456789.125, 1e15, 9007199254740993.0, 1e16, 1.25e17, 3e-200, 1e300]
    got = rows.union(spark.createDataFrame([(v,) for v in odd], "x double")).select("x", json_number("x").alias("t")).toPandas()
    want = duckdb.sql("select cast(x as varchar) as t from got").df()["t"]
    assert [(x, a, b) for x, a, b in zip(got["x"], got["t"], want) if a != b] == []


def test_features_near_the_equator(spark):
    from geoterra.sources.reports import line_features, polygon_features
    from geoterra.sources.tables import point_features

    x = 9.999999999976694e-4
    df = spark.createDataFrame([("a", x, -x, 1.5, None), ("b", None, 2.0, 1.5, 3.0)], "id string, lon double, lat double, to_lon double, to_lat double").fillna(0.0, ["to_lat"])
    head, tail = '{"type":"Feature","geometry":{"type":', '},"properties":{"id":"a"}}'
    points = [r.feature for r in point_features(df, ["id"]).collect()]
    assert points == [head + '"Point","coordinates":[0.0009999999999976694,-0.0009999999999976694]' + tail, head + '"Point","coordinates":[null,2.0]' + tail.replace('"a"', '"b"')]
    assert [r.feature for r in line_features(df, ["id"]).collect()] == [head + '"LineString","coordinates":[[0.0009999999999976694,-0.0009999999999976694],[1.5,0.0]]' + tail]
    ring = df.filter("id = 'a'").select("id", F.array(F.struct("lon", "lat"), F.struct(F.lit(1.0).alias("lon"), F.lit(0.0).alias("lat")), F.struct(F.lit(1.0).alias("lon"), F.lit(1.0).alias("lat"))).alias("ring"))
    p = "[0.0009999999999976694,-0.0009999999999976694]"
    assert [r.feature for r in polygon_features(ring, ["id"]).collect()] == [head + f'"Polygon","coordinates":[[{p},[1.0,0.0],[1.0,1.0],{p}]]' + tail]
