import random

from geoterra.functions.geo import haversine
from geoterra.operators import seeds
from pyspark.sql import functions as F


def test_seats_by_distance_against_the_table_of_pairs(spark):
    """Two cities side by side, with shared places and an anchor; what lies beyond the reach is not served."""
    rng = random.Random(2)
    rows = [("N", k, "ab"[k % 2], rng.choice([0.5, 1.0, 2.0]), float(rng.randint(0, 6)), float(rng.randint(0, 6))) for k in range(40)]
    u = spark.createDataFrame(rows, "g string, unit_id long, city string, weight double, lat double, lon double")
    need = spark.createDataFrame([("a", 2.0, 2.0, 2), ("b", 1.0, 1.0, 2)], "city string, load double, population double, seats int")
    anchors = spark.createDataFrame([(3, "b")], "candidate long, city string")
    km = haversine(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon"))
    pairs = u.alias("a").join(u.alias("b"), km <= 250.0).select(F.col("a.city").alias("city"), F.col("a.unit_id").alias("unit_id"), F.col("b.unit_id").alias("candidate"), F.col("b.city").alias("home"), km.alias("cost"), "a.weight", F.lit(0.0).alias("opening"))
    (got, lack), (want, short) = seeds.seeds_near(u, "g", 250.0, need, 4, anchors), seeds.seeds(pairs, need, 4, anchors)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 4
    assert lack.collect() == short.collect() == []
