from geoterra.operators.spatial import inside


def test_points_of_one_place_and_equal_rings_give_all_their_pairs(spark):
    square = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)]
    points = spark.createDataFrame([("g", k, 1.0, 1.0) for k in range(600)] + [("g", 600, 5.0, 5.0), ("h", 601, 1.0, 1.0)], "area string, unit_id long, lat double, lon double")
    polygons = spark.createDataFrame([("g", f"p{k}", square) for k in range(300)], "area string, k string, ring array<struct<lon double, lat double>>")
    got = inside(points, polygons, "k", ["area"])
    assert got.count() == got.distinct().count() == 600 * 300 and got.agg({"unit_id": "max"}).first()[0] == 599
