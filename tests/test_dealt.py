"""Work dealt into parts whose size does not grow with the tables."""

from pyspark.sql import functions as F


def test_lines_are_dealt_into_parts_of_bounded_size(spark, tmp_path):
    from geoterra.plans.views import Territory

    # Twenty lines an order, each pair of order and supplier twice.
    lines = spark.range(2_600_000).select((F.col("id") % 130_000).alias("l_orderkey"), (F.col("id") % 1_300_000 % 997).alias("l_suppkey"))
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(130_000).select(F.col("id").alias("o_orderkey"), (F.col("id") % 900).alias("o_custkey")).write.parquet(f"{tmp_path}/orders.parquet")
    t = Territory(spark, str(tmp_path))
    sizes = t.owners.groupBy(F.spark_partition_id()).count().collect()
    want = lines.select("l_orderkey", "l_suppkey").distinct().count()
    assert len(sizes) == 6 and sum(r["count"] for r in sizes) == want and max(r["count"] for r in sizes) < 2 * want / 6


def test_all_pairs_meet_once_in_any_blocks(spark):
    from geoterra.operators.spatial import all_pairs

    units = spark.range(50).select(F.col("id").alias("unit_id"), F.when(F.col("id") % 7 != 0, F.col("id") % 3).alias("area"))
    poles = spark.range(40).select(F.col("id").cast("string").alias("pole_id"), F.when(F.col("id") % 5 != 0, F.col("id") % 4).alias("area"))
    want = sorted((u, str(p)) for u in range(50) for p in range(40) if u % 7 and p % 5 and u % 3 == p % 4)
    for block, shares in ((512, 64), (3, 5), (1, 1)):
        met = all_pairs(units, poles, ["area"], block=block, shares=shares).select("u.unit_id", "p.pole_id")
        assert sorted(map(tuple, met.collect())) == want


def test_pairs_of_one_state_are_spread_over_tasks(spark):
    from geoterra.operators.spatial import all_pairs

    # One state for all, but as rows: plans fold what they know to be one value.
    units, poles = (spark.createDataFrame([(i, "x") for i in range(n)], f"{k} long, state string") for n, k in ((400, "unit_id"), (30, "pole_id")))
    met = all_pairs(units, poles, ["state"])
    got = met.select("u.unit_id", "p.pole_id", F.spark_partition_id().alias("task")).collect()
    assert len(got) == 12_000 and len({r.task for r in got}) > 8
