from pyspark.sql import functions as F

from geoterra.plans.registry import QUERIES
import geoterra.plans.summaries  # noqa: F401


def test_matrix_is_dealt_to_tasks(spark):
    """Few poles come from one small file; the matrix is worked out in many parts, each pair once."""
    df = QUERIES["j14_distance_matrix"](spark, "/root/testdata/sf0.01")
    counts = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    n = df.select("a").distinct().count()
    assert df.select("a", "b").distinct().count() == sum(counts) == n * n
    assert len(counts) >= 8 and max(counts) < n * n / 4
