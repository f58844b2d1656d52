"""Shared scratch space, and documents kept in shards that later steps meet again without moving the texts."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; one of our own only in a local session that names none (tests)."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="spark-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, read again: lineage ends here, and a lost executor loses nothing."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shards(docs: DataFrame, shard_bytes: int = 12 << 20, keep: tuple[str, ...] = ()) -> tuple[DataFrame, int]:
    """(doc_id, text as bytes, the columns in ``keep``) written once as a table bucketed by ``shard``, and the number of shards.

    A shard is a part of an input partition, so nothing is shuffled; a hash of the row splits partitions of more
    than ``shard_bytes``. Steps that group by ``shard`` read the bucketed files in place, and only what other
    shards send them moves.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"), *keep)
    sizes = rows.groupBy(F.spark_partition_id().alias("p")).agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 64).alias("b"))
    top = sizes.agg(F.max("b").alias("b"), F.max("p").alias("p"), F.sum("b").alias("all")).first()
    split = max(1, math.ceil((top.b or 1) / shard_bytes))
    count = ((top.p or 0) + 1) * split
    cell = F.spark_partition_id() * split + F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(split)).cast("int")
    name = f"shards_{uuid.uuid4().hex[:12]}"
    path = scratch(spark, "shards")
    buckets = max(1, min(count, 100_000, math.ceil((top.all or 1) / shard_bytes * 2)))
    rows.select(cell.cast("int").alias("shard"), "doc_id", "text", *keep).write.option("path", path).option("compression", "zstd").bucketBy(buckets, "shard").saveAsTable(name)
    return spark.table(name), count


def smallest(rows: DataFrame, sample: int, *ties: str) -> DataFrame:
    """At most ``sample`` rows, those with the smallest hash ``h``. A bound on the hash keeps about twice as many first, so what is sorted does not grow with the table."""
    count = rows.count()
    if count > 4 * sample:
        rows = rows.filter(F.col("h") <= -(2**63) + int(2**64 * (2 * sample / count)))
    return rows.orderBy("h", *ties).limit(sample)
