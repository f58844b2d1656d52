"""Findings of round 4 about the corpus operators."""

from pyspark.sql import functions as F


def test_manifest_rows_are_short(spark, monkeypatch):
    """No row that is kept between the levels holds more than one leaf and its path."""
    from geoterra.llm import merkle_manifest, order

    longest = []

    def measured(df, name, keep=merkle_manifest.written):
        table = keep(df, name)
        longest.append(table.agg(F.max(F.length(F.to_json(F.struct("*")))).alias("n")).first().n or 0)
        return table

    monkeypatch.setattr(merkle_manifest, "written", measured)
    monkeypatch.setattr(order, "written", measured)
    docs = spark.range(1500).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit("en").alias("lang"), F.lit(3).alias("n_chars"), F.col("id").cast("string").alias("text"))
    found = merkle_manifest.manifest(docs)
    assert found.filter("verified and size(path) = 11").count() == 1500
    assert found.select("root", "subroot").distinct().count() == 1
    assert max(longest) < 5000
