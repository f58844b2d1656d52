"""Drafts as an append-only table of revisions: the newest revision of an id counts, and a deletion is a revision too."""

from __future__ import annotations

import hashlib
import time

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import created_once

SCHEMA = "id string, name string, base_scenario string, revision long, updated_at double, deleted boolean, data string"


class Conflict(Exception):
    """The draft has moved on from the revision that the change was made on."""


def revisions(spark: SparkSession, path: str) -> DataFrame:
    """All revisions; an empty table where nothing has been written."""
    try:
        return spark.read.schema(SCHEMA).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], SCHEMA)


def latest(all_revisions: DataFrame) -> DataFrame:
    """The newest revision of each id that has not been deleted; of two writers of one revision the earlier counts."""
    newest = all_revisions.groupBy("id").agg(F.max_by(F.struct(*[c for c in all_revisions.columns if c != "id"]), F.struct("revision", -F.col("updated_at"))).alias("d"))
    return newest.filter("not d.deleted").select("id", "d.*")


def write(spark: SparkSession, path: str, id: str, revision: int | None, name: str = "", base_scenario: str = "", data: str = "{}", deleted: bool = False) -> int:
    """Append the revision after ``revision`` (None for a new draft) and return its number; raises Conflict if that is not the newest.

    A writer first creates the claim ``<path>.claims/<id>/<revision>``, which the file system gives to one writer only, so
    of two at once one gets the conflict. The row is one file, committed whole.
    """
    every = revisions(spark, path).filter(F.col("id") == id)
    now, past = latest(every).select("revision").first(), every.agg(F.max("revision")).first()[0] or 0
    if (now.revision if now else None) != revision or not created_once(spark, f"{path.rstrip('/')}.claims/{hashlib.sha256(id.encode()).hexdigest()}/{past + 1}"):
        raise Conflict(f"{id}: revision {revision} is not the newest")
    spark.createDataFrame([(id, name, base_scenario, past + 1, time.time(), deleted, data)], SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return past + 1


def features(mesh: DataFrame, units: DataFrame) -> DataFrame:
    """Units of a draft on a mesh: by unit id, else a district by its code, else a municipality by its code; then units without a polygon.

    ``mesh`` has (feature_id, unit_key, municipality_code, district_code), ``units`` (unit_key, kind, municipality_code, district_code, pole_id).
    Columns: feature_id (null without a polygon), unit_key, pole_id, matched (ID, DISTRICT, MUNICIPALITY, NONE).
    """
    from ..functions.values import code_last, digits

    u = units.select("unit_key", "pole_id", (F.upper("kind") == "DISTRITO").alias("is_district"), code_last(F.col("municipality_code"), 7).alias("m"), digits(F.col("district_code")).alias("d"))
    direct = mesh.join(u, "unit_key").select("feature_id", "unit_key", "pole_id", F.lit("ID").alias("matched"))
    rest = mesh.join(direct.select("feature_id"), "feature_id", "left_anti").select("feature_id", code_last(F.col("municipality_code"), 7).alias("m"), F.nullif(digits(F.col("district_code")), F.lit("")).alias("d"))
    by_district = rest.filter("d is not null").join(u.filter("is_district").select("unit_key", "pole_id", "d"), "d").select("feature_id", "unit_key", "pole_id", F.lit("DISTRICT").alias("matched"))
    by_city = rest.filter("d is null").join(u.filter("not is_district").select("unit_key", "pole_id", "m"), "m").select("feature_id", "unit_key", "pole_id", F.lit("MUNICIPALITY").alias("matched"))
    found = direct.union(by_district).union(by_city)
    bare = u.join(found.select("unit_key"), "unit_key", "left_anti").select(F.lit(None).cast(mesh.schema["feature_id"].dataType).alias("feature_id"), "unit_key", "pole_id", F.lit("NONE").alias("matched"))
    return found.union(bare)
