"""The registry of territory queries and what several of them share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from .views import CTE, Territory

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, recursive: bool = False):
    def add(build: Callable[[Territory], DataFrame]):
        name = build.__name__
        QUERIES[name] = lambda spark, folder: build(Territory(spark, folder))
        if sql:
            ORACLES[name] = (CTE.replace("with ", "with recursive ", 1) if recursive else CTE) + sql
        return build

    return add


def pairs(t: Territory, on: str = "state") -> DataFrame:
    return t.units.alias("u").join(t.poles.alias("p"), F.col(f"u.{on}") == F.col(f"p.{on}"))


def rows(t: Territory, scenario: str = "proposed") -> DataFrame:
    """The units of a scenario with their pole and distance."""
    return getattr(t, scenario).join(t.units.select("unit_id", "unit_key", "municipality_code", "area", "state", "stores", "population"), "unit_id").withColumn("is_district", F.lit(False))


def r(c, n: int = 4):
    return F.round(c, n)


def km():
    return geo.between_tables("u", "p")
