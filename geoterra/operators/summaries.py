"""Summaries of poles, areas, regions and whole scenarios over assigned units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values as v
from .stats import floored_mean, weighted_percentile


def weighted_or_plain(value: Column, weight: Column) -> Column:
    """Weighted mean; the plain one if the weights do not add up to more than zero."""
    total = F.sum(F.when(value.isNotNull(), weight))
    return F.when(total > 0, F.sum(value * weight) / F.nullif(total, F.lit(0.0))).otherwise(F.avg(value))


def managers(rows: DataFrame, low: float = 0.75, high: float = 1.25) -> DataFrame:
    """Per pole: counts, sums, distances, units that cross a state, and its load against the mean load, with its band.

    ``rows`` has (pole_id, unit_id, municipality_code, stores, population, load, km, crosses). The mean is over poles that serve.
    """
    per = rows.groupBy("pole_id").agg(
        F.count_distinct("unit_id").alias("units"), F.count_distinct("municipality_code").alias("municipalities"), F.sum("stores").cast("long").alias("stores"), F.sum("population").alias("population"), F.sum("load").alias("load"),
        F.avg("km").alias("km_mean"), floored_mean(F.col("km"), F.col("population"), 1.0).alias("km_weighted"), F.max("km").alias("km_max"), F.count_if(F.col("crosses")).alias("crossing"),
    )
    mean = rows.agg((F.sum("load") / F.nullif(F.count_distinct("pole_id"), F.lit(0))).alias("mean_load"))
    index = F.try_divide("load", "mean_load")
    return per.crossJoin(F.broadcast(mean)).withColumn("index", index).withColumn("band", v.load_band(F.col("index"), low, high)).drop("mean_load")


def scenario_row(rows: DataFrame) -> DataFrame:
    """One row of indicators for a scenario: ``rows`` has (pole_id, unit_id, municipality_code, stores, population, load, km, radius_km, crosses)."""
    inside = F.col("km") <= F.col("radius_km")
    whole = rows.agg(
        F.count_distinct("pole_id").alias("poles"), F.count_distinct("unit_id").alias("units"), F.count_distinct("municipality_code").alias("municipalities"), F.sum("stores").cast("long").alias("stores"), F.sum("population").alias("population"),
        F.avg("km").alias("km_mean"), floored_mean(F.col("km"), F.col("population"), 1.0).alias("km_weighted"), F.max("km").alias("km_max"), F.count_if(F.col("crosses")).alias("crossing"),
        F.count_if(F.col("radius_km").isNotNull() & ~inside).alias("outside"), F.try_divide(F.sum(F.when(inside, F.col("population"))), F.sum(F.when(F.col("radius_km").isNotNull(), F.col("population")))).alias("inside_share"),
    )
    loads = rows.groupBy("pole_id").agg(F.sum("load").alias("l")).agg(F.stddev_pop("l").alias("load_deviation"), F.min("l").alias("load_min"), F.max("l").alias("load_max"))
    return whole.crossJoin(F.broadcast(loads))


def regions(rows: DataFrame, targets: DataFrame, baseline: DataFrame, tolerance: float = 0.15, p90_tolerance: float = 0.10) -> tuple[DataFrame, DataFrame]:
    """Per region its load band and 90th percentile against the baseline's, and the poles and regions that break them.

    ``rows`` has (region, pole_id, population, km), ``targets`` (region, target), ``baseline`` (region, p90_base).
    """
    p90 = weighted_percentile(rows, ["region"], "km", "population", 0.9, "p90", keep_zero=True)
    total = rows.groupBy("region").agg(F.sum("population").alias("population"), F.count_distinct("pole_id").alias("poles"))
    mean = F.try_divide("population", "target")
    base = targets.join(total, "region", "left").join(p90, "region", "left").join(baseline, "region", "left").withColumn("lower", mean * (1 - tolerance)).withColumn("upper", mean * (1 + tolerance)).withColumn("p90_limit", F.col("p90_base") * (1 + p90_tolerance))
    base = base.withColumn("p90_ok", F.col("p90_base").isNull() | (F.col("p90") <= F.col("p90_limit") + 1e-9))
    loads = rows.groupBy("region", "pole_id").agg(F.sum("population").alias("value")).join(base.select("region", "lower", "upper"), "region")
    outside = loads.filter(~F.col("value").between(F.col("lower"), F.col("upper")))
    table = base.join(outside.groupBy("region").agg(F.count("*").alias("outside")), "region", "left").na.fill(0, ["outside"])
    broken = outside.select(F.lit("FAIXA_POPULACIONAL").alias("kind"), "region", "pole_id", "value").unionByName(base.filter(~F.col("p90_ok")).select(F.lit("P90_DISTANCIA").alias("kind"), "region", F.lit("").alias("pole_id"), F.col("p90").alias("value")))
    return table, broken


def insights(old: DataFrame, new: DataFrame, k: int = 3) -> DataFrame:
    """(theme, priority, entity, delta, text): the ``k`` largest rises and falls of mean distance, and the largest shift of each count.

    Both have (pole_id, pole_num, km_mean, stores, population, units); poles in both are compared.
    """
    counts = ("stores", "population", "units")
    pairs = old.select("pole_id", "pole_num", *[F.col(c).cast("double").alias(f"{c}_old") for c in (*counts, "km_mean")]).join(new.select("pole_id", *[F.col(c).cast("double").alias(f"{c}_new") for c in (*counts, "km_mean")]), "pole_id")
    delta = lambda c: F.col(f"{c}_new") - F.col(f"{c}_old")

    def told(df: DataFrame, theme: str, priority: Column, d: Column, text: Column) -> DataFrame:
        return df.select(F.lit(theme).alias("theme"), priority.alias("priority"), F.col("pole_id").alias("entity"), F.round(d, 2).alias("delta"), text.alias("text"))

    km = delta("km_mean")
    moved = pairs.filter(F.abs(km) > 1e-9)
    up = moved.filter(km > 0).orderBy(km.desc(), "pole_num").limit(k)
    down = moved.filter(km < 0).orderBy(km, "pole_num").limit(k)
    out = told(up, "Carteira", F.lit("ALTA"), km, F.format_string("Polo %s: a distância média sobe %s km.", "pole_id", v.brazilian(km, 2)))
    out = out.union(told(down, "Carteira", F.lit("POSITIVA"), km, F.format_string("Polo %s: a distância média cai %s km.", "pole_id", v.brazilian(-km, 2))))
    for c, theme in zip(counts, ("Correspondentes", "População", "Unidades territoriais"), strict=True):
        d = delta(c)
        most = pairs.filter(F.abs(d) > 1e-9).orderBy(F.abs(d).desc(), "pole_num").limit(1)
        out = out.union(told(most, theme, F.lit("MÉDIA"), d, F.format_string("Polo %s: de %s para %s.", "pole_id", v.brazilian(F.col(f"{c}_old"), 0), v.brazilian(F.col(f"{c}_new"), 0))))
    return out


def alternatives(members: DataFrame, poles: DataFrame, within_km: float = 150.0) -> DataFrame:
    """Per pole its best more populous alternative by the summed weighted distance of its units plus the site penalty.

    ``members`` has (pole_id, lat, lon, weight), ``poles`` (pole_id, pole_num, area, lat, lon, seat_population, penalty). Poles
    without a more populous neighbour have no row. Neighbours come from the latitude strips of the distance join.
    """
    from ..functions.geo import between_tables
    from .spatial import within_km as near

    p = poles.withColumn("_all", F.lit(1))
    options = near(p, p, within_km, ["_all"]).filter("b.seat_population > a.seat_population").select(F.col("a.pole_id").alias("pole_id"), F.col("b.pole_id").alias("alternative"), F.col("b.pole_num").alias("num"), "km", F.col("b.lat").alias("lat"), F.col("b.lon").alias("lon"), (F.col("b.penalty") - F.col("a.penalty")).alias("penalty"))
    seats = poles.select("pole_id", "lat", "lon")
    now = members.alias("u").join(seats.alias("p"), F.col("u.pole_id") == F.col("p.pole_id")).groupBy("u.pole_id").agg(F.sum(between_tables("u", "p") * F.col("u.weight")).alias("now"))
    then = members.alias("u").join(options.alias("p"), F.col("u.pole_id") == F.col("p.pole_id")).groupBy("u.pole_id", "p.alternative", "p.num", "p.penalty", "p.km").agg(F.sum(between_tables("u", "p") * F.col("u.weight")).alias("then"))
    scored = then.join(now, "pole_id").withColumn("delta", F.col("then") - F.col("now") + F.col("penalty"))
    return scored.groupBy("pole_id").agg(F.min(F.struct(F.round("delta", 6).alias("delta"), "num", "alternative", "km")).alias("b")).select("pole_id", "b.alternative", "b.km", "b.delta")
